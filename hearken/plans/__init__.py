"""Whole jobs: corpus preparation, training sets, evaluation."""

from hearken.plans.corpus import prepare_corpus, prepare_flagged_corpus, prepare_json_corpus
from hearken.plans.evaluation import (
    corrector_prompts,
    evaluate_raw,
    evaluate_systems,
    merge_requests,
)
from hearken.plans.training_sets import build_instruction_set, build_preference_set

__all__ = [
    "build_instruction_set",
    "build_preference_set",
    "corrector_prompts",
    "evaluate_raw",
    "evaluate_systems",
    "merge_requests",
    "prepare_corpus",
    "prepare_flagged_corpus",
    "prepare_json_corpus",
]
