"""Evaluation jobs: several systems against the truth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hearken.functions import (
    chat_message,
    fill_template,
    merge_request,
    normalize_full,
    render_chat,
)
from hearken.operators import (
    assemble_hypotheses,
    attach_outputs,
    by_flag,
    rover,
    split_errors,
    wer_of_columns,
    with_existing_audio,
)
from hearken.runtime import quoted
from hearken.sources import load_dataset_dir, save_dataset, write_results_csv


@dataclass(frozen=True)
class Evaluation:
    details: DataFrame
    summary: DataFrame
    skipped: DataFrame | None = None
    errors: DataFrame | None = None
    prompts: DataFrame | None = None
    merges: DataFrame | None = None


def corrector_prompts(
    wide: DataFrame, system: str, template: str, key: str = "utt_id"
) -> DataFrame:
    """`(key, prompt)`: what a corrector is asked about one system's text, as a chat prompt.

    The template's placeholder is `{instruction}`. A clip without a text has no prompt.
    """
    asked = fill_template(template, instruction=F.col(quoted(system)))
    prompt = render_chat(F.array(chat_message("user", asked)))
    return wide.where(F.col(quoted(system)).isNotNull()).select(key, prompt.alias("prompt"))


def evaluate_systems(
    refs: DataFrame,
    hyps: DataFrame,
    systems: Sequence[str],
    out: str,
    corrected: DataFrame | None = None,
    tie: str = "first",
    key: str = "utt_id",
    ref: str = "ref",
    prompt_system: str | None = None,
    prompt_template: str = "{instruction}",
) -> Evaluation:
    """Normalised scores of each system, their vote and, if given, a corrector's output.

    `hyps` is long, `(key, system, hyp)`; `corrected` holds `(key, corrected)`. Voting and
    scoring use the details table as written, so the alignment is done once. It keeps the
    texts as given in columns ending in `_raw`. With `prompt_system`, `prompts` asks a corrector
    about that system's text as given.
    """
    wide = assemble_hypotheses(refs.select(key, ref), hyps, systems, key)
    scored = [*systems, "rover"]
    texts = {c: F.col(quoted(c)) for c in [ref, *systems]}
    clean = wide.withColumns({f"{c}_raw": text for c, text in texts.items()}).withColumns(
        {c: normalize_full(text) for c, text in texts.items()}
    )
    voted = rover(clean, systems, tie)
    if corrected is not None:
        outputs = corrected.select(key, normalize_full("corrected").alias("corrected"))
        voted = attach_outputs(voted, outputs, key)
        scored.append("corrected")
    save_dataset(voted, f"{out}/details")
    details = load_dataset_dir(refs.sparkSession, f"{out}/details")
    write_results_csv(details, f"{out}/details_csv")
    prompts = None
    if prompt_system is not None:
        prompts = corrector_prompts(details, f"{prompt_system}_raw", prompt_template, key)
    return Evaluation(details, wer_of_columns(details, ref, scored), prompts=prompts)


def merge_requests(
    wide: DataFrame, version_a: str, version_b: str, system_text: str, key: str = "audio"
) -> DataFrame:
    """Chat messages that ask a language model to merge two systems' versions."""
    return wide.select(key, merge_request(version_a, version_b, system_text).alias("messages"))


def evaluate_raw(
    annotations: DataFrame,
    files: DataFrame,
    outputs: DataFrame,
    systems: Sequence[str],
    out: str,
    bom: bool = True,
    merge: tuple[str, str] | None = None,
    merge_text: str = "",
) -> Evaluation:
    """Scores of raw, un-normalised outputs on the flagged test part.

    `annotations` holds `(audio, text, test)`, `files` existing clips as `path`, `outputs`
    is long, `(audio, system, hyp, error)`. Clips without a file and clips on which any
    system failed are left out of the scores: `skipped` holds them, `errors` the failed outputs.
    `merge` names two systems whose versions a language model is asked to merge, with the system
    message `merge_text`: `merges`. Raises when the test part is empty.
    """
    test = by_flag(annotations, "test", 1).select("audio", F.col("text").alias("ground_truth"))
    if test.isEmpty():
        raise ValueError("no rows with test = 1")
    present = with_existing_audio(test, files.withColumnRenamed("path", "audio"), "audio")
    passed, failed = split_errors(outputs, F.col("error").isNotNull())
    wide = assemble_hypotheses(present, passed, systems, "audio")
    save_dataset(wide, f"{out}/details")
    details = load_dataset_dir(annotations.sparkSession, f"{out}/details")
    write_results_csv(details, f"{out}/details_csv", bom)
    skipped = test.join(details.select("audio"), "audio", "left_anti")
    merges = merge_requests(details, *merge, merge_text) if merge else None
    summary = wer_of_columns(details, "ground_truth", systems)
    return Evaluation(details, summary, skipped, failed, merges=merges)
