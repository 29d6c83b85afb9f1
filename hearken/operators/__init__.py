"""DataFrame operators of the transcript engine."""

from hearken.operators.alphabet import (
    alphabet,
    collect_vocab,
    ctc_vocab,
    distinct_chars,
    lookup_ids,
    marked_rows,
    without_mark,
)
from hearken.operators.batches import length_batches, pad_batch
from hearken.operators.ctc import ctc_greedy_decode
from hearken.operators.hypotheses import assemble_hypotheses, attach_outputs
from hearken.operators.prepare import (
    assert_split,
    bundle_splits,
    by_flag,
    drop_empty,
    first_of_split,
    missing_audio,
    prep_report,
    require_columns,
    select_dropna,
    split_by_flag,
    split_errors,
    to_canonical,
    with_existing_audio,
)
from hearken.operators.preferences import chat_preference, instruction_text, preference_triples
from hearken.operators.rover import rover
from hearken.operators.runs import best_run, latency_compare, latest_checkpoint
from hearken.operators.scores import corpus_wer, utterance_edits, wer_by_system, wer_of_columns
from hearken.operators.scoring import score_batches
from hearken.operators.segments import join_segments, render_turns
from hearken.operators.split import exact_split

__all__ = [
    "alphabet",
    "assemble_hypotheses",
    "assert_split",
    "attach_outputs",
    "best_run",
    "bundle_splits",
    "by_flag",
    "chat_preference",
    "collect_vocab",
    "corpus_wer",
    "ctc_greedy_decode",
    "ctc_vocab",
    "distinct_chars",
    "drop_empty",
    "exact_split",
    "first_of_split",
    "instruction_text",
    "join_segments",
    "latency_compare",
    "latest_checkpoint",
    "length_batches",
    "lookup_ids",
    "marked_rows",
    "missing_audio",
    "pad_batch",
    "preference_triples",
    "prep_report",
    "render_turns",
    "require_columns",
    "rover",
    "score_batches",
    "select_dropna",
    "split_by_flag",
    "split_errors",
    "to_canonical",
    "utterance_edits",
    "wer_by_system",
    "wer_of_columns",
    "with_existing_audio",
    "without_mark",
]
