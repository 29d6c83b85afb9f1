"""Training sets for language-model correctors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hearken.operators import (
    chat_preference,
    instruction_text,
    join_segments,
    preference_triples,
)
from hearken.sources import load_dataset_dir, publish_version, save_dataset


def machine_texts(records: DataFrame, segments: DataFrame, key: str = "audio") -> DataFrame:
    """Records with the recogniser's text, put together from its segments.

    `segments` holds `(key, seg_no, text)`; a clip without output is left out.
    """
    heard = join_segments(segments, key, "seg_no", "text", "hyp")
    return records.join(heard, key)


def build_preference_set(
    records: DataFrame,
    segments: DataFrame,
    template: str,
    path: str,
    version_root: str | None = None,
    version_name: str = "preferences",
    chat: bool = False,
) -> DataFrame:
    """Preference triples of the training records, stored and optionally published.

    With `chat` each field is a list of one chat message instead of a text.
    """
    pairs = machine_texts(records, segments)
    triples = preference_triples(pairs, template, "transcription", "hyp")
    save_dataset(chat_preference(triples) if chat else triples, path)
    stored = load_dataset_dir(records.sparkSession, path)
    if version_root:
        publish_version(stored, version_root, version_name)
    return stored


def build_instruction_set(
    records: DataFrame, segments: DataFrame, template: str, path: str
) -> DataFrame:
    """Instruction texts of the training records, stored."""
    pairs = machine_texts(records, segments)
    save_dataset(instruction_text(pairs, template, "transcription", "hyp"), path)
    return load_dataset_dir(records.sparkSession, path)
