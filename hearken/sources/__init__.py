"""Readers and writers of the corpus formats."""

from hearken.sources.annotations import (
    ANNOTATION_SCHEMA,
    SPLIT_RECORD_SCHEMA,
    read_annotations_csv,
    read_annotations_json,
    read_jsonl,
)
from hearken.sources.audio import list_audio
from hearken.sources.datasets import (
    load_dataset_dir,
    save_dataset,
    write_manifest,
    write_results_csv,
    write_split_jsonl,
)
from hearken.sources.stages import export_once, materialize_once
from hearken.sources.versions import fingerprint, publish_version, read_version, registry
from hearken.sources.vocabulary import write_alphabet, write_vocab_json

__all__ = [
    "ANNOTATION_SCHEMA",
    "SPLIT_RECORD_SCHEMA",
    "export_once",
    "fingerprint",
    "list_audio",
    "load_dataset_dir",
    "materialize_once",
    "publish_version",
    "read_annotations_csv",
    "read_annotations_json",
    "read_jsonl",
    "read_version",
    "registry",
    "save_dataset",
    "write_alphabet",
    "write_manifest",
    "write_results_csv",
    "write_split_jsonl",
    "write_vocab_json",
]
