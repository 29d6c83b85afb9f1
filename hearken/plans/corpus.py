"""Corpus preparation jobs.

Each job writes its cleaned table once and derives every export from that table, so a lost
executor or a later stage never repeats the reading and cleaning.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hearken.functions import (
    absolute_path,
    encode_chars,
    normalize_cyrillic,
    normalize_full,
    normalize_punct,
    prefix_path,
    rebase_path,
)
from hearken.operators import (
    alphabet,
    assert_split,
    collect_vocab,
    ctc_vocab,
    drop_empty,
    exact_split,
    marked_rows,
    missing_audio,
    prep_report,
    select_dropna,
    split_by_flag,
    to_canonical,
    with_existing_audio,
    without_mark,
)
from hearken.functions.labels import WORD_MARK
from hearken.operators.alphabet import REJECT
from hearken.runtime import spread
from hearken.sources import (
    export_once,
    fingerprint,
    list_audio,
    materialize_once,
    publish_version,
    read_annotations_csv,
    read_annotations_json,
    read_jsonl,
    write_alphabet,
    write_manifest,
    write_split_jsonl,
    write_vocab_json,
)
from hearken.sources.annotations import SPLIT_RECORD_SCHEMA

# Column names of the annotation table.
PATH_COLUMN = "Путь к файлу"
TEXT_COLUMN = "Расшифровка"
FLAG_COLUMN = "test"


@dataclass(frozen=True)
class PreparedCorpus:
    records: DataFrame
    report: DataFrame
    missing: DataFrame
    alphabet: DataFrame
    version: int | None = None


@dataclass(frozen=True)
class LabelledCorpus:
    records: DataFrame
    vocab: DataFrame
    marked: int = 0


def annotation_schema(
    path_column: str, text_column: str, flag_column: str | None = None
) -> T.StructType:
    fields = [T.StructField(path_column, T.StringType()), T.StructField(text_column, T.StringType())]
    if flag_column:
        fields.append(T.StructField(flag_column, T.IntegerType()))
    return T.StructType(fields)


def prepare_corpus(
    spark: SparkSession,
    source_csv: str,
    out: str,
    audio_folder: str,
    files: DataFrame | None = None,
    path_column: str = PATH_COLUMN,
    text_column: str = TEXT_COLUMN,
    test_size: float = 0.1,
    seed: int = 42,
    cwd: str = "/",
    version_root: str | None = None,
    version_name: str = "corpus",
    null_values: tuple[str, ...] = (),
    multi_line: bool = True,
    partitions: int | None = None,
    in_ranges: bool = False,
) -> PreparedCorpus:
    """Annotation CSV to records, manifests and alphabet of an exact train/test split.

    `files` lists the existing clips in the column `path`; without it `audio_folder`, seen from
    `cwd`, is listed. `null_values` are words that mean a missing value; `multi_line` and
    `partitions`: see the reader and `spread`.

    Tables and exports are written again when an argument or an input they depend on changes,
    and only then. Raises when a part of the split has no rows.
    """

    def clean() -> DataFrame:
        schema = annotation_schema(path_column, text_column)
        raw = read_annotations_csv(
            spark, source_csv, schema, null_values, multi_line, in_ranges=in_ranges
        )
        raw = spread(raw, partitions)
        rows = raw.select(
            rebase_path(F.col(f"`{path_column}`"), audio_folder).alias("path"),
            normalize_full(F.col(f"`{text_column}`")).alias("text"),
        )
        return drop_empty(rows.na.drop("any", subset=["path"]), "text")

    cleaned = materialize_once(
        spark,
        f"{out}/clean",
        clean,
        arguments={
            "columns": [path_column, text_column],
            "audio_folder": audio_folder,
            "null_values": list(null_values),
            "multi_line": multi_line,
        },
        inputs=[source_csv],
    )
    if files is None:
        files = list_audio(spark, posixpath.join(cwd, audio_folder))
    # stored, since the split reads it more than once
    found = materialize_once(
        spark,
        f"{out}/found",
        lambda: with_existing_audio(cleaned, files, base=cwd),
        arguments={"files": fingerprint(files.select("path")).first().asDict(), "cwd": cwd},
        inputs=[f"{out}/clean"],
    )
    corpus = materialize_once(
        spark,
        f"{out}/corpus",
        lambda: exact_split(found, "path", test_size, seed),
        arguments={"test_size": test_size, "seed": seed},
        inputs=[f"{out}/found"],
    )
    assert_split(corpus, parts=[*["train"] * (test_size < 1), *["test"] * (test_size > 0)])
    chars = alphabet(by_part(corpus, "train"), "text")
    for name, write in {
        "records": lambda path: write_split_jsonl(corpus, path, "path", "text"),
        "manifest": lambda path: write_manifest(corpus, path, absolute_path("path", cwd), "text"),
        "alphabet": lambda path: write_alphabet(chars, path),
    }.items():
        _export(spark, out, name, write, {"cwd": cwd})
    rows_clean = cleaned.agg(F.count("*")).scalar()
    report = prep_report(corpus, F.lit(True), "split").withColumnRenamed("rows_kept", "rows_found")
    records = read_jsonl(spark, f"{out}/records", f"{SPLIT_RECORD_SCHEMA}, split string")
    version = None
    if version_root:
        published = to_canonical(corpus, {"path": "audio", "text": "transcription"})
        version = publish_version(published, version_root, version_name)
    return PreparedCorpus(
        records=records,
        report=report.drop("rows_read").withColumn("rows_clean", rows_clean),
        missing=missing_audio(cleaned.select("path"), files, base=cwd),
        alphabet=chars,
        version=version,
    )


def _export(spark, out: str, name: str, write, arguments: dict) -> None:
    path = f"{out}/{name}"
    export_once(spark, path, lambda: write(path), arguments, [f"{out}/corpus"])


def by_part(df: DataFrame, part: str) -> DataFrame:
    return df.where(F.col("split") == part)


def prepare_json_corpus(
    spark: SparkSession,
    source_json: str,
    out: str,
    test_size: float = 0.1,
    seed: int = 42,
    cwd: str = "/",
    extra_space: bool = True,
    partitions: int | None = None,
    in_ranges: bool = False,
) -> DataFrame:
    """Annotation JSON to Cyrillic-only manifests and an alphabet over all rows."""

    def clean() -> DataFrame:
        raw = select_dropna(
            spread(read_annotations_json(spark, source_json, in_ranges=in_ranges), partitions),
            ["audio_path", "text"]
        )
        return raw.withColumn("text", normalize_cyrillic("text"))

    cleaned = materialize_once(spark, f"{out}/clean", clean, arguments={}, inputs=[source_json])
    corpus = materialize_once(
        spark,
        f"{out}/corpus",
        lambda: exact_split(cleaned, "audio_path", test_size, seed),
        arguments={"test_size": test_size, "seed": seed},
        inputs=[f"{out}/clean"],
    )
    for name, write in {
        "manifest": lambda path: write_manifest(
            corpus, path, absolute_path("audio_path", cwd), "text"
        ),
        "alphabet": lambda path: write_alphabet(alphabet(corpus, "text"), path, extra_space),
    }.items():
        _export(spark, out, name, write, {"cwd": cwd, "extra_space": extra_space})
    return corpus


def prepare_flagged_corpus(
    spark: SparkSession,
    source_csv: str,
    out: str,
    audio_root: str,
    path_column: str = PATH_COLUMN,
    text_column: str = TEXT_COLUMN,
    flag_column: str = FLAG_COLUMN,
    null_values: tuple[str, ...] = (),
    multi_line: bool = True,
    partitions: int | None = None,
    in_ranges: bool = False,
    word_mark: str = REJECT,
) -> LabelledCorpus:
    """Annotation CSV with a test flag to labelled train and eval records.

    The vocabulary comes from the training part only. A literal word mark in the texts would
    share its id with the space. `word_mark` says what becomes of it before anything is written:
    `reject` raises with the number of such texts, `drop` leaves the mark out, `space` puts a
    space there; `marked` counts the texts that held one.
    """
    names = [path_column, text_column, flag_column]

    def rows() -> DataFrame:
        schema = annotation_schema(path_column, text_column, flag_column)
        raw = read_annotations_csv(
            spark, source_csv, schema, null_values, multi_line, in_ranges=in_ranges
        )
        raw = spread(raw, partitions)
        rows = to_canonical(
            select_dropna(raw, names), {path_column: "audio", text_column: "text", flag_column: "test"}
        ).withColumns(
            {
                "audio": prefix_path("audio", audio_root),
                "marked": F.contains("text", F.lit(WORD_MARK)),
                "text": normalize_punct(without_mark("text", word_mark)),
            }
        )
        return split_by_flag(rows, "test").drop("test")

    def clean() -> DataFrame:
        if word_mark == REJECT and (n := marked_rows(rows(), "text")):
            raise ValueError(f"{n} texts hold the word mark {WORD_MARK!r}")
        return rows()

    stage = materialize_once(
        spark,
        f"{out}/corpus",
        clean,
        arguments={
            "columns": names,
            "audio_root": audio_root,
            "null_values": list(null_values),
            "multi_line": multi_line,
            "word_mark": word_mark,
        },
        inputs=[source_csv],
    )
    corpus = assert_split(stage.drop("marked"))
    vocab = materialize_once(
        spark,
        f"{out}/vocab",
        lambda: ctc_vocab(by_part(corpus, "train"), "text").coalesce(1),
        inputs=[f"{out}/corpus"],
    )
    export_once(
        spark,
        f"{out}/vocab_json",
        lambda: write_vocab_json(vocab, f"{out}/vocab_json"),
        inputs=[f"{out}/vocab"],
    )
    return LabelledCorpus(
        corpus.withColumn("labels", encode_chars("text", collect_vocab(vocab))),
        vocab,
        stage.agg(F.count_if("marked")).first()[0],
    )
