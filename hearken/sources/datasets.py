"""Datasets on disk: columnar folders, per-split records, manifests, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hearken.runtime import ColumnLike, as_column
from hearken.sources.annotations import BYTE_ORDER_MARK


def save_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def load_dataset_dir(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_split_jsonl(
    df: DataFrame,
    path: str,
    audio: ColumnLike = "audio",
    transcription: ColumnLike = "transcription",
    split: ColumnLike = "split",
    mode: str = "overwrite",
) -> None:
    """JSON lines `audio`, `transcription` in one folder per split; text stays unescaped.

    The split is a partition column, so reading one part prunes the other's files.
    """
    df.select(
        as_column(audio).alias("audio"),
        as_column(transcription).alias("transcription"),
        as_column(split).alias("split"),
    ).write.mode(mode).partitionBy("split").json(path)


def write_manifest(
    df: DataFrame,
    path: str,
    audio: ColumnLike = "audio",
    text: ColumnLike = "text",
    split: ColumnLike = "split",
    mode: str = "overwrite",
) -> None:
    """Text lines `path|text` in one folder per split."""
    df.select(
        F.concat_ws("|", as_column(audio), as_column(text)).alias("value"),
        as_column(split).alias("split"),
    ).write.mode(mode).partitionBy("split").text(path)


def write_results_csv(
    df: DataFrame, path: str, bom: bool = False, mode: str = "overwrite"
) -> None:
    """Results as UTF-8 CSV with a header. `bom` marks each file's start for spreadsheets."""
    if bom:
        first = df.columns[0]
        df = df.withColumnsRenamed({first: BYTE_ORDER_MARK + first})
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", '""')
        # keep the blanks at both ends of a text
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
