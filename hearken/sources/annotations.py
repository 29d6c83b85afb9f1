"""Annotation tables: which clip says what. Types are given, never inferred."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from hearken.runtime import quoted
from hearken.sources.ranges import CSV, JSON_ARRAY, read_records

ANNOTATION_SCHEMA = "audio_path string, text string"
SPLIT_RECORD_SCHEMA = "audio string, transcription string"
BYTE_ORDER_MARK = "\ufeff"

CORRUPT = "_corrupt"
FAIL, QUARANTINE = "fail", "quarantine"

Schema = str | T.StructType


def _checked(mode: str) -> str:
    if mode not in (FAIL, QUARANTINE):
        raise ValueError(f"mode must be {FAIL!r} or {QUARANTINE!r}, got {mode!r}")
    return mode


def _json(spark: SparkSession, schema: Schema, mode: str) -> DataFrameReader:
    if _checked(mode) == FAIL:
        return spark.read.schema(schema).option("mode", "FAILFAST")
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    known = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(known).option("columnNameOfCorruptRecord", CORRUPT)


def _null_markers(df: DataFrame, null_values: Sequence[str]) -> DataFrame:
    if not null_values:
        return df
    return df.select(
        [F.when(~F.col(f"`{c}`").isin(*null_values), F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def read_annotations_csv(
    spark: SparkSession,
    path: str,
    schema: Schema = ANNOTATION_SCHEMA,
    null_values: Sequence[str] = (),
    multi_line: bool = True,
    mode: str = FAIL,
    in_ranges: bool = False,
) -> DataFrame:
    """CSV with a header, any Unicode column names and quoted text.

    The columns of `schema` are found by name, in any order and among others; only they are
    parsed. Files of one call have the same header. Words in `null_values` become null; an
    empty field is null already, quoted or not. A value that does not fit its type ends the job
    or, with mode "quarantine", is null, and the column `_corrupt` holds its whole row.

    With `multi_line` a quoted text may hold line breaks, but each file is then one task. With
    `in_ranges` it may, too, and a large file is still read by many tasks: see `read_records`.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if in_ranges:
        raw = _csv_in_ranges(spark, path)
    else:
        raw = (
            spark.read.option("header", True)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("enforceSchema", False)
            .csv(path)
        )
    by_name = {c.removeprefix(BYTE_ORDER_MARK): c for c in raw.columns}
    absent = [f.name for f in wanted if f.name not in by_name]
    if absent:
        raise ValueError(f"missing columns {absent} in {path}")
    texts = raw.select([F.col(f"`{by_name[f.name]}`").alias(f.name) for f in wanted])
    marked = _null_markers(texts, null_values)
    if _checked(mode) == FAIL:
        return marked.select([F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in wanted])
    cells = {f.name: F.col(quoted(f.name)).try_cast(f.dataType) for f in wanted}
    misfits = [cells[n].isNull() & F.col(quoted(n)).isNotNull() for n in cells]
    row = F.to_json(F.struct(*[F.col(quoted(n)) for n in cells]))
    return marked.select(
        *[c.alias(n) for n, c in cells.items()], F.when(reduce(or_, misfits), row).alias(CORRUPT)
    )


def _csv_in_ranges(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, under the names of the header that all files share."""
    records, broken = read_records(spark, path, CSV)
    _refuse(broken, "an open quote")
    first = (F.col("range") == 0) & (F.col("number") == 0)
    headers = [r[0] for r in records.where(first).select("record").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"{'different headers' if headers else 'no header'} in {path}")
    names = next(csv.reader([headers[0].rstrip("\r")]))
    # where records end in CR LF, line breaks inside them are read as LF
    line = F.when(
        F.endswith("record", F.lit("\r")),
        F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), "\r$", ""),
    ).otherwise(F.col("record"))
    options = {"escape": '"', "multiLine": "true"}
    parsed = F.from_csv(line, ", ".join(f"{quoted(n)} string" for n in names), options)
    return records.where(~first & (line != "")).select(parsed.alias("cells")).select("cells.*")


def _refuse(broken: DataFrame, what: str) -> None:
    files = [r[0] for r in broken.limit(5).collect()]
    if files:
        raise ValueError(f"{what} at the end of {files}")


def read_annotations_json(
    spark: SparkSession,
    path: str,
    schema: Schema = ANNOTATION_SCHEMA,
    mode: str = FAIL,
    in_ranges: bool = False,
) -> DataFrame:
    """Files that each hold one JSON array of objects.

    A broken file ends the job or, with mode "quarantine", gives one row whose column `_corrupt`
    holds it. With `in_ranges` a large file is read by many tasks, see `read_records`; what is
    broken is then an object, or what is left of one at the end of a file.
    """
    if in_ranges:
        records, broken = read_records(spark, path, JSON_ARRAY)
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        options = {"mode": "FAILFAST"}
        if _checked(mode) == FAIL:
            _refuse(broken, "no end of the array")
        else:
            wanted = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
            options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        parsed = F.from_json("record", wanted, options)
        return records.select(parsed.alias("cells")).select("cells.*")
    return _json(spark, schema, mode).option("multiLine", True).json(path)


def read_jsonl(
    spark: SparkSession, path: str, schema: Schema = SPLIT_RECORD_SCHEMA, mode: str = FAIL
) -> DataFrame:
    """One JSON object per line. Lines are splittable, so this is the form for large corpora.

    A broken line ends the job or, with mode "quarantine", is a row with the line in `_corrupt`.
    """
    return _json(spark, schema, mode).json(path)
