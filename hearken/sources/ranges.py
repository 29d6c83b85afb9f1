"""Records of large files, read by many tasks: CSV with line breaks inside texts, JSON arrays.

Spark's text reader cuts a file into ranges at a separator, here the line feed of a CSV file and
the closing brace of a JSON file. Whether a separator ends a record depends on all before it: an
open quote, or the depth of braces. So each range is first summed up by what it does to that
state, for each state it may begin in; a prefix scan over the ranges of a file, one small row
each, gives the state every range really begins in; then each range cuts its own records. A record
that reaches over ranges leaves a fragment in each of them, and these few are put together.

A task takes several ranges where they are small, and the states reach the ranges by a join, so
the work grows with the files and not with the number of ranges times the number of tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby, islice

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearken.runtime import scratch_path

_SUMMARY = "file string, range long, quotes long, depth_outside long, depth_inside long"
_RECORDS = "file string, range long, number long, begins boolean, ends boolean, record string"


@dataclass(frozen=True)
class Format:
    """How a file is cut: its separator, and what a chunk up to a separator does.

    `summary` gives the quotes of a chunk, and the braces it opens less those it closes if it
    begins outside, and if it begins inside quotes.
    """

    separator: str
    summary: Callable[[str], tuple[int, int, int]]
    depth: bool


def _csv_chunk(text: str) -> tuple[int, int, int]:
    # a doubled quote is two: it leaves the state as it was
    return text.count('"'), 0, 0


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _json_chunk(text: str) -> tuple[int, int, int]:
    parts = (_ESCAPED.sub("", text) if "\\" in text else text).split('"')
    opened = [part.count("{") for part in parts]
    quotes = len(parts) - 1
    # the brace that ends the chunk closes if no quote is open there
    outside, inside = sum(opened[0::2]), sum(opened[1::2])
    closes = quotes % 2 == 0
    return quotes, outside - closes, inside - (not closes)


ROWS_PER_BATCH = 1_000
# a task reads about this much, but each core has some tasks
TASK_BYTES = 32 << 20
TASKS_PER_CORE = 4

CSV = Format("\n", _csv_chunk, depth=False)
JSON_ARRAY = Format("}", _json_chunk, depth=True)


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Chunks between separators in the order of their range. A chunk is of the range it begins in."""
    return (
        spark.read.option("lineSep", separator)
        .option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("range"),
            "value",
        )
    )


def _packed(df: DataFrame) -> DataFrame:
    """Whole partitions of a table as it is read, several to a task where they are small."""
    spark = df.sparkSession
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    number, unit = re.fullmatch(r"(\d+)([a-z]?)b?", size.strip().lower()).groups()
    partition_bytes = int(number) << 10 * " kmgtp".index(unit.replace("b", "") or " ")
    there = df.rdd.getNumPartitions()
    wanted = math.ceil(there * partition_bytes / TASK_BYTES)
    tasks = max(wanted, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return df.coalesce(tasks) if tasks < there else df


def _by_range(frames) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The chunks of each range, under what all its rows share. A task holds whole ranges, one
    after the other; the last column is the text."""
    rows = (
        row for frame in frames for row in zip(*(frame[c] for c in frame.columns), strict=True)
    )
    for shared, some in groupby(rows, key=lambda row: row[:-1]):
        yield shared, (row[-1] for row in some)


def _batches(rows: Iterator[tuple], columns: Sequence[str]):
    import pandas as pd

    while some := list(islice(rows, ROWS_PER_BATCH)):
        yield pd.DataFrame(some, columns=columns)


def _summaries(form: Format):
    def rows(frames):
        for (file, at), texts in _by_range(frames):
            quotes = outside = inside = 0
            for text in texts:
                n, a, b = form.summary(text)
                # what began outside is inside quotes after an odd number of them
                if quotes % 2:
                    a, b = b, a
                quotes, outside, inside = quotes + n, outside + a, inside + b
            yield file, at, quotes, outside, inside

    def work(frames):
        yield from _batches(rows(frames), [c.split()[0] for c in _SUMMARY.split(", ")])

    return work


def _states(chunks: DataFrame, form: Format) -> DataFrame:
    """The state in which each range of each file begins: `inside` quotes, `depth` of braces; and
    what the whole file comes to: `open` quotes, `left` braces."""
    summed = chunks.mapInPandas(_summaries(form), _SUMMARY)
    whole = Window.partitionBy("file")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    change = F.when(F.col("inside"), F.col("depth_inside")).otherwise(F.col("depth_outside"))
    return (
        summed.withColumn("inside", F.coalesce(F.sum("quotes").over(before), zero) % 2 == 1)
        .withColumn("change", change)
        .withColumn("depth", F.coalesce(F.sum("change").over(before), zero))
        .withColumn("open", F.sum("quotes").over(whole) % 2 == 1)
        .withColumn("left", F.sum("change").over(whole))
    )


def _cut(form: Format):
    def pieces(texts, inside, depth):
        """(begins, ends, text) of each record or fragment of a range."""
        begins, held = not (inside or depth), []
        for text in texts:
            quotes, outside_change, inside_change = form.summary(text)
            if form.depth:
                if not (inside or depth):
                    if "{" not in text:
                        continue  # what follows the last record of the file
                    text = text[text.index("{") :]
                depth += inside_change if inside else outside_change
                text += form.separator
            inside ^= quotes % 2 == 1
            if inside or depth:
                held.append(text if form.depth else text + form.separator)
                continue
            held.append(text)
            yield begins, True, "".join(held)
            begins, held = True, []
        if held:
            yield begins, False, "".join(held)

    def rows(frames):
        for (file, at, inside, depth), texts in _by_range(frames):
            for number, piece in enumerate(pieces(texts, inside, depth)):
                yield file, at, number, *piece

    def work(frames):
        yield from _batches(rows(frames), [c.split()[0] for c in _RECORDS.split(", ")])

    return work


def read_records(spark: SparkSession, path: str, form: Format) -> tuple[DataFrame, DataFrame]:
    """`(file, range, number, record)` of all files at `path`, and `(file)` of those that end
    within a record.

    `range` and `number` order the records of a file. The files are read twice: once for the
    states, once for the records, which are kept in the shared folder. Each executor gets one
    small row for each range that begins within a record, so at most one for each
    `spark.sql.files.maxPartitionBytes` of input.
    """
    chunks = _packed(_chunks(spark, path, form.separator))
    place = scratch_path(spark, "ranges")
    _states(chunks, form).write.parquet(place)
    states = spark.read.parquet(place)
    starts = states.where("inside or depth <> 0").select("file", "range", "inside", "depth")
    # the hint is needed, not advice: a shuffle would mix up the chunks of a range
    begun = chunks.join(F.broadcast(starts), ["file", "range"], "left").select(
        "file",
        "range",
        F.coalesce("inside", F.lit(False)).alias("inside"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        "value",
    )
    # the end of a JSON array reads like one more closing brace
    whole = F.col("left") == (-1 if form.depth else 0)
    broken = states.where(F.col("open") | ~whole).select("file").distinct()
    kept = scratch_path(spark, "records")
    begun.mapInPandas(_cut(form), _RECORDS).write.parquet(kept)
    cut = _packed(spark.read.schema(_RECORDS).parquet(kept))
    records = cut.where("begins and ends").select("file", "range", "number", "record")
    # a record over several ranges: each piece that begins one opens a group
    order = Window.partitionBy("file").orderBy("range", "number")
    opened = F.sum(F.col("begins").cast("int")).over(order)
    ordered = F.sort_array(F.collect_list(F.struct("range", "number", "record")))
    joined = (
        cut.where("not (begins and ends)")
        .withColumn("group", opened)
        .groupBy("file", "group")
        .agg(ordered.alias("parts"))
        .select(
            "file",
            F.col("parts")[0]["range"].alias("range"),
            F.col("parts")[0]["number"].alias("number"),
            F.array_join("parts.record", "").alias("record"),
        )
    )
    return records.unionByName(joined), broken
