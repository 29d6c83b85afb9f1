"""Batches of like length and their padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from hearken.functions.labels import IGNORED_LABEL
from hearken.runtime import ColumnLike, as_column, quoted

BATCHES_PER_GROUP = 50


def length_batches(
    df: DataFrame,
    key: str,
    length: ColumnLike,
    batch_size: int = 16,
    batches_per_group: int = BATCHES_PER_GROUP,
) -> DataFrame:
    """Number rows so that those of like length share a batch: adds `megabatch`, `batch`.

    A hash draws a random group of about fifty batches for each row; inside it rows go by
    falling length. Groups have a fixed size whatever the corpus, so the sort is never larger
    than one group. A row whose key is its own is drawn by that key. Rows of a repeated or null
    key are drawn by all their columns and their place in the table as well, so that they do
    not meet in one group: give a stored table.
    """
    group_rows = batch_size * batches_per_group
    groups = df.agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(group_rows))).cast("long")
    ).scalar()
    name = F.col(quoted(key))
    # one row per key that is not unique, counted before the shuffle
    copies = df.groupBy(name.alias("_copied")).agg(F.count(F.lit(1)).alias("_n"))
    copies = copies.where((F.col("_n") > 1) | F.col("_copied").isNull()).drop("_n")
    drawn_by = name.cast("string")
    drawn = df
    if not copies.isEmpty():
        whole = F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]))
        place = F.monotonically_increasing_id().cast("string")
        own = F.concat_ws(":", F.md5(whole), place)
        copies = copies.withColumn("_several", F.lit(True))
        drawn = df.withColumn("_own", own)
        drawn = drawn.join(copies, drawn[quoted(key)].eqNullSafe(copies["_copied"]), "left")
        drawn_by = F.when(F.col("_several"), F.col("_own")).otherwise(drawn_by)
    number = F.conv(F.substring(F.md5(drawn_by), 1, 8), 16, 10).cast("long")
    in_group = Window.partitionBy("megabatch").orderBy(F.col("_length").desc(), name)
    return (
        drawn.withColumns({"megabatch": number % groups, "_length": as_column(length)})
        .withColumn(
            "batch", F.floor((F.row_number().over(in_group) - 1) / F.lit(batch_size)).cast("int")
        )
        .select(*[F.col(quoted(c)) for c in df.columns], "megabatch", "batch")
    )


def pad_batch(
    df: DataFrame,
    batch: Sequence[str],
    ids: str,
    start_id: int | None = None,
    output: str = "labels",
) -> DataFrame:
    """Fill label ids to the longest of their batch with the ignored label.

    If every row of a batch begins with `start_id`, that first id is dropped in all of them.
    After `length_batches` the rows already sit together, so no further shuffle is planned.
    """
    in_batch = Window.partitionBy(*batch)
    column = F.col(ids)
    # an empty label row has no first id and so keeps the batch as it is
    begins = F.coalesce(F.get(column, F.lit(0)) == F.lit(start_id), F.lit(False))
    drop = (F.every(begins) if start_id is not None else F.max(F.lit(False))).over(in_batch)
    marked = df.withColumns({"_longest": F.max(F.size(column)).over(in_batch), "_drop": drop})
    kept = F.when(F.col("_drop"), F.slice(column, 2, F.greatest(F.size(column), F.lit(1))))
    kept = kept.otherwise(column)
    width = F.col("_longest") - F.col("_drop").cast("int")
    padding = F.array_repeat(F.lit(IGNORED_LABEL), width - F.size("_kept"))
    return (
        marked.withColumn("_kept", kept)
        .withColumn(output, F.concat("_kept", padding))
        .drop("_longest", "_drop", "_kept")
    )
