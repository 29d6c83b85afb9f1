"""Random split of exact size without sorting or numbering the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearken.runtime import ColumnLike, as_column

# Hex digits of the hash that each counting step looks at: the first two steps have at most
# 16 ** 4 = 65,536 groups, the last one the hashes that agree in eight digits.
STEPS = (4, 8, 32)


def _hash(key: ColumnLike, seed: int) -> Column:
    text = F.coalesce(as_column(key).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def _at_rank(hashes: DataFrame, rank: int) -> tuple[str, int, int]:
    """The hash of column `h` with this rank, how many of its rows are up to it, and all of them."""
    known, rows = "", 0
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for digits in STEPS:
        known, before, rows = (
            hashes.where(F.col("h").startswith(known))
            .groupBy(F.substring("h", 1, digits).alias("p"))
            .agg(F.count("*").alias("n"))
            .select("p", (F.sum("n").over(upto) - F.col("n")).alias("before"), "n")
            .where((F.col("before") < rank) & (F.col("before") + F.col("n") >= rank))
            .first()
        )
        rank -= before
    return known, rank, rows


def exact_split(
    df: DataFrame,
    key: ColumnLike,
    test_size: float = 0.1,
    seed: int = 42,
    parts: tuple[str, str] = ("train", "test"),
    column: str = "split",
    keep_copies_together: bool = False,
) -> DataFrame:
    """Mark ceil(n * test_size) rows as test, the same ones on every run.

    Rows rank by a seeded hash of their key, those of one key (nulls are one, too) by a hash of
    all their columns; only the cutoff is looked for, by counting hash prefixes in a few passes
    over the key column at once. The rows themselves are only filtered: they are neither
    shuffled nor sorted. If rows that agree in every column lie on the cutoff, the right number
    of them goes to each part. Give a stored table, since it is read more than once.

    With `keep_copies_together` all rows of a key are on one side, and the test part is larger
    than asked for by the copies of the key on the cutoff.
    """
    hashed = _hash(key, seed)
    rank = math.ceil(df.count() * test_size)
    if rank == 0:
        return df.withColumn(column, F.lit(parts[0]))
    cutoff, left, rows = _at_rank(df.select(hashed.alias("h")), rank)

    def marked(is_test: Column, of: DataFrame = df) -> DataFrame:
        return of.withColumn(column, F.when(is_test, parts[1]).otherwise(parts[0]))

    if keep_copies_together or left == rows:
        return marked(hashed <= cutoff)
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    edge, left, rows = _at_rank(df.where(hashed == cutoff).select(whole.alias("h")), left)
    is_test = (hashed < cutoff) | ((hashed == cutoff) & (whole <= edge))
    if left == rows:
        return marked(is_test)
    # rows without any difference: one of them, as often as each part needs it
    on_edge = (hashed == cutoff) & (whole == edge)
    copies = df.sparkSession.range(rows).select(F.lit(1).alias("_one"), (F.col("id") < left).alias("_test"))
    one = df.where(on_edge).limit(1).withColumn("_one", F.lit(1))
    shared = marked(F.col("_test"), one.join(copies, "_one")).drop("_one", "_test")
    return marked(is_test, df.where(~on_edge)).unionByName(shared)
