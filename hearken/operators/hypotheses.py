"""Outputs of several systems brought together per utterance."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from hearken.runtime import quoted


def assemble_hypotheses(
    refs: DataFrame, hyps: DataFrame, systems: Sequence[str], key: str = "utt_id"
) -> DataFrame:
    """One row per utterance with a column per system.

    `hyps` is long, `(key, system, hyp)`. An utterance one system failed on is dropped for
    all of them. Two different hypotheses of one system for an utterance are an error; equal
    ones are one. Rows are dealt by key first, so the one sort that texts need in an aggregate
    is done once, after the one shuffle.
    """
    known = hyps.where(F.col("system").isin(*systems)).repartition(quoted(key))

    def only(system: str) -> Column:
        said = F.when(F.col("system") == system, F.col("hyp"))
        problem = F.concat(
            F.lit(f"system {system!r} has several hypotheses for "), F.col(quoted(key)).cast("string")
        )
        return F.when(F.min(said) == F.max(said), F.min(said)).when(
            F.min(said).isNotNull(), F.raise_error(problem).cast("string")
        )

    wide = known.groupBy(quoted(key)).agg(*[only(s).alias(s) for s in systems])
    complete = reduce(and_, [F.col(quoted(s)).isNotNull() for s in systems])
    return refs.join(wide.where(complete), key)


def attach_outputs(df: DataFrame, outputs: DataFrame, key: str = "utt_id") -> DataFrame:
    """Batch outputs back on their rows, by key."""
    return df.join(outputs, key)
