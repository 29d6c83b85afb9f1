"""Choosing among training runs and checkpoints, comparing speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def best_run(
    log: DataFrame,
    run: str = "run",
    step: str = "step",
    metric: str = "wer",
    greater_is_better: bool = False,
) -> DataFrame:
    """Best step of each run with its metric; the earliest step on ties.

    Missing and not-a-number metrics never win. First each run's best metric is found, then the
    least step among those that reach it. Both are aggregates of single numbers, which are
    combined in hash tables before the shuffle, so that no row of the log is sorted for it.
    """
    value = F.col(metric)
    seen = log.where(value.isNotNull() & ~F.isnan(value.cast("double"))).select(
        F.col(run).alias("_run"), F.col(step).alias("_step"), value.alias("_metric")
    )
    best = F.max("_metric") if greater_is_better else F.min("_metric")
    reached = seen.groupBy("_run").agg(best.alias("_best"))
    reached = reached.select(F.col("_run").alias("_of"), "_best")
    same = seen["_run"].eqNullSafe(reached["_of"]) & (seen["_metric"] == reached["_best"])
    return (
        seen.join(reached, same)
        .groupBy("_run")
        .agg(F.min("_step").alias("best_step"), F.min("_best").alias("best_metric"))
        .withColumnRenamed("_run", run)
    )


def latest_checkpoint(names: DataFrame, name: str = "name") -> DataFrame:
    """The checkpoint with the greatest step number, compared as a number of up to 38 digits.

    A name ends in a dash and the number; others are not checkpoints. `step` is null where the
    number is larger than a long holds.
    """
    step = F.regexp_extract(name, r"-(\d+)$", 1).try_cast("decimal(38,0)")
    last = F.max(F.struct(step.alias("step"), F.col(name).alias("name")))
    return (
        names.where(F.col(name).rlike(r"^checkpoint-(?:.*-)?\d+$"))
        .agg(last.alias("last"))
        .select("last.name", F.col("last.step").try_cast("long").alias("step"))
    )


def latency_compare(
    df: DataFrame, base: str, other: str, system: str = "system", seconds: str = "seconds"
) -> DataFrame:
    """Mean seconds of two systems and how many times faster the other one is."""

    def mean_of(label: str):
        return F.avg(F.when(F.col(system) == label, F.col(seconds)))

    return df.where(F.col(system).isin(base, other)).agg(
        mean_of(base).alias("base_seconds"), mean_of(other).alias("other_seconds")
    ).withColumn("speedup", F.try_divide("base_seconds", "other_seconds"))
