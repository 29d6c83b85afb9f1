"""Greedy decoding of frame labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearken.functions.labels import Vocabulary, ids_to_text
from hearken.functions.text import strip_lower
from hearken.runtime import ColumnLike, as_column

FRAMES_PER_RUN = 4096


def ctc_greedy_decode(
    frames: DataFrame,
    vocab: Vocabulary,
    blank_id: int,
    token: ColumnLike,
    key: str = "utt_id",
    frame: str = "frame_no",
    output: str = "text",
    frames_per_run: int = FRAMES_PER_RUN,
) -> DataFrame:
    """Text per utterance from the best label of each frame.

    Repeats are merged first, then blanks dropped, the word mark becomes a space. Frames are
    merged in runs of bounded size before an utterance comes together, and a run's first
    label is dropped where it continues the run before. An all-blank utterance stays, as ''.
    """
    best = frames.select(
        F.col(key).alias("_key"),
        F.expr(f"`{frame}` div {frames_per_run}").alias("_run"),
        F.struct(F.col(frame).alias("f"), as_column(token).cast("int").alias("id")).alias("_x"),
    )
    runs = best.groupBy("_key", "_run").agg(F.array_sort(F.collect_list("_x")).alias("x"))

    def changed(x: Column, i: Column) -> Column:
        return (i == 0) | (x["id"] != F.get("x", i - 1)["id"])

    merged = runs.select(
        "_key",
        F.struct(
            F.col("_run").alias("run"),
            F.try_element_at("x", F.lit(1))["id"].alias("first"),
            F.try_element_at("x", F.lit(-1))["id"].alias("last"),
            F.transform(F.filter("x", changed), lambda x: x["id"]).alias("ids"),
        ).alias("_part"),
    )
    whole = merged.groupBy("_key").agg(F.array_sort(F.collect_list("_part")).alias("p"))

    def without_repeat(part: Column, i: Column) -> Column:
        continues = (i > 0) & (F.get("p", i - 1)["last"] == part["first"])
        return F.when(continues, F.slice(part["ids"], 2, F.size(part["ids"]))).otherwise(
            part["ids"]
        )

    ids = F.filter(F.flatten(F.transform("p", without_repeat)), lambda i: i != blank_id)
    return whole.select(
        F.col("_key").alias(key), strip_lower(ids_to_text(ids, vocab)).alias(output)
    )
