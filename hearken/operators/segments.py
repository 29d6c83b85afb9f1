"""Ordered pieces of text joined per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hearken.functions.prompts import generation_prompt, tagged_turn
from hearken.functions.text import strip
from hearken.runtime import ColumnLike, as_column

CHUNK = 1024


def ordered_concat(
    df: DataFrame, key: str, order: str, text: ColumnLike, output: str, chunk: int | None = CHUNK
) -> DataFrame:
    """Pieces of each key in `order`, without a separator. Null pieces are left out.

    The order must be an integer: pieces are joined in runs of `chunk` first, so the many
    pieces of one busy key are sorted and joined by many tasks and its last step sees one
    piece per run.
    """
    pieces = df.select(
        F.col(key).alias("_key"), F.col(order).alias("_order"), as_column(text).alias("_text")
    )
    joined = F.expr("listagg(_text, '') within group (order by _order, _text)").alias("_text")
    if chunk:
        if not isinstance(df.schema[order].dataType, T.IntegralType):
            raise TypeError(f"{order!r} must be an integer column")
        pieces = (
            pieces.groupBy("_key", F.expr(f"_order div {chunk}").alias("_run"))
            .agg(joined)
            .withColumnRenamed("_run", "_order")
        )
    return pieces.groupBy("_key").agg(joined).select(
        F.col("_key").alias(key), F.coalesce("_text", F.lit("")).alias(output)
    )


def join_segments(
    df: DataFrame,
    key: str = "utt_id",
    order: str = "seg_no",
    text: ColumnLike = "text",
    output: str = "text",
    chunk: int | None = CHUNK,
) -> DataFrame:
    """Segments of an utterance as one trimmed text."""
    joined = ordered_concat(df, key, order, text, output, chunk)
    return joined.withColumn(output, strip(output))


def render_turns(
    df: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    role: ColumnLike = "role",
    content: ColumnLike = "text",
    output: str = "prompt",
    add_generation_prompt: bool = True,
) -> DataFrame:
    """Prompt string per conversation from a table of turns."""
    joined = ordered_concat(df, key, order, tagged_turn(role, content), output)
    if not add_generation_prompt:
        return joined
    end: Column = F.concat(F.col(output), F.lit(generation_prompt()))
    return joined.withColumn(output, end)
