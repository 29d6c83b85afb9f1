"""Alphabet and vocabulary files. Both are bounded by the number of Unicode characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLANK = "_"


def write_alphabet(
    alphabet: DataFrame, path: str, extra_space: bool = False, mode: str = "overwrite"
) -> None:
    """One character per line: the blank first, then the alphabet `(pos, ch)` in order.

    `extra_space` repeats the space in a last line, as some trainers expect.
    """
    lines = alphabet.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]
        ).alias("chars")
    )
    ends = F.array(F.lit(" ")) if extra_space else F.array().cast("array<string>")
    values = F.concat(F.array(F.lit(BLANK)), F.col("chars"), ends)
    # the single aggregate row is one partition already, so the lines keep their order
    lines.select(F.explode(values).alias("value")).write.mode(mode).text(path)


def write_vocab_json(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object from character to id, in id order, characters unescaped."""
    entries = F.array_sort(F.collect_list(F.struct("id", "ch")))
    as_map = F.map_from_entries(F.transform(entries, lambda x: F.struct(x["ch"], x["id"])))
    vocab.agg(F.to_json(as_map).alias("value")).write.mode(mode).text(path)
