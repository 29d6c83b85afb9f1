"""Alphabet and character vocabulary of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearken.functions.labels import (
    PADDING,
    UNKNOWN,
    WORD_MARK,
    Vocabulary,
    char_id,
    split_chars,
)
from hearken.runtime import ColumnLike, as_column

MAX_TOKENS = 0x110000 + 2


def distinct_chars(df: DataFrame, text: ColumnLike = "text") -> DataFrame:
    """The set of characters.

    Each text is reduced to its own distinct characters before it is unfolded, and each
    task to its set before anything is shuffled.
    """
    chars = F.array_distinct(split_chars(text))
    return df.select(F.explode(chars).alias("ch")).distinct()


def alphabet(df: DataFrame, text: ColumnLike = "text") -> DataFrame:
    """Characters by code point with their position, `(pos, ch)`.

    Give all rows or only the training part, as the trainer wants it. The set is bounded by
    Unicode, so ordering it in one row is safe.
    """
    ordered = distinct_chars(df, text).agg(F.sort_array(F.collect_set("ch")).alias("chars"))
    return ordered.select(F.posexplode("chars").alias("pos", "ch"))


REJECT, DROP, SPACE = "reject", "drop", "space"


def without_mark(text: ColumnLike, policy: str = REJECT) -> Column:
    """A text without the word mark: `drop` leaves it out, `space` puts a space in its place.

    With `reject` texts stay as they are; `marked_rows` tells whether there is one to reject.
    """
    if policy not in (REJECT, DROP, SPACE):
        raise ValueError(f"policy must be {REJECT!r}, {DROP!r} or {SPACE!r}, got {policy!r}")
    text = as_column(text)
    if policy == REJECT:
        return text
    return F.replace(text, F.lit(WORD_MARK), F.lit("" if policy == DROP else " "))


def marked_rows(df: DataFrame, text: ColumnLike = "text") -> int:
    """How many texts hold the word mark."""
    return df.agg(F.count_if(F.contains(as_column(text), F.lit(WORD_MARK)))).first()[0]


def ctc_vocab(df: DataFrame, text: ColumnLike = "text", policy: str = REJECT) -> DataFrame:
    """Vocabulary `(ch, id)`: characters by code point, the space as `|`, then two specials.

    A text without any space still gets the mark, at the end. A literal `|` in the texts
    would share the mark's id and is refused, or treated by the `policy` of `without_mark`.
    """
    chars = distinct_chars(df, without_mark(text, policy))
    checked = F.when(
        F.col("ch") == WORD_MARK,
        F.raise_error(F.lit(f"the corpus holds the word mark {WORD_MARK!r}")).cast("string"),
    ).otherwise(F.col("ch"))
    ordered = chars.agg(F.sort_array(F.collect_set(checked)).alias("chars"))
    marked = F.transform("chars", lambda c: F.when(c == " ", WORD_MARK).otherwise(c))
    with_mark = F.when(F.array_contains("chars", " "), marked).otherwise(
        F.array_append("chars", F.lit(WORD_MARK))
    )
    tokens = F.concat(with_mark, F.array(F.lit(UNKNOWN), F.lit(PADDING)))
    return ordered.select(F.posexplode(tokens).alias("id", "ch")).select("ch", "id")


def collect_vocab(vocab: DataFrame) -> dict[str, int]:
    """The vocabulary table as a mapping, for the label functions.

    Characters and two specials cannot outnumber Unicode; more rows mean a wrong table.
    """
    rows = vocab.select("ch", "id").limit(MAX_TOKENS + 1).collect()
    if len(rows) > MAX_TOKENS:
        raise ValueError("more rows than Unicode has characters: not a vocabulary")
    return {r["ch"]: r["id"] for r in rows}


def lookup_ids(chars: DataFrame, vocab: Vocabulary, ch: str = "ch") -> DataFrame:
    """Ids for a table of characters, unknown ones as `[UNK]`.

    The vocabulary is a lookup array, so no row is shuffled and no join is planned.
    """
    return chars.withColumn("id", char_id(ch, vocab))
