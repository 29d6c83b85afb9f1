"""Character labels: text to ids, ids to text, scores to ids.

A vocabulary maps single characters and two special tokens to ids, so Unicode itself bounds
it. It enters a query as a constant lookup table: no join, and one step per character
however large the alphabet is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from hearken.runtime import ColumnLike, as_column

Vocabulary = Mapping[str, int]

# Fixed values of the label format.
WORD_MARK = "|"
UNKNOWN = "[UNK]"
PADDING = "[PAD]"
IGNORED_LABEL = -100


def split_chars(text: ColumnLike) -> Column:
    """Characters of a text; an empty text has none."""
    text = as_column(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


PAGE_BITS = 8
PAGE = 1 << PAGE_BITS


def page_table(vocab: Vocabulary) -> tuple[list[int], list[int]]:
    """Ids by code point in two levels: the page of each run of 256 code points, and the pages.

    Only runs with a known character have a page of their own; all others share page 0, which
    holds the unknown id. The pages come one after the other in one list.
    """
    by_code = {ord(ch): i for ch, i in vocab.items() if len(ch) == 1}
    # the space is written as the word mark
    by_code[ord(" ")] = vocab[WORD_MARK]
    used = sorted({code >> PAGE_BITS for code in by_code})
    page_of = [0] * (max(used) + 1)
    ids = [vocab[UNKNOWN]] * (PAGE * (len(used) + 1))
    for place, run in enumerate(used, 1):
        page_of[run] = place
    for code, i in by_code.items():
        ids[page_of[code >> PAGE_BITS] * PAGE + code % PAGE] = i
    return page_of, ids


def _constant(values: Sequence[int]) -> Column:
    # one literal, folded to an array by the optimizer
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def char_id(ch: ColumnLike, vocab: Vocabulary) -> Column:
    """Id of one character, unknown ones get the id of `[UNK]`."""
    page_of, ids = map(_constant, page_table(vocab))
    code = F.ascii(as_column(ch))
    page = F.coalesce(F.get(page_of, F.shiftright(code, PAGE_BITS)), F.lit(0))
    return F.coalesce(F.get(ids, page * PAGE + code % PAGE), F.lit(vocab[UNKNOWN]))


def encode_chars(text: ColumnLike, vocab: Vocabulary) -> Column:
    """Text as an array of character ids; null stays null.

    An Arrow batch is looked up in pieces of `PIECE_BYTES`: their bytes become code points, these
    go through the two levels of `page_table` by index. Per character this was measured faster
    than a lookup in a lambda, and the constant grows by a page for each run of characters in use.
    """
    page_of, ids = page_table(vocab)
    # beyond the last page everything is unknown
    page_of = [*page_of, 0]

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _batch_ids(texts, page_of, ids)

    return encode(as_column(text))


# working space for one piece is some forty times this, whatever the batch or the text
PIECE_BYTES = 1 << 18


def _batch_ids(texts: pa.Array, page_of: Sequence[int], ids: Sequence[int]) -> pa.Array:
    import numpy as np

    first, known = np.array(page_of, np.int32), np.array(ids, np.int32)
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)
    offsets = offsets[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # no text has more characters than bytes; what is left over is never touched
    found = np.empty(len(data), np.int32)
    bounds = np.zeros(len(offsets), np.int32)
    low = done = 0
    while low < len(data):
        high = min(low + PIECE_BYTES, len(data))
        # a character begins at each byte that continues none; no piece ends within one
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        piece = data[low:high]
        codes = np.frombuffer(piece.tobytes().decode().encode("utf-32-le"), np.uint32)
        page = first[np.minimum(codes >> PAGE_BITS, len(first) - 1)]
        found[done : done + len(codes)] = known[page * PAGE + (codes % PAGE).astype(np.int32)]
        begun = np.cumsum((piece & 0xC0) != 0x80, dtype=np.int32)
        # texts that end in this piece
        some = slice(*np.searchsorted(offsets, [low, high], side="right"))
        bounds[some] = done + begun[offsets[some] - low - 1]
        low, done = high, done + len(codes)
    marked = pa.array(bounds, mask=np.append(_nulls(texts), False))
    return pa.ListArray.from_arrays(marked, pa.array(found[:done]))


def _nulls(values: pa.Array):
    return values.is_null().to_numpy(zero_copy_only=False)


def ids_to_text(ids: ColumnLike, vocab: Vocabulary) -> Column:
    """Ids back to text: word marks become spaces, special and unknown ids vanish."""
    by_id = {i: ch for ch, i in vocab.items() if len(ch) == 1}
    table = F.array(*[F.lit(by_id.get(i)).cast("string") for i in range(max(by_id) + 1)])
    # array_join leaves out nulls, which is how specials disappear
    joined = F.array_join(F.transform(as_column(ids), lambda i: F.get(table, i)), "")
    return F.translate(joined, WORD_MARK, " ")


def unmask_decode(labels: ColumnLike, vocab: Vocabulary) -> Column:
    """Padded label ids back to text; the ignored label stands for padding."""
    padding = F.lit(vocab[PADDING])
    ids = F.transform(
        as_column(labels), lambda i: F.when(i == IGNORED_LABEL, padding).otherwise(i)
    )
    return ids_to_text(ids, vocab)


def argmax(scores: ColumnLike) -> Column:
    """Index of the largest score, the first one on ties."""
    scores = as_column(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
