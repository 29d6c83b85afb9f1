"""Alignment of the tokens of two tokenizers by interval coalescing.

Both tokenizers cover the same bytes. All tokens of A and B are sorted by start; the running
maximum of their ends tells where a group breaks: at a start that reaches it. Within a group the
overlapping pairs of tokens are expanded, at most as many as there are tokens.

No token of either tokenizer reaches over a lone space or line feed, so the groups of a text are
those of its parts between them. Each slice of texts becomes a dictionary of parts, and a part is
encoded and aligned once while its worker knows it; texts take their groups from flat arrays.

What is counted over the corpus goes through small tables: a block of slices lists its distinct
linked pairs once, these are summed by pair, and the sums return to the block that asked.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hearken.llm.common import text_slices
from hearken.llm.units import (
    JOINED_PARTS,
    LedIds,
    Parts,
    Runs,
    add_joined,
    distinct_parts,
    encoder,
    led_parts,
    one_word,
    take,
)

# a block is held by one task as a whole, with all its links: SLICE * SLICES_PER_BLOCK bytes of text
SLICE = 1 << 20
SLICES_PER_BLOCK = 4
MARK = "▁"


def coalesce(
    a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The group of each interval of A and of B: intervals that touch in no inner point part."""
    starts, ends = np.append(a_starts, b_starts), np.append(a_ends, b_ends)
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(order), np.int64)
    group[order[1:]] = np.cumsum(starts[order][1:] >= reach[:-1])
    return group[: len(a_starts)], group[len(a_starts) :]


def overlaps(
    a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of all pairs of intervals that share an inner point, by A.

    Both sides are in order and without overlaps of their own.
    """
    first = np.searchsorted(b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, a_ends, side="left") - first
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return (
        np.repeat(np.arange(len(n)), n),
        np.arange(total) + np.repeat(first - (ends - n), n),
    )


class Spelling:
    """The bytes of each token id."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def same(self, ids: np.ndarray, per_part: np.ndarray, parts: list[bytes]) -> np.ndarray:
        """Of each part, whether the joined bytes of its ids are the part."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        bounds = ends[np.concatenate([[0], np.cumsum(per_part)])]
        spelled = take(self.flat, self.starts[ids], self.lengths[ids])
        same = np.diff(bounds) == sizes
        if same.all():
            differ = np.flatnonzero(spelled != np.frombuffer(b"".join(parts), np.uint8))
            same[np.searchsorted(bounds, differ, side="right") - 1] = False
            return same
        raw = spelled.tobytes()
        for k in np.flatnonzero(same).tolist():
            same[k] = raw[bounds[k] : bounds[k + 1]] == parts[k]
        return same


def byte_level_spelling(vocabulary: dict[str, int]) -> Spelling:
    """Byte-level tokens write each byte as one character: printable ones as themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(byte[c] for c in token)
    return Spelling(tokens)


class PieceIds:
    """Ids of a sentencepiece model that marks a space in front of each text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.lead = np.array([p.startswith(MARK) or p == "<0x0A>" for p in pieces])
        self.spelling = Spelling(
            [
                bytes([int(p[3:5], 16)])
                if re.fullmatch("<0x[0-9A-F]{2}>", p)
                else p.replace(MARK, " ").encode()
                for p in pieces
            ]
        )

    def _ids(self, text: str) -> np.ndarray:
        """Ids of a text whose first space is the model's own, if it begins with one."""
        if text.startswith(" "):
            return np.array(self.model.encode(text[1:]), np.uint32)
        return np.array(self.model.encode(text)[1:], np.uint32)

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        runs = Runs(len(parts), np.uint32)
        texts = [p.decode() for p in parts]
        led, odd = [], []
        for i, text in enumerate(texts):
            plain = text[0] in " \n" and one_word(text[1:]) and MARK not in text
            (led if plain else odd).append(i)
        for k in range(0, len(led), JOINED_PARTS):
            some = led[k : k + JOINED_PARTS]
            ids = self._ids("".join([texts[i] for i in some]))
            if not add_joined(runs, some, ids, np.flatnonzero(self.lead[ids]), 0):
                odd += some
        runs.add_each(odd, [self._ids(texts[i]) for i in odd])
        return runs.done()


_PAIR = 32


class AlignedParts:
    """Alignments of parts: linked id pairs, groups as text, and numbers of each part."""

    LINKS, GROUPS, NUMBERS = 0, 1, 2

    def __init__(self, paths: tuple[str, str]):
        self.a = LedIds(paths[0], plain_specials=True)
        self.a_spelling = byte_level_spelling(self.a.tokenizer.get_vocab(with_added_tokens=False))
        self.b = PieceIds(paths[1])
        self.parts = Parts(self.encode)
        largest = max(len(self.a_spelling.lengths), len(self.b.spelling.lengths))
        self.digits = Spelling([b"%d," % i for i in range(largest)])

    def encode(self, parts: list[bytes]) -> list[tuple]:
        sides, same = [], np.ones(len(parts), bool)
        for ids, spelling in ((self.a, self.a_spelling), (self.b, self.b.spelling)):
            flat, starts, n = ids.encode(parts)
            flat = take(flat, starts, n)
            same &= spelling.same(flat, n, parts)
            sides.append((flat, n, spelling))
        found = []
        for flat, n, spelling in sides:
            flat, n = flat[np.repeat(same, n)], np.where(same, n, 0)
            ends = np.cumsum(spelling.lengths[flat])
            found.append((flat, n, ends - spelling.lengths[flat], ends))
        (a, n_a, a_starts, a_ends), (b, n_b, b_starts, b_ends) = found
        a_group, b_group = coalesce(a_starts, a_ends, b_starts, b_ends)
        i, j = overlaps(a_starts, a_ends, b_starts, b_ends)
        linked = a_ends[i] == b_ends[j]
        i, j = i[linked], j[linked]
        links = (a[i].astype(np.int64) << _PAIR) | b[j]
        a_part = np.repeat(np.arange(len(parts)), n_a)
        n_links = np.bincount(a_part[i], minlength=len(parts))
        begins = np.append(True, np.diff(a_group) > 0)[: len(a)]
        n_groups = np.bincount(a_part[begins], minlength=len(parts))
        text, n_text = self._text(a, b, a_group, b_group, n_a, n_b)
        numbers = np.stack([n_a, n_b, n_groups, n_links, same], axis=1).astype(np.int64)
        width = numbers.shape[1]
        return [
            (links, np.cumsum(n_links) - n_links, n_links),
            (text, np.cumsum(n_text) - n_text, n_text),
            (
                numbers.ravel(),
                np.arange(len(parts)) * width,
                np.full(len(parts), width, np.int64),
            ),
        ]

    def _text(self, a, b, a_group, b_group, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
        """Groups as `a1,a2|b1;`, the bytes of all parts in order and how many each has."""
        side = np.repeat([0, 1], [len(a), len(b)])
        key = np.append(a_group, b_group) * 2 + side
        order = np.argsort(key, kind="stable")
        ids, key = np.append(a, b)[order], key[order]
        lengths = self.digits.lengths[ids]
        text = take(self.digits.flat, self.digits.starts[ids], lengths)
        last = np.flatnonzero(np.append(np.diff(key) > 0, True)) if len(key) else key
        ends = np.cumsum(lengths)
        text[ends[last] - 1] = np.where(key[last] % 2, ord(";"), ord("|"))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        return text, np.diff(bounds)


class BlockPairs:
    """The distinct pairs of a block, numbered as they come, and how often each is linked."""

    def __init__(self):
        self.pairs = np.zeros(0, np.int64)  # sorted
        self.place = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def add(self, links: np.ndarray) -> np.ndarray:
        """Count more links; the place of each."""
        some, inverse, n = np.unique(links, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.pairs, some)
        known = np.zeros(len(some), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == some[inside]
        place = np.empty(len(some), np.int64)
        place[known] = self.place[at[known]]
        fresh = ~known
        place[fresh] = len(self.pairs) + np.arange(np.count_nonzero(fresh))
        self.times = np.append(self.times, np.zeros(np.count_nonzero(fresh), np.int64))
        self.times[place] += n
        self.pairs = np.insert(self.pairs, at[fresh], some[fresh])
        self.place = np.insert(self.place, at[fresh], place[fresh])
        return place[inverse]

    def listed(self) -> np.ndarray:
        out = np.empty(len(self.pairs), np.int64)
        out[self.place] = self.pairs
        return out


ALIGNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "links array<int>, pairs array<long>, times array<long>"
)


def _sums(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    return total[ranges[1:]] - total[ranges[:-1]]


def _led(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after a space, and their row offsets."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    large = lambda x: pa.scalar(x, pa.large_string())
    led = pc.binary_join_element_wise(large(" "), texts, large(""))
    ((_, data, offsets),) = text_slices(led, led.nbytes)
    return data, offsets


def _aligned(a_path: str, b_path: str):
    schema = pa.schema(
        [(n, pa.int64()) for n in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
        + [("groups", pa.string()), ("links", pa.list_(pa.int32()))]
        + [(n, pa.list_(pa.int64())) for n in ("pairs", "times")]
    )

    def work(batches):
        # a block is known by its task and its number; the rows are stored before they are read
        block, slices, pairs = TaskContext.get().partitionId() << 32, 0, BlockPairs()
        for batch in batches:
            for row, _, offsets in text_slices(batch.column("text"), SLICE):
                if slices == SLICES_PER_BLOCK:
                    yield listed(block, pairs)
                    block, slices, pairs = block + 1, 0, BlockPairs()
                some = batch.slice(row, len(offsets) - 1)
                yield one_slice(block, pairs, some.column("doc_id"), *_led(some.column("text")))
                slices += 1
        if slices:
            yield listed(block, pairs)

    def listed(block, pairs):
        cells = {"block": [block], "pairs": [pairs.listed()], "times": [pairs.times]}
        return pa.RecordBatch.from_arrays(
            [pa.array(cells[f.name], f.type) if f.name in cells else pa.nulls(1, f.type) for f in schema],
            schema=schema,
        )

    def one_slice(block, pairs, doc_ids, data, offsets):
        known = encoder(AlignedParts, (a_path, b_path)).parts
        cut, ranges = led_parts(data, offsets)
        distinct, at = distinct_parts(cut)
        at = known.entries(distinct)[at]
        numbers = known.values(AlignedParts.NUMBERS, at)[0].reshape(len(at), -1)
        sums = _sums(numbers, ranges)
        del numbers
        # a text of its leading space alone, or one that its tokens do not spell, has no tokens
        good = (sums[:, -1] == np.diff(ranges)) & (np.diff(offsets) > 1)
        sums[~good] = 0
        at = at[np.repeat(good, np.diff(ranges))]
        ranges = np.concatenate([[0], np.cumsum(np.where(good, np.diff(ranges), 0))])
        links, n = known.values(AlignedParts.LINKS, at)
        link_ends = np.concatenate([[0], np.cumsum(n)])[ranges]
        text, n = known.values(AlignedParts.GROUPS, at)
        text_ends = np.concatenate([[0], np.cumsum(n)])[ranges]
        # without the last separator of each text
        text = np.delete(text, text_ends[1:][good] - 1)
        text_ends -= np.concatenate([[0], np.cumsum(good)])
        place = pairs.add(links)
        groups = pa.Array.from_buffers(
            pa.string(),
            len(doc_ids),
            [None, pa.py_buffer(text_ends.astype(np.int32)), pa.py_buffer(text)],
        )
        n_rows = len(doc_ids)
        nothing = pa.nulls(n_rows, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n_rows, block)),
                doc_ids,
                *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(4)),
                groups,
                pa.ListArray.from_arrays(
                    pa.array(link_ends.astype(np.int32)), pa.array(place.astype(np.int32))
                ),
                nothing,
                nothing,
            ],
            schema=schema,
        )

    return work


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Token alignments of `docs(doc_id, text, ..)`; store the result before it is used twice.

    A is the byte-level BPE in the tokenizers file `a_path`, which gets a space in front of each
    text, B the sentencepiece model `b_path`, which adds it. Special tokens inside texts are
    plain text. Texts come in blocks. One row per row of `docs`: block, doc_id, n_a, n_b,
    n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), links (places in the block's pairs, in the
    order of the text; A and B token end together). One more row per block: block, pairs (A id
    in the upper 32 bits, B id in the lower), times (links of each pair in the block).

    Null or empty texts, and those that the tokens of one side do not spell, have no tokens:
    zeros, empty groups and links. A null doc_id is kept; repeated rows are returned as often;
    an empty table gives an empty result; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_aligned(a_path, b_path), ALIGNED)


def link_counts(aligned: DataFrame) -> DataFrame:
    """`pair`, `b_id`, `n` (links of the pair in all texts), `best` (no pair of the B id has
    more), from stored alignments."""
    pairs = aligned.where("pairs is not null")
    counted = (
        pairs.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.times").alias("n"))
        .withColumn("b_id", F.col("pair").bitwiseAND((1 << _PAIR) - 1))
    )
    most = counted.groupBy("b_id").agg(F.max("n").alias("most"))
    return counted.join(most, "b_id").select(
        "pair", "b_id", "n", (F.col("n") == F.col("most")).alias("best")
    )


def _scored(kept: pa.Table, sums: pa.Table) -> pa.Table:
    # workers are used again: what they know from aligning is not needed here
    encoder.cache_clear()
    n = np.zeros(len(sums), np.int64)
    best = np.zeros(len(sums), np.int64)
    place = sums["place"].to_numpy()
    n[place] = sums["n"].to_numpy()
    best[place] = sums["best"].to_numpy()
    links = kept["links"].combine_chunks()
    flat = links.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
    return kept.drop_columns(["block", "links"]).append_column(
        "n_best", pa.array(_sums(best[flat], ends))
    ).append_column("count_sum", pa.array(_sums(n[flat], ends)))


def link_scores(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of texts in stored alignments, without block and links, with n_best (links whose
    pair is the most frequent of its B id, ties included) and count_sum (counts of the links).

    `counts` are their `link_counts`. A task holds one block: its texts and its pairs.
    """
    texts = kept.where("pairs is null").drop("pairs", "times")
    asked = kept.where("pairs is not null").select(
        F.col("block").alias("asked_by"), F.posexplode("pairs").alias("place", "pair")
    )
    found = asked.join(counts, "pair").select("asked_by", "place", "n", "best")
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema]
    kept_columns = [c for c in columns if c.split()[0] not in ("block", "links")]
    return (
        texts.groupBy("block")
        .cogroup(found.groupBy("asked_by"))
        .applyInArrow(_scored, ", ".join([*kept_columns, "n_best long", "count_sum long"]))
    )
