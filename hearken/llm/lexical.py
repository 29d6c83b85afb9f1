"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks. A block is a bit matrix: one row per signature position, one
bit per document. A document sets the positions of its terms, and of "term at least 2, 4, 8, ..
times", so the rows of a term, combined by AND, tell which documents may hold it and bound how
often: never too low, sometimes too high. The signature of a block is as long as its documents
need; documents of like size share a block.

A search adds, for each item and each document of a block, the weights of the terms whose bits
are set, times the most that so many occurrences can score in a document of that length. These
sums are upper bounds. The ten documents of the highest bounds are scored exactly; the tenth
score excludes every document whose bound is below it, and all others are scored exactly.

The items are the stated query set. They are searched in blocks of a fixed number; what a task
gets of them is the terms of one block of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearken.llm.common import IS_PUNCTUATION, mix, stored, text_slices, word_hashes

SLICE = 1 << 23
ITEMS = 512
HASHES = 5
BITS_PER_TERM = 16
MOST_POSITIONS = 1 << 22
LEVEL = np.uint64(0x9FB21C651E98DF25)

INDEX = "positions long, names array<long>, terms array<long>, bits binary"


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) of a slice by row, and how often the row holds the term.

    A term is the 64-bit hash of its bytes with A-Z in lower case.
    """
    hashed, ranges = word_hashes(data, offsets, IS_PUNCTUATION)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(ranges))
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], hashed[at], np.diff(np.append(at, len(row)))


def positions(terms: np.ndarray, level: int, n: int) -> np.ndarray:
    """HASHES signature positions below `n` (a power of two) for each term at a level."""
    with np.errstate(over="ignore"):
        mixed = mix(terms + LEVEL * np.uint64(level + 1))
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        k = np.arange(HASHES, dtype=np.uint64)[:, None]
        return ((mixed + k * step) & np.uint64(n - 1)).astype(np.int64)


def signature_length(n_terms: np.ndarray) -> np.ndarray:
    wanted = np.maximum(BITS_PER_TERM * n_terms, 64)
    return np.minimum(1 << np.ceil(np.log2(wanted)).astype(np.int64), MOST_POSITIONS)


def _blocks(batches):
    for batch in batches:
        for first, data, offsets in text_slices(batch.column("text"), SLICE):
            row, term, times = term_runs(data, offsets)
            n_rows = len(offsets) - 1
            if not len(row):
                continue
            n_terms = np.bincount(row, weights=times, minlength=n_rows).astype(np.int64)
            # a term is set once for each power of two up to its count
            levels = np.frexp(times)[1].astype(np.int64)
            length = signature_length(np.bincount(row, weights=levels, minlength=n_rows))
            for n in np.unique(length[n_terms > 0]).tolist():
                own = np.flatnonzero((length == n) & (n_terms > 0))
                place = np.full(n_rows, -1)
                place[own] = np.arange(len(own))
                inside = place[row] >= 0
                bits = np.zeros((n, len(own)), bool)
                for level in range(int(levels[inside].max())):
                    some = inside & (levels > level)
                    bits[positions(term[some], level, n), place[row[some]]] = True
                names = batch.column("name").take(pa.array(first + own)).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n]),
                        pa.array([names], pa.list_(pa.int64())),
                        pa.array([n_terms[own]], pa.list_(pa.int64())),
                        pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()),
                    ],
                    ["positions", "names", "terms", "bits"],
                )


def named(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that may hold a term; a text is found again by its name, a hash."""
    return docs.where("text <> ''").select("doc_id", F.xxhash64("text").alias("name"), "text")


def signature_index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures of `docs(doc_id, text, ..)`; store them before use.

    Documents without a term (null, empty, marks only) are in no block. Repeated rows are
    indexed as often; an empty table gives no block. Signatures have at most
    MOST_POSITIONS positions: beyond about 260,000 terms in a text its bounds only get looser.
    """
    return named(docs).mapInArrow(_blocks, INDEX)


@dataclass(frozen=True)
class Items:
    """A block of items: sorted distinct terms, and of each item its terms and repeats."""

    ids: list
    terms: np.ndarray
    own: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        column = pa.array([text for _, text in rows], pa.string())
        found = [[], [], []]
        for first, data, offsets in text_slices(column):
            row, term, times = term_runs(data, offsets)
            for all_, some in zip(found, (row + first, term, times), strict=True):
                all_.append(some)
        row, term, times = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found)
        terms = np.unique(term).astype(np.uint64)
        at = np.searchsorted(terms, term)
        inside = [row == k for k in range(len(rows))]
        return cls(
            [i for i, _ in rows],
            terms,
            [at[x] for x in inside],
            [times[x].astype(np.int64) for x in inside],
        )

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and their places."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashed), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == hashed)
        return hit, at[hit]


def item_blocks(items: DataFrame, size: int) -> Iterator[Items]:
    """The query set, `size` items at a time, in the order of their ids."""
    block = []
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == size:
            yield Items.of(block)
            block = []
    if block:
        yield Items.of(block)


def _statistics(items: Items):
    """Partial counts: (-2, documents with a term), (-1, all terms), (term, documents with it)."""

    def work(batches):
        totals = np.zeros(len(items.terms) + 2, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column("text"), SLICE):
                hashed, ranges = word_hashes(data, offsets, IS_PUNCTUATION)
                hit, at = items.find(hashed)
                # each term once for each document
                row = np.searchsorted(ranges, hit, side="right") - 1
                at = np.unique(row * len(items.terms) + at) % max(len(items.terms), 1)
                totals[:-2] += np.bincount(at, minlength=len(items.terms))
                totals[-2] += np.count_nonzero(np.diff(ranges))
                totals[-1] += len(hashed)
        some = np.flatnonzero(totals)
        place = np.where(some < len(items.terms), some, some - len(totals))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(totals[some])], ["place", "n"])

    return work


@dataclass(frozen=True)
class Weights:
    """Corpus counts for a block of items."""

    n_docs: int
    n_terms: int
    weight: np.ndarray

    @classmethod
    def of(cls, docs: DataFrame, items: Items) -> Weights:
        # at most one row per term of the block of items
        counted = (
            named(docs)
            .select("text")
            .mapInArrow(_statistics(items), "place long, n long")
            .groupBy("place")
            .agg(F.sum("n").alias("n"))
            .collect()
        )
        n = dict(map(tuple, counted))
        n_docs = n.get(-2, 0)
        held = [n.get(k, 0) for k in range(len(items.terms))]
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in held]
        return cls(n_docs, n.get(-1, 0), np.array(weight, np.int64))

    def length_part(self, terms: np.ndarray) -> np.ndarray:
        return 25 + (75 * terms * self.n_docs) // max(self.n_terms, 1)


def saturated(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 scores; it never falls with `times`."""
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def upper_bounds(items: Items, weights: Weights, block: dict) -> np.ndarray:
    """Of each item (row) and document (column) of an index block, a score never exceeded.

    Weights are never negative (no term is in more documents than there are), so more
    occurrences never lower the sum.
    """
    n_docs, n = len(block["terms"]), block["positions"]
    bits = np.frombuffer(block["bits"], np.uint8).reshape(n, -1)
    m = weights.length_part(block["terms"])
    bounds = np.zeros((len(items.ids), n_docs), np.int64)
    alive = np.arange(len(items.terms))
    present = np.full((len(alive), bits.shape[1]), 255, np.uint8)
    level, below = 0, np.zeros(n_docs, np.int64)
    while len(alive):
        for rows in positions(items.terms[alive], level, n):
            present &= bits[rows]
        some = present.any(axis=1)
        alive, present = alive[some], present[some]
        # held at least 2^level times, so at most 2^(level + 1) - 1 unless the next one is set
        most = saturated(np.full(n_docs, (2 << level) - 1), m)
        place = np.full(len(items.terms), -1)
        place[alive] = np.arange(len(alive))
        for k, (own, repeats) in enumerate(zip(items.own, items.repeats, strict=True)):
            at = place[own]
            held = at >= 0
            if not held.any():
                continue
            worth = (weights.weight[own[held]] * repeats[held]).astype(np.float64)
            shown = np.unpackbits(present[at[held]], axis=1, count=n_docs)
            bounds[k] += (worth @ shown).astype(np.int64) * (most - below)
        below = most
        level += 1
    return bounds


def index_blocks(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {
                "positions": batch.column("positions")[k].as_py(),
                "names": batch.column("names")[k].values.to_numpy(),
                "terms": batch.column("terms")[k].values.to_numpy(),
                "bits": batch.column("bits")[k].as_buffer(),
            }


CANDIDATES = "item long, name long, bound long"


def candidate_batch(item: np.ndarray, name: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(x) for x in (item, name, bound)]
    return pa.RecordBatch.from_arrays(columns, ["item", "name", "bound"])


def highest(kept: list[tuple], top: int) -> tuple:
    """The `top` of each item by bound."""
    item, name, bound = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((-bound, item))
    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    order = order[rank < top]
    return item[order], name[order], bound[order]


def _best(items: Items, weights: Weights, top: int):
    """Of each task and item, the `top` documents of the highest bounds."""

    def work(batches):
        kept: list[tuple] = []
        for block in index_blocks(batches):
            for k, bound in enumerate(upper_bounds(items, weights, block)):
                best = np.argsort(-bound)[:top]
                best = best[bound[best] > 0]
                kept.append((np.full(len(best), k), block["names"][best], bound[best]))
            kept = [highest(kept, top)]
        if kept:
            yield candidate_batch(*kept[0])

    return work


def _reaching(items: Items, weights: Weights, least: np.ndarray):
    """All documents whose bound does not exclude them."""

    def work(batches):
        for block in index_blocks(batches):
            bounds = upper_bounds(items, weights, block)
            item, doc = np.nonzero(bounds >= least[:, None])
            yield candidate_batch(item, block["names"][doc], bounds[item, doc])

    return work


def _exact(items: Items, weights: Weights):
    """The scores of texts for the items they are candidates of."""

    def work(batches):
        for batch in batches:
            doc_ids, wanted = batch.column("doc_id"), batch.column("items")
            out: list[tuple] = []
            for first, data, offsets in text_slices(batch.column("text"), SLICE):
                hashed, ranges = word_hashes(data, offsets, IS_PUNCTUATION)
                hit, at = items.find(hashed)
                bounds = np.searchsorted(hit, ranges)
                m = weights.length_part(np.diff(ranges))
                for k in range(len(offsets) - 1):
                    times = np.bincount(at[bounds[k] : bounds[k + 1]], minlength=len(items.terms))
                    worth = weights.weight * saturated(times, m[k])
                    for item in wanted[first + k].as_py():
                        score = int((worth[items.own[item]] * items.repeats[item]).sum())
                        out.append((item, items.ids[item], doc_ids[first + k].as_py(), score))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns], ["item", "item_id", "doc_id", "score"]
            )

    return work


def _top(scored: DataFrame, top: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def _scored(docs: DataFrame, candidates: DataFrame, items: Items, weights: Weights) -> DataFrame:
    """Exact scores of all rows of `docs` whose text is a candidate, one row per item."""
    wanted = candidates.groupBy("name").agg(F.collect_set("item").alias("items"))
    texts = named(docs).join(stored(wanted, "candidates"), "name")
    return texts.select("doc_id", "text", "items").mapInArrow(
        _exact(items, weights), "item long, item_id long, doc_id long, score long"
    )


def _search_block(docs: DataFrame, index: DataFrame, items: Items, top: int) -> DataFrame:
    weights = Weights.of(docs, items)
    by_score = [F.desc("score"), F.asc("doc_id")]
    best = index.mapInArrow(_best(items, weights, top), CANDIDATES)
    likely = _scored(docs, _top(best, top, F.desc("bound"), "name"), items, weights)
    least = np.ones(len(items.ids), np.int64)
    # one row per item of the block
    for r in (
        _top(likely, top, *by_score)
        .groupBy("item")
        .agg(F.count("score").alias("n"), F.min("score").alias("score"))
        .where(F.col("n") == top)
        .collect()
    ):
        least[r["item"]] = max(1, r["score"])
    candidates = index.mapInArrow(_reaching(items, weights, least), CANDIDATES)
    scored = _scored(docs, candidates, items, weights).where("score > 0")
    return _top(scored, top, *by_score).select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 10, index: DataFrame | None = None
) -> DataFrame:
    """The `top` rows of `docs(doc_id, text, ..)` for each row of `items(item_id, text, ..)`.

    Returns item_id, rank (from 1), doc_id, score: highest score first, equal scores by
    ascending doc_id (null first); rows that score 0 are left out. `index` is a stored
    `signature_index` of the same rows; without one it is made.

    Null or empty texts, on either side, have no terms and are in no result. Repeated rows of
    `docs` rank one after the other, repeated items are answered as often. Empty tables give an
    empty result; other columns are ignored. Terms are told apart by 64-bit hashes.
    """
    if index is None:
        index = stored(signature_index(docs), "signatures")
    result = None
    for block in item_blocks(items, ITEMS):
        found = _search_block(docs, index, block, top)
        result = found if result is None else result.unionByName(found)
    if result is None:
        empty = "item_id long, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], empty)
    return result
