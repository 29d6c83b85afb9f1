"""Benchmark decontamination by greedy string tiling.

Documents that share a seed (a run of SEED tokens) with a benchmark item are compared with it
token by token: the longest match that touches no marked token is marked in both, again and
again, until none of SEED tokens is left (running Karp-Rabin matching, Wise 1993). The share of
the item's tokens that the tiles cover does not depend on the order of its parts, so reordered
passages count in full.

Seeds are found by their rolling hashes. A bitmap of fixed size over the items' seeds leaves
almost only documents that share one; these are then joined with the seeds themselves.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearken.llm.common import IS_PUNCTUATION, mix, stored, text_slices, word_hashes

SEED = 5
BITMAP_BITS = 1 << 24
_STEP = np.uint64(0xA0761D6478BD642F)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of a slice, letters and digits only; for each row the range of its own."""
    return word_hashes(data, offsets, IS_PUNCTUATION)


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    value = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        value = value * _STEP + words[k : k + len(value)]
    return mix(value)


def _bits(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = seeds & np.uint64(BITMAP_BITS - 1)
    high = (seeds >> np.uint64(32)) & np.uint64(BITMAP_BITS - 1)
    return low.astype(np.int64), high.astype(np.int64)


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length), longest first, none overlapping another."""
    if len(item) < least or len(doc) < least:
        return []
    at = defaultdict(list)
    for i, seed in enumerate(rolled(item, least).tolist()):
        at[seed].append(i)
    seeds = rolled(doc, least)
    known = np.fromiter(at, np.uint64, len(at))
    heap = []
    running: dict[int, list[int]] = {}
    # seeds one after the other on a diagonal are one match
    for j in np.flatnonzero(np.isin(seeds, known)).tolist():
        for i in at[int(seeds[j])]:
            match = running.get(j - i)
            if match and match[1] + match[2] - least + 1 == j:
                match[2] += 1
            else:
                if match:
                    heap.append((-match[2], match[0], match[1]))
                running[j - i] = [i, j, least]
    heap += [(-m[2], m[0], m[1]) for m in running.values()]
    heapq.heapify(heap)
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        free = free_item[i : i + length] & free_doc[j : j + length]
        if free.all():
            free_item[i : i + length] = False
            free_doc[j : j + length] = False
            tiles.append((i, j, length))
            continue
        # parts that no longer match tile touches wait for their turn by length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def _item_seeds(width: int):
    def work(batches):
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for row, data, offsets in text_slices(batch.column("text")):
                words, ranges = tokens(data, offsets)
                for k, (a, b) in enumerate(zip(ranges[:-1], ranges[1:], strict=True)):
                    seeds = np.unique(rolled(words[a:b], width))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[row + k]] * len(seeds), pa.int64()),
                            pa.array(seeds.view(np.int64)),
                            *(pa.array(x) for x in _bits(seeds)),
                        ],
                        ["item_id", "seed", "low", "high"],
                    )

    return work


def _doc_hits(width: int, bitmap):
    def work(batches):
        seen = bitmap.value
        for batch in batches:
            texts = batch.column("text")
            for row, data, offsets in text_slices(texts):
                words, ranges = tokens(data, offsets)
                seeds = rolled(words, width)
                low, high = _bits(seeds)
                hit = np.flatnonzero(seen[low] & seen[high])
                if not len(hit):
                    continue
                owner = np.searchsorted(ranges, hit, side="right") - 1
                inside = hit + width <= ranges[owner + 1]
                hit, owner = hit[inside], owner[inside]
                for k in np.unique(owner).tolist():
                    found = np.unique(seeds[hit[owner == k]]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(row + k, 1),
                            texts.slice(row + k, 1),
                            pa.array([found], pa.list_(pa.int64())),
                        ],
                        ["doc_id", "text", "seeds"],
                    )

    return work


def _tile(width: int):
    def words_of(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return tokens(raw, np.array([0, len(raw)]))[0]

    def work(frames):
        for frame in frames:
            out = []
            for item_text, text in zip(frame["item_text"], frame["text"], strict=True):
                item = words_of(item_text)
                tiles = greedy_tiles(item, words_of(text), width)
                out.append((len(item), sum(t[2] for t in tiles), len(tiles)))
            yield pd.DataFrame(
                {
                    "name": frame["name"],
                    "item_id": frame["item_id"],
                    "item_tokens": [x[0] for x in out],
                    "covered_tokens": [x[1] for x in out],
                    "n_tiles": [x[2] for x in out],
                }
            )

    return work


def seed_bitmap(seeds: DataFrame):
    """BITMAP_BITS flags (2 MiB packed), whatever the number of items: set for each seed."""
    bits = seeds.select(F.explode(F.array("low", "high")).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("flags")
    )
    packed = np.zeros(BITMAP_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        packed[row.word] = row.flags
    return np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, width: int = SEED
) -> DataFrame:
    """Pairs of `docs(doc_id, text, ..)` and `benchmark(item_id, text, ..)` that leak.

    Returns doc_id, item_id, item_tokens, covered_tokens, n_tiles, coverage and name (SHA-256 of
    the document's text) for each pair whose tiles of at least `width` tokens cover at least `coverage` of the item. Tokens are runs of
    letters and digits, A-Z in lower case.

    Null and empty texts and items of fewer than `width` tokens match nothing; rows that repeat
    and null ids give rows of their own; empty tables give an empty result; other columns are
    ignored. Copies of a text are compared once.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    seeds = stored(
        items.mapInArrow(_item_seeds(width), "item_id long, seed long, low long, high long"),
        "seeds",
    )
    bitmap = spark.sparkContext.broadcast(seed_bitmap(seeds))
    hits = stored(
        docs.select("doc_id", "text")
        .mapInArrow(_doc_hits(width, bitmap), "doc_id long, text string, seeds array<long>")
        .withColumn("name", F.sha2("text", 256)),
        "hits",
    )
    texts = hits.select("name", "text").dropDuplicates(["name"])
    pairs = (
        hits.select("name", "seeds")
        .dropDuplicates(["name"])
        .select("name", F.explode("seeds").alias("seed"))
        .join(seeds.select("seed", "item_id"), "seed")
        .select("name", "item_id")
        .distinct()
    )
    tiled = (
        pairs.join(texts, "name")
        .join(
            items.select(F.col("item_id").alias("id"), F.col("text").alias("item_text")),
            F.col("item_id").eqNullSafe(F.col("id")),
        )
        .repartition("name", "item_id")
        .mapInPandas(
            _tile(width),
            "name string, item_id long, item_tokens long, covered_tokens long, n_tiles long",
        )
        .withColumn("coverage", F.expr("covered_tokens / item_tokens"))
        .where(F.col("coverage") >= coverage)
    )
    return (
        hits.select("doc_id", "name")
        .join(tiled, "name")
        .select("doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "coverage", "name")
    )
