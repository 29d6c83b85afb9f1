"""Greedy string tiling against a plain loop over all pairs of places."""

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hearken.llm.tiling import contaminated, greedy_tiles


def plain_tiles(item, doc, least):
    """Again and again the longest run that both share and no tile touches, leftmost first."""
    free_item, free_doc, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (
                    i + n < len(item)
                    and j + n < len(doc)
                    and item[i + n] == doc[j + n]
                    and free_item[i + n]
                    and free_doc[j + n]
                ):
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return tiles
        n, i, j = -best[0], best[1], best[2]
        free_item[i : i + n] = [False] * n
        free_doc[j : j + n] = [False] * n
        tiles.append((i, j, n))


words = st.lists(st.integers(1, 3), max_size=24)


@settings(max_examples=200, deadline=None)
@given(words, words, st.integers(2, 4))
def test_tiles_equal_a_plain_loop(item, doc, least):
    got = greedy_tiles(np.array(item, np.uint64), np.array(doc, np.uint64), least)
    assert [tuple(map(int, t)) for t in got] == plain_tiles(item, doc, least)


def test_pairs_equal_a_plain_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    few = [tuple(r) for r in items.select("item_id", "text").orderBy("item_id").limit(6).collect()]
    halves = [(i, t, t.split()) for i, t in few]
    rows = [tuple(r) for r in docs.orderBy("doc_id").limit(12).collect()]
    rows += [
        (1000 + i, " ".join(w[len(w) // 2 :] + ["between"] + w[: len(w) // 2])) for i, _, w in halves
    ]
    rows += [(2000 + i, " ".join(w[: len(w) // 3])) for i, _, w in halves]
    rows += [(3000, None), (3001, ""), (None, few[0][1]), (1000, rows[0][1])]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit(1))
    got = contaminated(made, spark.createDataFrame(few, "item_id long, text string"), width=8)

    def tokens(text):
        import re

        return [t.lower() for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    want = []
    for doc_id, text in rows:
        for item_id, item in few:
            a, b = tokens(item), tokens(text)
            shared = {tuple(a[k : k + 8]) for k in range(len(a) - 7)}
            if not any(tuple(b[k : k + 8]) in shared for k in range(len(b) - 7)):
                continue
            tiles = plain_tiles(a, b, 8)
            covered = sum(n for *_, n in tiles)
            if covered >= 0.5 * len(a):
                want.append((str(doc_id), item_id, len(a), covered, len(tiles)))
    found = got.select(F.col("doc_id").cast("string"), "item_id", "item_tokens", "covered_tokens", "n_tiles")
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == sorted(want)
    assert want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(none, items).count() == 0
