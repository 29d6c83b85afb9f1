"""Ranked search against a plain scan, and its bounds against exact scores."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearken.llm import lexical
from hearken.llm.common import LOWER
from hearken.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string"
ITEM = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP = str.maketrans({chr(b): chr(LOWER[b]) for b in range(65, 91)})


def terms(text):
    return [t.translate(UP) for t in TERM.findall(text or "")]


def plain(docs, items, top=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in found)
    n_terms = sum(sum(c.values()) for _, c in found)
    held = Counter(t for _, c in found for t in c)
    out = Counter()
    for item_id, text in items:
        scored = []
        for doc_id, c in found:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:top], 1):
            out[item_id, rank, doc_id, -score] += 1
    return out


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in found.collect()]
    odd = [None, "", " ,.", "É é É ÀB", "x" * 4000, "word " * 3000 + "rare", "a\x00b日本 語"]
    return [*rows, *enumerate(odd, 90_000), (None, "rare word"), (None, "rare word"), rows[3], rows[3]]


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = [tuple(r) for r in found.collect()]
    return [*rows, (900, None), (901, "..."), (902, "RARE rare word"), (903, "nowhere at all zzzq"), (904, "é 日本")]


@pytest.mark.parametrize("size", [lexical.ITEMS, 9])
def test_ranked_search(spark, docs, items, size, monkeypatch):
    if size < 100:
        items = items[-20:]
    monkeypatch.setattr(lexical, "ITEMS", size)
    frame = spark.createDataFrame(docs, SCHEMA).select(
        "*", F.lit(1).alias("name"), F.lit(2).alias("score"), F.lit(3).alias("items")
    )
    wanted = spark.createDataFrame(items, ITEM).withColumn("doc_id", F.lit(0))
    got = lexical.ranked_search(frame.repartition(3), wanted)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain(docs, items)


def test_many_copies(spark):
    docs = [(i, "one passage that is copied") for i in range(500)]
    docs += [(1000 + i, f"one passage of many {i}") for i in range(100)]
    items = [(1, "passage copied"), (2, "many passage 7")]
    got = lexical.ranked_search(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEM)
    )
    assert Counter(map(tuple, got.collect())) == plain(docs, items)


def test_empty_tables(spark, docs):
    some, none = spark.createDataFrame(docs[:5], SCHEMA), spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, "of")], ITEM)
    assert lexical.ranked_search(none, asked).count() == 0
    assert lexical.ranked_search(some, asked.limit(0)).count() == 0


def test_bounds_hold_and_exclude(docs, items):
    """No bound is below its score, and bounds let few documents through."""
    texts = [t for _, t in docs if t]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array(np.arange(len(texts)))], ["text", "name"]
    )
    asked = lexical.Items.of(items[:40])
    counts = [Counter(terms(t)) for t in texts]
    held = Counter(t for c in counts for t in c)
    n_docs, n_terms = sum(map(bool, counts)), sum(sum(c.values()) for c in counts)
    by_hash = {}
    for t in {t for _, text in items[:40] for t in terms(text)}:
        by_hash[int(lexical.Items.of([(0, t)]).terms[0])] = t
    own = [by_hash[int(h)] for h in asked.terms]
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) for t in own]
    weights = lexical.Weights(n_docs, n_terms, np.array(weight))
    loose = total = 0
    for block in lexical.index_blocks(lexical._blocks([batch])):
        bounds = lexical.upper_bounds(asked, weights, block)
        m = weights.length_part(block["terms"])
        for d, name in enumerate(block["names"].tolist()):
            for k in range(len(asked.ids)):
                score = sum(
                    int(weight[i] * r) * int(lexical.saturated(counts[name][own[i]], m[d]))
                    for i, r in zip(asked.own[k], asked.repeats[k], strict=True)
                )
                assert bounds[k, d] >= score
                loose += bounds[k, d] > 1.25 * score
                total += 1
    assert loose < 0.1 * total


def test_query_equals_its_sql(spark, sf_dir):
    from checks.compare import _canonical, duck

    df = QUERIES["op12_ranked_lexical_search"](spark, sf_dir)
    result = duck(sf_dir).execute(ORACLE_SQL["op12_ranked_lexical_search"])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r) for r in df.collect()]
    assert _canonical(got, df.columns) == _canonical(result.fetchall(), columns)
