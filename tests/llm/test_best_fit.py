"""Ids from distinct parts, and best-fit packing by exact complements, against plain forms."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings, strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from hearken.llm import units  # noqa: E402
from hearken.llm.best_fit import best_fit_packing, patterns, slots  # noqa: E402
from hearken.llm.common import text_slices  # noqa: E402

SCHEMA = "doc_id long, text string"
ODD = [
    None,
    "",
    " \t\n",
    "two words",
    "é" * 700,
    "<|endoftext|>a  b\x1c c\x85d　e",
    "word " * 9000,
    "x" * 5000,
    " lead",
    "\nlead",
    "a\n\nb",
    "a\nb\n",
    "“q” – x y z ▁ ▁a",
    "<|EndOfText|> A<|startoftext|>b it's I'LL 'tis a1b2 ½x 3½ .a 'S don't.x 'll! ,'s",
    "a\x01b \x01 c",
    "é a ́b Å.́x",
    "x ᠎ y ​ z q 　 ",
    "İI ΑΣ Σ. ÀÉß",
    "x\x0by\x0cz w\x00 v",
]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    return [*(r.text for r in docs.select("text").collect()), *ODD]


CASES = [(units.LedIds, "byte_bpe_50k.json"), (units.SpacelessIds, "word_bpe_49k.json")]


@lru_cache
def library(name):
    return units.load(public_tokenizers.path(name))


def plain_ids(name, texts):
    tokenizer = library(name)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def ids_of(encoder, texts, size=1 << 16):
    got = []
    for _, data, offsets in text_slices(pa.array(texts, pa.string()), size):
        ids, at = encoder.rows(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return got


@pytest.mark.parametrize(("kind", "name"), CASES)
@pytest.mark.parametrize("kept", [units.KEPT_PARTS, 500])
def test_ids_equal_the_library(texts, kind, name, kept, monkeypatch):
    monkeypatch.setattr(units, "KEPT_PARTS", kept)
    assert ids_of(kind(public_tokenizers.path(name)), texts) == plain_ids(name, texts)


@pytest.mark.parametrize(("kind", "name"), CASES)
def test_ids_of_any_text(kind, name):
    encoder = kind(public_tokenizers.path(name))
    alphabet = "ab Z9.'\n\t\x01é́ ▁　Σ<|>"

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=alphabet, max_size=20), max_size=6))
    def check(some):
        assert ids_of(encoder, some) == plain_ids(name, some)

    check()


@settings(max_examples=200, deadline=None)
@given(
    st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40),
    st.just(64),
)
def test_patterns_use_every_piece_once(counts, capacity):
    found = patterns(counts, capacity)
    used, bins = Counter(), 0
    for own, times in found:
        assert sum(length * n for length, n in own.items()) <= capacity
        used.update({length: n * times for length, n in own.items()})
        bins += times
    assert used == Counter(counts)
    # any-fit bound: no two sequences fit into one
    total = sum(length * n for length, n in counts.items())
    assert bins <= 1 or bins * capacity < 2 * total
    assert bins >= -(-total // capacity)
    table = slots(found)
    assert len(table) == 0 or (np.diff(table[:, 0]) >= 0).all()


def test_exact_complements_leave_no_gap():
    # one, two and three lengths fill what the longest leaves
    counts = {90: 5, 10: 5, 70: 3, 17: 3, 13: 3, 60: 2, 20: 2, 12: 2, 8: 2}
    found = patterns(counts, 100)
    assert all(sum(length * n for length, n in own.items()) == 100 for own, _ in found)


def test_best_fit_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*enumerate(texts), (None, "no id"), (5, "again"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, SCHEMA).select(
        "*", F.lit(1).alias("length"), F.lit("x").alias("share")
    )
    got = best_fit_packing(docs.repartition(3), path)
    assert got.columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    ]
    want, sequences, n_tokens = Counter(), defaultdict(list), 0
    for (doc_id, _), ids in zip(
        rows, plain_ids("word_bpe_49k.json", [t for _, t in rows]), strict=True
    ):
        ids = [*ids, 1]
        n_tokens += len(ids)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            want[doc_id, piece, start, len(part), crc] += 1
    found = Counter()
    for r in got.collect():
        found[tuple(r)[:5]] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-n_tokens // 4096) + 1


def test_empty_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert best_fit_packing(spark.createDataFrame([], SCHEMA), path).count() == 0
