"""Alignment of two tokenizers against a token-by-token form."""

import hashlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from hypothesis import given, strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from hearken.llm.common import stored  # noqa: E402
from hearken.llm.cross_align import (  # noqa: E402
    MARK,
    alignments,
    byte_level_spelling,
    coalesce,
    link_counts,
    link_scores,
    overlaps,
)
from hearken.llm.units import load  # noqa: E402

SCHEMA = "doc_id long, text string"
A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    " \t\n",
    "two words",
    "é" * 300,
    "<|endoftext|>a  b\x1c c\x85d　e <s> <0x41> <unk>",
    "x" * 3000,
    " lead",
    "\nlead",
    "a\n\nb",
    "a\nb\n",
    f"a{MARK}b c",
    f"{MARK}",
    f"a {MARK} b",
    "“q” – x y z",
    "a\x00b \x01 c",
    "日本語 テキスト 😀 ok",
]


def plain(texts):
    """Of each text (ids of A, ids of B, groups, links)."""
    from sentencepiece import SentencePieceProcessor

    a_model, b_model = load(A), SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    spelled = byte_level_spelling(a_model.get_vocab(with_added_tokens=False))
    a_raw = spelled.flat.tobytes()

    def a_bytes(i):
        return a_raw[spelled.starts[i] : spelled.starts[i] + spelled.lengths[i]]

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        if b_model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode()

    for text in texts:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        wanted = (" " + (text or "")).encode()
        if b"".join(map(a_bytes, a)) != wanted or b"".join(map(b_bytes, b)) != wanted:
            yield [], [], [], []
            continue
        a_ends = np.cumsum([len(a_bytes(i)) for i in a]).tolist()
        b_ends = np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        yield a, b, groups, links


def test_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows += [*enumerate(ODD, 10_000), (None, "no id"), (4, "again and"), (4, "again and")]
    frame = spark.createDataFrame(rows, SCHEMA).select(
        "*", F.lit(1).alias("block"), F.lit("x").alias("pair")
    )
    found = list(plain([t for _, t in rows]))
    counts = Counter(pair for *_, links in found for pair in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for (doc_id, _), (a, b, groups, links) in zip(rows, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == most[p[1]] for p in links)
        total = sum(counts[p] for p in links)
        want[doc_id, len(a), len(b), len(groups), len(links), digest, n_best, total] += 1
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = alignments(frame.repartition(3), A, B).withColumn("digest", digest).drop("groups")
    kept = stored(aligned, "test-alignments")
    got = link_scores(kept, link_counts(kept))
    assert got.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "n_best", "count_sum"
    ]
    assert Counter(map(tuple, got.collect())) == want


def test_empty_table(spark):
    kept = stored(alignments(spark.createDataFrame([], SCHEMA), A, B), "test-alignments")
    assert link_scores(kept, link_counts(kept)).count() == 0


@given(
    st.lists(st.integers(1, 5), min_size=1, max_size=12),
    st.lists(st.integers(1, 5), min_size=1, max_size=12),
)
def test_groups_and_overlaps(a, b):
    # both cover the same range
    a, b = [*a, max(0, sum(b) - sum(a))], [*b, max(0, sum(a) - sum(b))]
    a, b = [n for n in a if n], [n for n in b if n]
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    a_starts, b_starts = a_ends - a, b_ends - b
    i, j = overlaps(a_starts, a_ends, b_starts, b_ends)
    want = [
        (p, q)
        for p in range(len(a))
        for q in range(len(b))
        if a_starts[p] < b_ends[q] and b_starts[q] < a_ends[p]
    ]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want
    a_group, b_group = coalesce(a_starts, a_ends, b_starts, b_ends)
    assert all(a_group[p] == b_group[q] for p, q in want)
    assert a_group[-1] + 1 == len(set(a_ends.tolist()) & set(b_ends.tolist()))


def test_a_task_holds_a_few_megabytes_of_texts(spark):
    texts = [(k, f"{k} " + "the cat sat on the mat " * 4500) for k in range(60)]
    docs = spark.createDataFrame(texts, SCHEMA).coalesce(1)
    kept = stored(alignments(docs, A, B), "test-blocks")
    rows = kept.where("pairs is null").select("block", "doc_id", F.size("links").alias("n")).collect()
    sizes, by_id = Counter(), dict(texts)
    for r in rows:
        sizes[r.block] += len(by_id[r.doc_id]) + 1
        assert r.n > 20_000
    assert sorted(r.doc_id for r in rows) == list(range(60))
    assert max(sizes.values()) <= 4 << 20


def test_scoring_keeps_no_encoder(spark):
    import pyarrow as pa

    from hearken.llm.cross_align import _scored
    from hearken.llm.units import encoder

    encoder(dict, ((1, 2),))
    kept = pa.table({"block": [0, 0], "doc_id": [1, 2], "links": pa.array([[0, 1, 0], []], pa.list_(pa.int32()))})
    sums = pa.table({"place": [1, 0], "n": [5, 7], "best": [True, False]})
    got = _scored(kept, sums)
    assert got.to_pydict() == {"doc_id": [1, 2], "n_best": [1, 0], "count_sum": [19, 0]}
    assert encoder.cache_info().currsize == 0
