"""Fused language evidence against the same product written out row by row."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from hearken.llm import language
from hearken.llm.common import text_slices
from hearken.llm.language import BUCKETS, UNKNOWN, fuse

ITEM = (
    "kind string, id long, name string, text string, declared string, host string, "
    "domain string, suffix string"
)


def codes_of(text):
    import pyarrow as pa

    for _, data, offsets in text_slices(pa.array([text or ""])):
        code, (starts, ends) = language.trigrams(data, offsets)
        return code[int(starts[0]) : int(ends[0])]
    return np.zeros(0, np.int64)


def plain(items):
    """(id, lang, posterior, rejected) of each item, by the formulas of the module."""
    labelled = [(r[4], codes_of(r[3])) for r in items if r[4] is not None]
    languages = sorted({d for d, _ in labelled})
    k = len(languages)
    counts = np.zeros((k, BUCKETS))
    for declared, codes in labelled:
        for c in codes:
            counts[languages.index(declared), c] += 1
    corpus = counts.sum(axis=0) + 0.5
    counts += language.BACKGROUND * corpus / corpus.sum()
    model = [np.log(row / row.sum()) for row in counts] + [np.full(BUCKETS, -math.log(BUCKETS))]
    rows = []
    for r in items:
        codes = codes_of(r[3])
        evidence = [float(m[codes].sum()) / math.sqrt(max(1, len(codes))) for m in model]
        rows.append((r, len(codes), evidence, int(np.argmax(evidence))))
    usable = [x for x in rows if x[3] < k and x[1] > 0]
    base = np.ones(k)
    for x in usable:
        base[x[3]] += 1
    base /= base.sum()

    def smoothed(n, above):
        return (n + language.SMOOTHING * above) / (n.sum() + language.SMOOTHING)

    def shares(place):
        found = defaultdict(lambda: np.zeros(k))
        for x in usable:
            key = place(x[0])
            if key is not None:
                found[key][x[3]] += 1
        return found

    domains = {d: smoothed(n, base) for d, n in shares(lambda r: r[6]).items()}
    hosts = {
        key: smoothed(n, domains.get(key[1], base))
        for key, n in shares(lambda r: (r[5], r[6]) if r[5] is not None else None).items()
    }
    declared = {d: np.log(smoothed(n, base) / base) for d, n in shares(lambda r: r[4]).items()}
    suffixes = {d: np.log(smoothed(n, base) / base) for d, n in shares(lambda r: r[7]).items()}
    for r, n, evidence, _ in rows:
        weight = np.array(evidence[:k]) + np.log(
            hosts.get((r[5], r[6]), base) * (1 - language.UNKNOWN_PRIOR)
        )
        weight += declared.get(r[4], 0) + suffixes.get(r[7], 0)
        weight = np.append(weight, evidence[k] + math.log(language.UNKNOWN_PRIOR))
        best = int(np.argmax(weight))
        posterior = 1 / np.exp(weight - weight.max()).sum()
        lang = languages[best] if best < k else UNKNOWN
        yield r[1], lang, round(float(posterior), 6), lang == UNKNOWN or n == 0 or posterior < 0.5


def test_fusion_equals_the_product_row_by_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()
    items = []
    for k, r in enumerate(docs):
        host, domain = (f"h{k % 4}.d{k % 2}.x", f"d{k % 2}.x") if k % 3 else (None, None)
        suffix = ["de", "fr", None][k % 3]
        # some declare another language than their own, some none
        declared = {5: "en", 7: None}.get(k % 9, r.lang)
        items.append(("page", r.doc_id, None, (r.text or "")[:900], declared, host, domain, suffix))
    items += [
        ("page", 9001, None, None, "en", None, None, None),
        ("page", 9002, None, "", None, "h0.d0.x", "d0.x", "de"),
        ("page", 9003, None, "12 34 !!", "fr", None, None, None),
        ("page", 9004, None, "the and of", "en", "nowhere", None, "zz"),
        ("page", 9004, None, "the and of", "en", "nowhere", None, "zz"),
        ("page", None, None, "xq zk wv jq", "de", None, None, None),
    ]
    frame = spark.createDataFrame(items, ITEM).repartition(3)
    got = fuse(frame, frame.select("text", "declared"))
    found = got.select("id", "lang", F.round("posterior", 6), "rejected")
    assert Counter(map(tuple, found.collect())) == Counter(plain(items))


def test_empty_table(spark):
    none = spark.createDataFrame([], ITEM)
    assert fuse(none, none.select("text", "declared")).count() == 0
