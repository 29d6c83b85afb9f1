"""The stages of the pipeline, and the whole of it, against plain forms on documents made awkward."""

import re
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_llm import ASSIGN, random_spans  # noqa: E402

import corpus_pipeline as job  # noqa: E402
from hearken.llm.units import load  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "password = abcd1234efgh5678"


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


@pytest.fixture(scope="module")
def rows(spark, sf_dir, items):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = [tuple(r) for r in found.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    some = [r[1] for r in rows if r[1] and len(r[1]) > 600][:4]
    odd = [
        (90_001, None, "en", "a", None),
        (90_002, "", None, None, 0),
        (90_003, some[0], "en", "a", len(some[0])),
        (90_004, some[1] + " and a bit", "en", "a", None),
        (90_005, some[2][:300] + f" {KEY} " + some[3][300:], "en", "a", None),
        (90_006, some[3][:200] + " " + items[0], "en", "a", None),
        (90_005, some[2][:300] + f" {KEY} " + some[3][300:], "en", "a", None),
        (None, some[0] + " without an id", "en", None, None),
    ]
    return rows + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_copies(rows):
    """Rows that stay: the smallest id of each group of near copies, equal rows once."""
    sets = defaultdict(list)
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        sets[i].append(grams or ({tuple(words)} if words else set()))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i in ids:
        for grams in sets[i]:
            for g in grams:
                holders[g].add(i)
    pairs = {(a, b) for some in holders.values() for a in some for b in some if a < b}
    for a, b in pairs:
        for x in sets[a]:
            for y in sets[b]:
                both = len(x & y)
                if both and 100 * both >= 80 * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    kept, seen = [], set()
    for r in rows:
        if r[0] is None or (root(r[0]) == r[0] and r[:2] not in seen):
            kept.append(r)
            seen.add(r[:2])
    return kept


LOWER = {c: c + 32 for c in range(65, 91)}


def plain_mask(text):
    if text is None:
        return None
    spans = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    spans += [(a, z) for a, _, z, _ in random_spans(text)]
    out, at = [], 0
    for a, z in sorted(spans, key=lambda s: s[0]):
        if a >= at:
            out.append(text[at:a])
        at = max(at, z)
    return job.MASK.join([*out, text[at:]])


def texts_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_columns_stay(spark, docs, sf_dir):
    for _, stage in job.STAGES[:-1]:
        assert stage(spark, docs.limit(30), sf_dir).columns == list(job.COLUMNS)


def test_language(spark, docs, rows, sf_dir):
    kept = texts_of(job.identify_language(spark, docs, sf_dir))
    assert (90_001, None) not in kept
    assert (90_002, "") not in kept
    assert kept <= Counter(r[:2] for r in rows)
    # what it keeps are rows as they were, repeated ones as often
    assert kept[90_005, rows[-2][1]] == 2
    assert sum(kept.values()) >= 0.9 * len(rows)


def test_near_copies(spark, docs, rows, sf_dir):
    got = texts_of(job.drop_near_copies(spark, docs, sf_dir))
    assert got == Counter(r[:2] for r in plain_copies(rows))


def test_leaks(spark, docs, rows, items, sf_dir):
    kept = texts_of(job.drop_leaks(spark, docs, sf_dir))
    assert not any(i == 90_006 for i, _ in kept)
    holds = [r for r in rows if r[1] and any(x and len(x) > 80 and x in r[1] for x in items)]
    assert holds
    assert not any((r[0], r[1]) in kept for r in holds)
    # a text that shares no eight words in a row with an item stays
    grams = {
        g
        for x in items
        for w in [re.findall(r"\w+", (x or "").lower())]
        for g in zip(*(w[k:] for k in range(8)))
    }
    for r in rows:
        words = re.findall(r"\w+", (r[1] or "").lower())
        if not grams & set(zip(*(words[k:] for k in range(8)))):
            assert kept[r[0], r[1]]


def test_secrets(spark, docs, rows, sf_dir):
    got = texts_of(job.mask_secrets(spark, docs, sf_dir))
    assert got == Counter((r[0], plain_mask(r[1])) for r in rows)
    assert not any(KEY in (t or "") for _, t in got)


def test_run(spark, docs, rows, tmp_path, sf_dir):
    """The whole job over tables of its own: each stage has worked on what the last one kept."""
    for name in ("documents", "benchmark"):
        table = docs if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = docs
    for _, stage in job.STAGES[:1]:
        kept = stage(spark, kept, str(tmp_path))
    stay = [tuple(r) for r in kept.collect()]
    stay = plain_copies(stay)
    after = job.drop_leaks(spark, spark.createDataFrame(stay, SCHEMA), str(tmp_path))
    tokenizer = load(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(
        (r.doc_id, len(tokenizer.encode(plain_mask(r.text) or "", add_special_tokens=False).ids) + 1)
        for r in after.collect()
    )
    pieces = job.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    sizes = Counter()
    for r in pieces:
        sizes[r.doc_id] += r.length
    total = Counter()
    for (i, n), times in want.items():
        total[i] += n * times
    assert sizes == total
