"""Networks, models per worker, page tables, best runs and batches against plain forms."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearken.functions import encode_chars, labels, normalize_full
from hearken.functions.labels import PAGE, PADDING, UNKNOWN, WORD_MARK, page_table
from hearken.operators import (
    best_run,
    length_batches,
    lookup_ids,
    rover,
    score_batches,
    wer_of_columns,
)


def plain_script(slots, words):
    """The alphabetically first of the cheapest scripts, by the whole table of costs."""
    n, m = len(slots), len(words)
    skip = ["" not in s for s in slots]
    cost = [[0] * (n + 1) for _ in range(m + 1)]
    for j in reversed(range(m + 1)):
        for i in reversed(range(n + 1)):
            ways = []
            if i < n and j < m:
                ways.append(cost[j + 1][i + 1] + (words[j] not in slots[i]))
            if i < n:
                ways.append(cost[j][i + 1] + skip[i])
            if j < m:
                ways.append(cost[j + 1][i] + 1)
            cost[j][i] = min(ways, default=0)
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and cost[j][i] == cost[j + 1][i + 1] + (words[j] not in slots[i]):
            yield "A"
            i, j = i + 1, j + 1
        elif i < n and cost[j][i] == cost[j][i + 1] + skip[i]:
            yield "D"
            i += 1
        else:
            yield "I"
            j += 1


def plain_network(texts, tie):
    slots = [[w] for w in texts[0].split()]
    for k, text in enumerate(texts[1:], 1):
        words, old, grown = text.split(), iter(slots), []
        left = iter(words)
        for letter in plain_script(slots, words):
            slot = ["" for _ in range(k)] if letter == "I" else next(old)
            grown.append([*slot, "" if letter == "D" else next(left)])
        slots = grown
    out = []
    for slot in slots:
        def rank(w):
            return (-slot.count(w), tie == "word_over_null" and w == "", slot.index(w))

        out.append(min(slot, key=rank))
    return " ".join(w for w in out if w)


@pytest.mark.parametrize("tie", ["first", "word_over_null"])
@pytest.mark.parametrize("n", [3, 4])
def test_network_equals_a_plain_loop(spark, n, tie):
    draw = random.Random(n)
    rows = [
        tuple(" ".join(draw.choice("abcd") for _ in range(draw.randint(0, 9))) for _ in range(n))
        for _ in range(150)
    ]
    rows += [("",) * n, ("a b",) * n, ("", "x y", "x y", "y")[:n]]
    names = [f"s{i}" for i in range(n)]
    made = rover(spark.createDataFrame(rows, names), names, tie, align="network")
    got = {tuple(r[c] for c in names): r["rover"] for r in made.collect()}
    assert got == {r: plain_network(r, tie) for r in rows}


def test_words_that_the_first_system_lacks_meet(spark):
    row = [("a c", "a x b c", "a b c")]
    df = spark.createDataFrame(row, ["s0", "s1", "s2"])
    systems = df.columns
    assert rover(df, systems, align="network").first()["rover"] == "a b c"
    assert rover(df, systems, align="pivot").first()["rover"] == "a c"
    with pytest.raises(ValueError, match="align"):
        rover(df, systems, align="other")


def test_votes_are_scored_in_one_plan(spark, tmp_path):
    w = spark.createDataFrame(
        [("a b c", "A b x", "a c", "a, b c d"), ("d", "q", "q", None)],
        "ref string, one string, two string, three string",
    )
    w.write.parquet(str(tmp_path / "w"))
    for source in (w, spark.read.parquet(str(tmp_path / "w"))):
        for align in ("pivot", "network"):
            voted = rover(source, ["one", "two", "three"], align=align)
            scores = wer_of_columns(voted, "ref", ["one", "rover"], normalize_full, counts=True)
            rows = {r.system: r for r in scores.collect()}
            assert rows["one"].edits == 2
            assert rows["rover"].ref_words == 4
            assert rows["rover"].utterances == 2
            plan = scores._jdf.queryExecution().executedPlan().toString()
            assert plan.count("vote(") <= 2


def test_one_model_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda frame: frame.assign(out=frame["id"] * 2)[["out"]]

    rows = spark.range(4000).repartition(24)
    scored = score_batches(rows, make, ["id"], "out long", keep=["id"])
    assert scored.where("out = 2 * id and error is null").count() == 4000
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 24
    # a task without rows makes no model
    before = len(loads)
    score_batches(rows.where("id < 0"), make, ["id"], "out long").count()
    assert len(list(tmp_path.iterdir())) == before


def test_failed_batches_are_halved(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        def fn(frame):
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            if frame["id"].isin([3, 64, 65]).any():
                raise ValueError("bad")
            return frame.assign(out=frame["id"])[["out"]]

        return fn

    scored = score_batches(
        spark.range(128).coalesce(1), make, ["id"], "out long", batch_size=128, keep=["id"]
    )
    rows = {r.id: r for r in scored.collect()}
    assert {i for i, r in rows.items() if r.error} == {3, 64, 65}
    assert all(r.out == i for i, r in rows.items() if not r.error)
    assert rows[3].error == "ValueError: bad"
    assert len(list(tmp_path.iterdir())) < 40


def vocab_of(chars):
    names = [WORD_MARK if c == " " else c for c in chars]
    return {c: i for i, c in enumerate([*names, UNKNOWN, PADDING])}


def test_page_tables(spark):
    small, large = vocab_of(" abc"), vocab_of(" abc😀")
    # an emoji adds one page of ids, not all code points up to it
    assert len(page_table(large)[1]) - len(page_table(small)[1]) == PAGE
    assert len(page_table(large)[0]) < 0x110000 // PAGE
    texts = ["a b", "", None, "😀c", "zéa", "\U0010ffffb", "日本", "a" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for vocab in (small, large):
        want = [
            None if t is None else [vocab.get(WORD_MARK if c == " " else c, vocab[UNKNOWN]) for c in t]
            for t in texts
        ]
        assert [r[0] for r in df.select(encode_chars("t", vocab)).collect()] == want
        chars = spark.createDataFrame([(c,) for c in "a 😀é日"], "ch string")
        found = {r.ch: r.id for r in lookup_ids(chars, vocab).collect()}
        assert found == {c: vocab.get(WORD_MARK if c == " " else c, vocab[UNKNOWN]) for c in "a 😀é日"}


def test_best_run_sorts_nothing_before_the_shuffle(spark):
    rows = [(r, s, float((r or 7) * s % 5)) for r in (1, 2, None) for s in range(20)]
    rows += [(1, 99, None), (1, 98, float("nan")), (3, 1, None)]
    log = spark.createDataFrame(rows, "run int, step int, wer double")
    for greatest in (False, True):
        best = best_run(log, greater_is_better=greatest)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
        want = {}
        for run, step, value in rows:
            if value is None or value != value:
                continue
            key = (-value if greatest else value, step)
            if run not in want or key < want[run][0]:
                want[run] = (key, step, value)
        got = {r.run: (r.best_step, r.best_metric) for r in best.collect()}
        assert got == {run: v[1:] for run, v in want.items()}


def test_batches_of_null_and_repeated_keys(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 5).cast("string").alias("key"),
        (F.col("id") % 37).alias("n"),
    )
    made = length_batches(df, "key", "n", batch_size=10, batches_per_group=20)
    assert made.columns == ["key", "n", "megabatch", "batch"]
    assert made.count() == 6000
    groups = [r["count"] for r in made.groupBy("megabatch").count().collect()]
    # 30 groups of 200 rows
    assert len(groups) == 30
    assert max(groups) < 300
    assert made.groupBy("megabatch", "batch").count().where("count > 10").count() == 0


def test_encoding_needs_little_beside_its_result():
    import tracemalloc

    vocab = {"|": 0, "a": 1, "é": 2, "😀": 3, "[UNK]": 4, "[PAD]": 5}
    page_of, ids = labels.page_table(vocab)
    texts = ["a é😀?" * 100_000, None, "", *["aé ? 😀"] * 300_000, "x"]
    batch = pa.array(texts).slice(1)
    tracemalloc.start()
    try:
        got = labels._batch_ids(batch, [*page_of, 0], ids)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # the ids take four bytes for each byte of text at most
    assert peak < 4 * batch.nbytes + 100 * labels.PIECE_BYTES
    assert got.null_count == 1
    assert got[1:4].to_pylist() == [[], [1, 2, 0, 4, 0, 3], [1, 2, 0, 4, 0, 3]]
    assert got[300_000:].to_pylist() == [[1, 2, 0, 4, 0, 3]] * 2 + [[4]]
    whole = labels._batch_ids(pa.array(texts[:1]), [*page_of, 0], ids)
    assert whole.to_pylist() == [[1, 0, 2, 3, 4] * 100_000]
