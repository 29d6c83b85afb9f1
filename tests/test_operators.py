"""Splits, segments, labels, batches, decoding, selection, user scoring."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from hearken.functions import argmax, encode_chars, unmask_decode
from hearken.operators import (
    alphabet,
    assemble_hypotheses,
    assert_split,
    best_run,
    bundle_splits,
    by_flag,
    collect_vocab,
    ctc_greedy_decode,
    ctc_vocab,
    distinct_chars,
    exact_split,
    first_of_split,
    join_segments,
    latency_compare,
    latest_checkpoint,
    length_batches,
    lookup_ids,
    pad_batch,
    prep_report,
    require_columns,
    rover,
    score_batches,
    select_dropna,
    split_errors,
    to_canonical,
    wer_of_columns,
)


@pytest.mark.parametrize("n, share", [(1, 0.1), (10, 0.1), (11, 0.1), (1000, 0.25), (7, 1.0), (30, 0.1)])
def test_split_has_the_exact_size_and_repeats(spark, n, share):
    df = spark.range(n)
    split = exact_split(df, "id", share)
    test = {r["id"] for r in split.where("split = 'test'").collect()}
    order = sorted(range(n), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert test == set(order[: math.ceil(n * share)])
    again = exact_split(df.repartition(5), "id", share)
    assert {r["id"] for r in again.where("split = 'test'").collect()} == test


def test_split_without_rows_and_with_other_seed(spark):
    assert exact_split(spark.range(0), "id").count() == 0
    assert exact_split(spark.range(9), "id", 0.0).where("split = 'test'").count() == 0
    one, two = (
        {r["id"] for r in exact_split(spark.range(200), "id", 0.1, seed).where("split='test'").collect()}
        for seed in (1, 2)
    )
    assert len(one) == len(two) == 20 and one != two


def test_split_keeps_copies_of_one_busy_key_together(spark):
    df = spark.range(900).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("k"))
    split = exact_split(df, "k", 0.5, keep_copies_together=True)
    assert split.where("k = -1").select("split").distinct().count() == 1
    assert split.count() == 900


@pytest.mark.parametrize("seed", range(1, 6))
def test_split_is_exact_with_repeated_and_null_keys(spark, seed):
    rows = [(None, i) for i in range(60)] + [("k", 1)] * 30 + [(str(i), i) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, n int")
    for share in (0.1, 0.5, 0.8):
        split = exact_split(df, "k", share, seed)
        assert split.where("split = 'test'").count() == 100 * share
        assert sorted(map(tuple, split.drop("split").collect()), key=str) == sorted(rows, key=str)


def test_dotted_systems_and_repeated_hypotheses(spark):
    refs = spark.createDataFrame([("u", "a b")], "utt_id string, ref string")
    said = [("u", "m.1", "a b"), ("u", "m.1", "a b"), ("u", "m.2", "a c")]
    hyps = spark.createDataFrame(said, "utt_id string, system string, hyp string")
    wide = assemble_hypotheses(refs, hyps, ["m.1", "m.2"])
    assert rover(wide, ["m.1", "m.2"]).first()["rover"] == "a b"
    got = wer_of_columns(wide, "ref", ["m.1", "m.2"]).collect()
    assert {r.system: r.wer for r in got} == {"m.1": 0.0, "m.2": 50.0}
    other = spark.createDataFrame([("u", "m.2", "else")], hyps.schema)
    with pytest.raises(Exception, match="several hypotheses"):
        assemble_hypotheses(refs, hyps.union(other), ["m.1", "m.2"]).collect()


def test_split_plan_does_not_move_rows(spark, tmp_path):
    spark.range(50).withColumn("text", F.lit("x")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    lines = exact_split(df, "id")._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("Exchange" in line for line in lines)
    scans = [line for line in lines if "FileScan" in line]
    assert sum("text" in line.split("Batched")[0] for line in scans) == 1


@pytest.mark.parametrize("chunk", [None, 1, 3, 1024])
def test_segments_in_any_chunk(spark, chunk):
    rng = random.Random(5)
    rows = [(k, i, f" {k}{i}") for k in "ab" for i in range(20)] + [("c", 0, None), ("c", 1, "  ")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "utt_id string, seg_no int, text string")
    got = {r["utt_id"]: r["text"] for r in join_segments(df, chunk=chunk).collect()}
    assert got["a"] == " ".join(f"a{i}" for i in range(20))
    assert got["c"] == ""


def test_alphabet_is_pythons_order(spark):
    texts = ["Ёж и 中", "", "a b😀", "яё"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    wanted = sorted(set("".join(texts)))
    assert [r["ch"] for r in alphabet(df).orderBy("pos").collect()] == wanted
    assert {r["ch"] for r in distinct_chars(df).collect()} == set(wanted)


def test_vocabulary(spark):
    df = spark.createDataFrame([("ба б",), ("a😀",)], "text string")
    vocab = collect_vocab(ctc_vocab(df))
    assert vocab == {"|": 0, "a": 1, "а": 2, "б": 3, "😀": 4, "[UNK]": 5, "[PAD]": 6}
    without = collect_vocab(ctc_vocab(df.where("text = 'a😀'")))
    assert without == {"a": 0, "😀": 1, "|": 2, "[UNK]": 3, "[PAD]": 4}
    with pytest.raises(Exception, match="word mark"):
        ctc_vocab(spark.createDataFrame([("a|b",)], "text string")).collect()
    texts = spark.createDataFrame([("а бz",), ("",), ("😀",)], "text string")
    labelled = texts.withColumn("ids", encode_chars("text", vocab))
    assert [r["ids"] for r in labelled.collect()] == [[2, 0, 3, 5], [], [4]]
    back = labelled.select(unmask_decode(F.concat("ids", F.array(F.lit(-100), F.lit(-100))), vocab))
    assert [r[0] for r in back.collect()] == ["а б", "", "😀"]
    ids = lookup_ids(spark.createDataFrame([(" ",), ("б",), ("?",)], "ch string"), vocab)
    assert [r["id"] for r in ids.collect()] == [0, 3, 5]


def test_argmax_takes_the_first(spark):
    rows = [([1.0, 3.0, 3.0],), ([float("nan"), 5.0],), ([-1.0],)]
    df = spark.createDataFrame(rows, "x array<double>")
    assert [r[0] for r in df.select(argmax("x")).collect()] == [1, 0, 0]


def test_batches_hold_like_lengths(spark):
    df = spark.range(500).withColumn("n", F.col("id") * 7919 % 101)
    rows = length_batches(df, "id", "n", batch_size=4, batches_per_group=10).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["megabatch"], []).append(r)
    assert len(rows) == 500 and set(groups) <= set(range(13))
    for members in groups.values():
        members.sort(key=lambda r: (-r["n"], r["id"]))
        assert [r["batch"] for r in members] == [i // 4 for i in range(len(members))]


def test_padding(spark):
    rows = [(1, [9, 1, 2]), (1, [9]), (2, [9, 5]), (2, [4]), (3, []), (3, [9])]
    df = spark.createDataFrame(rows, "batch int, ids array<int>")

    def labels(start):
        made = pad_batch(df, ["batch"], "ids", start).collect()
        return sorted((r["batch"], r["labels"]) for r in made)

    assert labels(None) == sorted([
        (1, [9, 1, 2]), (1, [9, -100, -100]), (2, [9, 5]), (2, [4, -100]), (3, [-100]), (3, [9])
    ])
    assert labels(9) == sorted([
        (1, [1, 2]), (1, [-100, -100]), (2, [9, 5]), (2, [4, -100]), (3, [-100]), (3, [9])
    ])


def test_batches_and_padding_share_one_shuffle(spark):
    df = spark.range(100).withColumn("ids", F.array(F.lit(1)))
    batched = length_batches(df, "id", F.size("ids"), 4)
    padded = pad_batch(batched, ["megabatch", "batch"], "ids")
    plan = padded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("run", [1, 2, 3, 5, 4096])
def test_greedy_decoding(spark, run):
    vocab = {"_": 0, "A": 1, "|": 2, "б": 3}
    utterances = {
        "u": [1, 1, 0, 1, 2, 2, 3, 3, 3, 0],
        "blank": [0, 0, 0],
        "edge": [2, 2, 1, 1, 1, 1, 1, 2],
        "long": [3] * 11 + [0] + [3],
    }
    rows = [(k, i, x) for k, ids in utterances.items() for i, x in enumerate(ids)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "utt_id string, frame_no int, id int")
    got = ctc_greedy_decode(df, vocab, 0, F.col("id"), frames_per_run=run).collect()
    assert {r["utt_id"]: r["text"] for r in got} == {
        "u": "aa б", "blank": "", "edge": "a", "long": "бб"
    }


def test_assemble_drops_what_one_system_missed(spark):
    refs = spark.createDataFrame([("1", "r"), ("2", "s")], "utt_id string, ref string")
    hyps = spark.createDataFrame(
        [("1", "x", "a"), ("1", "y", ""), ("2", "x", "b"), ("1", "z", "other"), ("1", "x", "a")],
        "utt_id string, system string, hyp string",
    )
    got = assemble_hypotheses(refs, hyps, ["x", "y"]).collect()
    assert [tuple(r) for r in got] == [("1", "r", "a", "")]


def test_preparation_guards(spark):
    df = spark.createDataFrame([("a", None, 0), ("b", "t", 1)], "p string, t string, test int")
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(df, ["p", "q"])
    with pytest.raises(ValueError):
        to_canonical(df, {"q": "audio"})
    assert to_canonical(df, {"p": "audio"}).columns == ["audio", "t", "test"]
    assert select_dropna(df, ["p", "t"]).count() == 1
    both = bundle_splits(by_flag(df, "test", 0), by_flag(df, "test", 1))
    assert assert_split(both) is both
    with pytest.raises(ValueError, match="eval"):
        assert_split(both.where("split = 'train'"))
    with pytest.raises(ValueError, match="train"):
        assert_split(both.where("split = 'none'"))
    good, bad = split_errors(df, F.col("t") == "t")
    assert (good.count(), bad.count()) == (1, 1)
    assert first_of_split(both, "eval", 3, "p").count() == 1
    counted = prep_report(both, F.col("t").isNotNull(), "split", ("train", "eval")).first()
    assert tuple(counted) == (2, 1, 0, 1)


def test_best_run_and_checkpoint(spark):
    log = spark.createDataFrame(
        [("r", 1, 5.0), ("r", 2, 3.0), ("r", 3, 3.0), ("r", 4, float("nan")), ("r", 5, None), ("q", 9, 1.0)],
        "run string, step int, wer double",
    )
    least = {r["run"]: (r["best_step"], r["best_metric"]) for r in best_run(log).collect()}
    assert least == {"r": (2, 3.0), "q": (9, 1.0)}
    most = {r["run"]: r["best_step"] for r in best_run(log, greater_is_better=True).collect()}
    assert most == {"r": 1, "q": 9}
    names = spark.createDataFrame(
        [("checkpoint-900",), ("checkpoint-1000",), ("runs",), ("checkpoint-x",), ("checkpoint-best2",)], "name string"
    )
    assert tuple(latest_checkpoint(names).first()) == ("checkpoint-1000", 1000)
    assert latest_checkpoint(names.where("name = 'runs'")).first()["name"] is None


def test_latency(spark):
    df = spark.createDataFrame(
        [("slow", 4.0), ("slow", 2.0), ("fast", 1.5), ("other", 9.0)], "system string, seconds double"
    )
    assert tuple(latency_compare(df, "slow", "fast").first()) == (3.0, 1.5, 2.0)
    assert tuple(latency_compare(df, "slow", "none").first()) == (3.0, None, None)


def test_user_scoring_keeps_errors_per_row(spark):
    def make():
        loads = []

        def score(frame):
            loads.append(len(frame))
            if (frame["n"] == 5).any():
                raise RuntimeError("bad five")
            return frame[["n"]].assign(twice=frame["n"] * 2, seen=max(loads))[["seen", "twice"]]

        return score

    df = spark.range(20).select(F.col("id").alias("n"), F.lit("k").alias("tag")).coalesce(1)
    rows = score_batches(df, make, ["n"], "twice long, seen int", batch_size=4, keep=["tag", "n"]).collect()
    assert [r["twice"] for r in sorted(rows, key=lambda r: r["n"])] == [
        None if n == 5 else 2 * n for n in range(20)
    ]
    assert [r["error"] for r in rows if r["n"] == 5] == ["RuntimeError: bad five"]
    assert all(r["error"] is None and r["seen"] <= 4 for r in rows if r["n"] != 5)
    short = score_batches(df, lambda: lambda f: f.head(0), ["n"], "n long", keep=["tag"])
    assert short.where("error is null").count() == 0
