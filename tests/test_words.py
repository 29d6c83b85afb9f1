"""Edit distance, alignment and voting against textbook versions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hearken.functions import align_words, aligned_slots, edit_detail, split_words, word_edits
from hearken.operators import corpus_wer, rover, utterance_edits, wer_by_system, wer_of_columns
from hearken.functions.text import normalize_full


def least_script(ref, hyp):
    """Cheapest, then alphabetically first script, by the full table."""
    n, m = len(ref), len(hyp)
    table = {(0, 0): (0, "")}
    for i in range(n + 1):
        for j in range(m + 1):
            ways = []
            if i and j:
                cost, script = table[i - 1, j - 1]
                ways.append((cost + (ref[i - 1] != hyp[j - 1]), script + "A"))
            if i:
                cost, script = table[i - 1, j]
                ways.append((cost + 1, script + "D"))
            if j:
                cost, script = table[i, j - 1]
                ways.append((cost + 1, script + "I"))
            if ways:
                table[i, j] = min(ways)
    return table[n, m]


WORDS = st.lists(st.sampled_from(["а", "б", "v", "дом", "12"]), max_size=9)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=30))
def test_edits_and_scripts(spark, pairs):
    rows = [(i, " ".join(r), " ".join(h)) for i, (r, h) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, r string, h string")
    got = df.select(
        "i", align_words("r", "h").alias("script"), edit_detail("r", "h").alias("d"),
        word_edits("r", "h").alias("edits"),
    ).collect()
    for row in got:
        ref, hyp = pairs[row["i"]]
        cost, script = least_script(ref, hyp)
        d = row["d"]
        assert (d["edits"], row["edits"], row["script"]) == (cost, cost, script)
        assert d["substitutions"] + d["deletions"] + d["insertions"] == cost
        assert min(d["substitutions"], d["deletions"], d["insertions"]) >= 0
        assert d["ref_words"] == len(ref)
        assert cost <= max(len(ref), len(hyp))


def test_scripts_are_least(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        ref = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        hyp = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        rows.append((i, " ".join(ref), " ".join(hyp)))
    df = spark.createDataFrame(rows, "i int, r string, h string")
    rebuilt = df.select("i", align_words("r", "h").alias("s")).collect()
    by_key = {i: (r.split(), h.split()) for i, r, h in rows}
    assert all(s == least_script(*by_key[i])[1] for i, s in rebuilt)


def test_long_pair_with_many_distinct_words(spark):
    """More distinct words than fit in one 16-bit plane."""
    n = 70_000
    df = spark.range(1).select(
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), " ").alias("r")
    ).withColumn("h", F.concat(F.lit("new "), "r"))
    assert df.select(align_words("r", "h")).first()[0] == "I" + "A" * n
    short = spark.createDataFrame([(" ".join(map(str, range(3000))),)], "r string")
    short = short.withColumn("h", F.concat(F.lit("x "), "r", F.lit(" y")))
    assert short.select(word_edits("r", "h")).first()[0] == 2


def test_blank_and_null_texts(spark):
    df = spark.createDataFrame(
        [(1, None, "a b"), (2, "a b", "a b"), (3, " a ", None), (4, None, None), (5, "", " ")],
        "i int, r string, h string",
    )
    got = df.select("i", word_edits("r", "h"), align_words("r", "h"), F.size(split_words("r")))
    assert sorted(map(tuple, got.collect())) == [
        (1, 2, "II", 0), (2, 0, "AA", 2), (3, 1, "D", 1), (4, 0, "", 0), (5, 0, "", 0)
    ]


def test_slots(spark):
    df = spark.createDataFrame([("a b", "z a b c d"), ("a b c", "a c")], "r string, h string")
    laid_out = [r[0] for r in df.select(aligned_slots("r", "h")).collect()]
    assert [[s.split("\t") for s in text.split(" ")] for text in laid_out] == [
        [["", "z"], ["a"], ["b", "c", "d"]],
        [[""], ["a"], [""], ["c"]],
    ]


def vote(spark, rows, tie="first"):
    names = [f"s{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["utt_id", *names])
    return [r["rover"] for r in rover(df, names, tie).orderBy("utt_id").collect()]


def test_rover_by_hand(spark):
    rows = [
        ("a b c", "a x c", "a x c"),      # two against one
        ("a b c", "a c", "a c"),          # two say nothing
        ("a c", "a b c", "a b c"),        # two insert the same word
        ("a c", "a b c", "a d c"),        # nothing leads by rank, or any word
        ("", "q", "q"),
        ("a", "", ""),
        ("", "", ""),
        ("a b", "a b", "a b"),
        ("a", "a b c", "a b c d"),
    ]
    assert vote(spark, rows) == [
        "a x c", "a c", "a b c", "a c", "q", "", "", "a b", "a b c"
    ]
    assert vote(spark, rows, "word_over_null")[3] == "a b c"


def test_two_systems_give_the_first(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 8)))
    rows = [(text(), text()) for _ in range(50)]
    assert vote(spark, rows) == [r[0] for r in rows]
    assert vote(spark, [(a, a, a, a) for a, _ in rows]) == [r[0] for r in rows]


def brute_vote(systems, tie):
    slots = {}
    for rank, hyp in enumerate(systems):
        ref, said = systems[0].split(), hyp.split()
        pos = ins = taken = 0
        for letter in least_script(ref, said)[1]:
            if letter == "I":
                ins += 1
                slots.setdefault((pos, ins), {})[rank] = said[taken]
                taken += 1
                continue
            pos, ins = pos + 1, 0
            slots.setdefault((pos, 0), {})
            if letter == "A":
                slots[pos, 0][rank] = said[taken]
                taken += 1
    out = []
    for key in sorted(slots):
        ballots = [slots[key].get(rank, "") for rank in range(len(systems))]
        best = max(
            set(ballots),
            key=lambda w: (ballots.count(w), w != "" if tie != "first" else 0, -ballots.index(w)),
        )
        if best:
            out.append(best)
    return " ".join(out)


@pytest.mark.parametrize("tie", ["first", "word_over_null"])
def test_rover_against_brute_force(spark, tie):
    rng = random.Random(11)
    text = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
    rows = [tuple(text() for _ in range(4)) for _ in range(120)]
    assert vote(spark, rows, tie) == [brute_vote(r, tie) for r in rows]


def test_wrong_votes_are_refused(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    with pytest.raises(ValueError):
        rover(df, ["x", "y"], "last")
    with pytest.raises(ValueError):
        rover(df, ["x"])


def test_pooled_rate(spark):
    """Sums over sums, not a mean of rows; empty truth adds edits but no words."""
    df = spark.createDataFrame(
        [("a b c d", "a b c x"), ("a", "b"), ("", "z")], "ref string, hyp string"
    )
    assert df.agg(corpus_wer("ref", "hyp")).first()[0] == 100 * 3 / 5
    nothing = df.where("ref = ''")
    assert nothing.agg(corpus_wer("ref", "hyp")).first()[0] is None


def test_summary_forms_agree(spark):
    refs = spark.createDataFrame([("1", "A b"), ("2", "c")], "utt_id string, ref string")
    hyps = spark.createDataFrame(
        [("1", "x", "a b!"), ("2", "x", "c c"), ("1", "y", ""), ("2", "y", "c")],
        "utt_id string, system string, hyp string",
    )
    long_form = {r["system"]: r["wer"] for r in wer_by_system(hyps, refs, normalize_full).collect()}
    wide = spark.createDataFrame(
        [("A b", "a b!", ""), ("c", "c c", "c")], "ref string, x string, y string"
    )
    columns = wer_of_columns(wide, "ref", ["x", "y"], normalize_full).collect()
    assert long_form == {r["system"]: r["wer"] for r in columns}
    raw = {r["system"]: r["wer"] for r in wer_by_system(hyps, refs).collect()}
    assert raw["x"] == 100 and long_form["x"] == pytest.approx(100 / 3)
    assert utterance_edits(hyps, refs).count() == 4
