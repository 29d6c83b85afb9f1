"""Paths, listings and stages that notice what changed."""

import os

import pytest
from pyspark.sql import functions as F

from hearken.functions import canonical_path
from hearken.operators import missing_audio, with_existing_audio
from hearken.plans import prepare_corpus, prepare_flagged_corpus
from hearken.sources import list_audio, materialize_once, write_results_csv


@pytest.mark.parametrize(
    ("path", "base", "want"),
    [
        ("rec/1.wav", "/data", "/data/rec/1.wav"),
        ("/rec/1.wav", "/data", "/rec/1.wav"),
        ("file:/rec/1.wav", "/data", "/rec/1.wav"),
        ("FILE:///rec//./x/../1.wav", "/", "/rec/1.wav"),
        ("file://localhost/rec/1.wav", "/", "/rec/1.wav"),
        ("//rec/1.wav", "/", "/rec/1.wav"),
        ("../1.wav", "/a/b", "/a/1.wav"),
        ("hdfs://Host:8020/a/../b.wav", "/data", "hdfs://host:8020/b.wav"),
        ("file:/a%20b%C3%A9+c.wav", "/", "/a bé+c.wav"),
        ("file:/50%.wav", "/", "/50%.wav"),
        ("/50%20.wav", "/", "/50%20.wav"),
        ("c:/x.wav", "/d", "/d/c:/x.wav"),
        ("", "/d", "/d"),
        (None, "/d", None),
    ],
)
def test_canonical_path(spark, path, base, want):
    row = spark.createDataFrame([(path,)], "p string").select(canonical_path("p", base)).first()
    assert (row[0].rstrip("/") if row[0] else row[0]) == want


def test_spellings_of_a_path_join_alike(spark):
    table = spark.createDataFrame(
        [(1, "rec/1.wav"), (2, "file:/data/rec/1.wav"), (3, "/data/x/../rec/1.wav"), (4, "2.wav"), (5, None)],
        "n int, path string",
    )
    files = spark.createDataFrame([("file:///data/rec/1.wav",)], "path string")
    found = with_existing_audio(table, files, base="/data")
    assert found.columns == ["n", "path"]
    assert sorted(r.n for r in found.collect()) == [1, 2, 3]
    assert sorted(r.n for r in missing_audio(table, files, base="/data").collect()) == [4, 5]


def test_listing_leaves_nothing_out(spark, tmp_path):
    names = ["a.wav", "_b.wav", ".c.wav", "x/d.wav", "x/_y/e.wav", ".z/f.wav", "x/no.mp3", "g h%20.wav"]
    for k, name in enumerate(names):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(b"." * (k % 3))
    (tmp_path / "empty").mkdir()
    found = list_audio(spark, str(tmp_path))
    want = {str(tmp_path / n): k % 3 for k, n in enumerate(names) if n.endswith(".wav")}
    assert {r.path: r.length for r in found.collect()} == want
    some = list_audio(spark, [f"file://{tmp_path}/x", f"{tmp_path}/x/../.z", str(tmp_path / "a.wav")])
    assert some.count() == 4
    with pytest.raises(Exception, match="FileNotFoundError"):
        list_audio(spark, str(tmp_path / "nowhere"))


def test_stages_follow_their_arguments_and_inputs(spark, tmp_path):
    made = []

    def stage(name, n, inputs=(), **arguments):
        def build():
            made.append(name)
            return spark.range(n)

        return materialize_once(
            spark, str(tmp_path / name), build, arguments=arguments, inputs=[str(tmp_path / i) for i in inputs]
        )

    assert stage("one", 3, a=1).count() == 3
    stage("two", 1, ["one"])
    stage("one", 3, a=1)
    stage("two", 1, ["one"])
    assert made == ["one", "two"]
    assert stage("one", 4, a=2).count() == 4
    stage("two", 1, ["one"])
    assert made == ["one", "two"] * 2
    # a source that is no stage counts by its files
    spark.range(5).write.csv(str(tmp_path / "source"))
    stage("three", 1, ["source"])
    stage("three", 1, ["source"])
    assert made[4:] == ["three"]
    spark.range(7).write.mode("append").csv(str(tmp_path / "source"))
    stage("three", 1, ["source"])
    assert made[4:] == ["three"] * 2
    # without its manifest a stage is not current
    os.remove(tmp_path / "three" / "_stage")
    stage("three", 1, ["source"])
    assert made[4:] == ["three"] * 3


def all_files(root):
    return {
        os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names
    }


def test_corpus_job_rewrites_only_what_changed(spark, tmp_path):
    clips = tmp_path / "rec"
    clips.mkdir()
    for k in range(20):
        (clips / f"{k}.wav").touch()
    rows = spark.range(25).select(
        F.concat(F.lit("x/"), F.col("id").cast("string"), F.lit(".wav")).alias("p"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"),
    )
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    write_results_csv(rows, source)

    def run(**more):
        return prepare_corpus(
            spark, source, out, "rec", path_column="p", text_column="t", cwd=str(tmp_path), **more
        )

    assert run().records.count() == 20
    before = all_files(out)
    run()
    assert all_files(out) == before
    made = run(test_size=0.5, seed=1)
    assert made.records.where("split = 'test'").count() == 10
    after = all_files(out)
    assert {k: v for k, v in after.items() if "/clean/" in k} == {
        k: v for k, v in before.items() if "/clean/" in k
    }
    (clips / "20.wav").touch()
    made = run(test_size=0.5, seed=1)
    assert made.records.count() == 21
    assert made.missing.count() == 4
    with pytest.raises(ValueError, match="empty parts"):
        run(files=spark.createDataFrame([("/nowhere.wav",)], "path string"))


def test_word_mark_policies(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1.wav", "a|b c", 0), ("2.wav", "d", 0), ("3.wav", "|e", 1)], "p string, t string, test int"
    )
    source = str(tmp_path / "source")
    write_results_csv(rows, source)

    def run(policy):
        return prepare_flagged_corpus(
            spark, source, str(tmp_path / "out"), "r", "p", "t", word_mark=policy
        )

    with pytest.raises(ValueError, match="2 texts hold the word mark"):
        run("reject")
    assert not (tmp_path / "out" / "corpus").exists()
    for policy, first in (("drop", "ab c"), ("space", "a b c")):
        made = run(policy)
        assert made.marked == 2
        texts = {r.audio: r.text for r in made.records.collect()}
        assert texts["r/1.wav"] == first
        assert "|" not in "".join(texts.values())
        assert made.vocab.where("ch = '|'").count() == 1
    with pytest.raises(ValueError, match="policy"):
        run("other")
