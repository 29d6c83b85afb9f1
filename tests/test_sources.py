"""Files as they lie on disk."""

import glob
import json
import os

import pytest

from hearken import runtime
from hearken.operators import alphabet, ctc_vocab
from hearken.sources import (
    fingerprint,
    list_audio,
    load_dataset_dir,
    materialize_once,
    publish_version,
    read_annotations_csv,
    read_annotations_json,
    read_jsonl,
    read_version,
    registry,
    save_dataset,
    write_alphabet,
    write_manifest,
    write_results_csv,
    write_split_jsonl,
    write_vocab_json,
)

NASTY = ['quote " and "" two', "line\nbreak", " blanks ", "comma, semi;", "back\\slash", "Ёж|«да»", ""]


def lines(path):
    found = []
    for name in sorted(glob.glob(f"{path}/part-*")):
        with open(name, encoding="utf-8") as f:
            found += f.read().splitlines()
    return found


def test_csv_by_name_with_null_words_and_bad_numbers(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text(
        'id,test,Расшифровка,Путь к файлу\n1,0,"Да, ""нет""\nточно",x.wav\n2,NA,NA,y.wav\n3,1,,z.wav\n',
        encoding="utf-8",
    )
    schema = "`Путь к файлу` string, `Расшифровка` string, test int"
    df = read_annotations_csv(spark, str(file), schema, null_values=["NA"])
    assert [tuple(r) for r in df.collect()] == [
        ("x.wav", 'Да, "нет"\nточно', 0), ("y.wav", None, None), ("z.wav", None, 1)
    ]
    with pytest.raises(ValueError, match="missing columns"):
        read_annotations_csv(spark, str(file), "text string")


@pytest.mark.parametrize("bom", [False, True])
def test_results_csv_round_trip(spark, tmp_path, bom):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(NASTY)], "text string, n int")
    path = str(tmp_path / "out")
    write_results_csv(df, path, bom=bom)
    part = next(f for f in glob.glob(f"{path}/part-*") if os.path.getsize(f))
    with open(part, "rb") as f:
        assert f.read(3) == (b"\xef\xbb\xbf" if bom else b"tex")
    back = read_annotations_csv(spark, path, "n int, text string").orderBy("n").collect()
    # an empty field counts as missing, quoted or not
    assert [r["text"] for r in back] == [t or None for t in NASTY]


def test_json_array(spark, tmp_path):
    file = tmp_path / "a.json"
    rows = [{"audio_path": f"{i}.wav", "text": t} for i, t in enumerate(NASTY)]
    file.write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")
    back = read_annotations_json(spark, str(file)).orderBy("audio_path").collect()
    assert [r["text"] for r in back] == NASTY


def test_split_records_and_manifest(spark, tmp_path):
    df = spark.createDataFrame(
        [("a.wav", "Ёж", "train"), ("b.wav", "да", "test")], "audio string, text string, split string"
    )
    write_split_jsonl(df, str(tmp_path / "r"), "audio", "text")
    assert lines(tmp_path / "r" / "split=train") == ['{"audio":"a.wav","transcription":"Ёж"}']
    back = read_jsonl(spark, str(tmp_path / "r"), "audio string, transcription string, split string")
    only_test = back.where("split = 'test'")
    assert [tuple(r) for r in only_test.collect()] == [("b.wav", "да", "test")]
    assert "PartitionFilters: [isnotnull(split" in only_test._jdf.queryExecution().toString()
    write_manifest(df, str(tmp_path / "m"))
    assert lines(tmp_path / "m" / "split=test") == ["b.wav|да"]


def test_alphabet_and_vocabulary_files(spark, tmp_path):
    df = spark.createDataFrame([("яб а",), ("ёa",)], "text string")
    order = sorted(set("яб аёa"))
    write_alphabet(alphabet(df), str(tmp_path / "a"))
    assert lines(tmp_path / "a") == ["_", *order]
    write_alphabet(alphabet(df), str(tmp_path / "b"), extra_space=True)
    assert lines(tmp_path / "b") == ["_", *order, " "]
    write_vocab_json(ctc_vocab(df), str(tmp_path / "v"))
    (text,) = lines(tmp_path / "v")
    wanted = {("|" if c == " " else c): i for i, c in enumerate(order)}
    assert json.loads(text) == wanted | {"[UNK]": 6, "[PAD]": 7}
    assert "я" in text


def test_listing_selects_no_content(spark, tmp_path):
    for name in ("a.wav", "sub/b.wav", "c.txt"):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(b"12")
    found = list_audio(spark, str(tmp_path))
    assert sorted((os.path.relpath(r["path"], tmp_path), r["length"]) for r in found.collect()) == [
        ("a.wav", 2), ("sub/b.wav", 2)
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "n int, t string")
    two = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    assert publish_version(one, root, "x") == 1
    assert publish_version(one.repartition(3).select("t", "n"), root, "x") == 1
    assert publish_version(two, root, "x") == 2
    assert publish_version(two, root, "y") == 1
    assert read_version(spark, root, "x").count() == 2
    assert read_version(spark, root, "x", 1).count() == 3
    assert registry(spark, root).count() == 3
    with pytest.raises(LookupError):
        read_version(spark, root, "z")


def test_fingerprint_tells_contents_apart(spark):
    def of(rows, schema="a string, b string"):
        return tuple(fingerprint(spark.createDataFrame(rows, schema)).first())

    assert of([("x", "y"), ("u", "v")]) == of([("u", "v"), ("x", "y")])
    assert of([("x|", "y")]) != of([("x", "|y")])
    assert of([("x", None)]) != of([("x", "-")])
    assert of([("x", "y"), ("x", "y")]) != of([])
    assert of([(["a", "b"],)], "l array<string>") != of([(["a, b"],)], "l array<string>")


def test_stage_runs_once_and_again_after_a_half_write(spark, tmp_path):
    path = str(tmp_path / "stage")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert materialize_once(spark, path, build, enabled=False) is None
    assert materialize_once(spark, path, build).count() == 3
    assert materialize_once(spark, path, build, enabled=False).count() == 3
    assert len(calls) == 1
    os.remove(f"{path}/_SUCCESS")
    assert materialize_once(spark, path, build).count() == 3
    assert len(calls) == 2


def test_dataset_folder(spark, tmp_path):
    save_dataset(spark.range(5), str(tmp_path / "d"))
    assert load_dataset_dir(spark, str(tmp_path / "d"), "id long").count() == 5


class Session:
    """Just what the folder lookup asks of a session."""

    def __init__(self, master, named):
        self.master, self.named, self.sparkContext = master, named, self
        self.conf = self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.named

    def getCheckpointDir(self):
        return getattr(self, "folder", None)

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session(tmp_path):
    named = Session("spark://host:7077", f"{tmp_path}/")
    assert runtime.scratch_path(named, "x").startswith(f"{tmp_path}/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Session("spark://host:7077", None))
    local = Session("local[2]", None)
    assert runtime.shared_folder(local) == runtime.shared_folder(local) == local.folder


def test_broken_json_is_an_error_or_set_apart(spark, tmp_path):
    cut, lines = tmp_path / "cut.json", tmp_path / "lines.json"
    cut.write_text('[{"audio_path": "a", "text": "x"}, {"audio_path": "b", "te')
    lines.write_text('{"audio": "a", "transcription": "x"}\n{"audio": "b", "tr\n')
    for read, path, good in ((read_annotations_json, cut, 0), (read_jsonl, lines, 1)):
        with pytest.raises(Exception):
            read(spark, str(path)).collect()
        rows = read(spark, str(path), mode="quarantine").collect()
        assert sum(r["_corrupt"] is None for r in rows) >= good
        assert any(r["_corrupt"] for r in rows)


def test_misfits_in_csv_are_an_error_or_set_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("p,n\nx,1\ny,two\n")
    read = lambda **k: read_annotations_csv(spark, str(tmp_path), "p string, n int", **k)
    with pytest.raises(Exception):
        read().collect()
    rows = {r.p: (r.n, r["_corrupt"]) for r in read(mode="quarantine").collect()}
    assert rows["x"] == (1, None) and rows["y"][0] is None and "two" in rows["y"][1]
