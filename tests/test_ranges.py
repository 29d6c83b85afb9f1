"""Large files read by many tasks give the rows that one task gives."""

import json

import pytest
from pyspark.sql import functions as F

from hearken.sources import read_annotations_csv, read_annotations_json
from hearken.sources.ranges import CSV, JSON_ARRAY, read_records

AWKWARD = [
    "plain",
    'quoted "words" here',
    "two\nlines",
    "three\n\n\"lines\"\r\nmore",
    "a,b;c",
    "braces } { in \\ text \\\" }",
    "}{",
    "",
    " blank ends ",
    "é 日本 😀",
    "x" * 700 + "\n" * 3 + "y" * 700,
    "\\",
    '"',
    "[{}]",
    None,
]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(n=8):
    return [(f"rec/{k}-{i}.wav", text) for k in range(n) for i, text in enumerate(AWKWARD)]


def counted(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("bom", ["", "﻿"])
def test_csv(spark, tmp_path, small_ranges, end, bom):
    def cell(x):
        return "" if x is None else '"' + x.replace('"', '""') + '"'

    for k in range(2):
        lines = ["text,audio_path"] + [f"{cell(t)},{p}" for p, t in rows_of()]
        # one file ends with its last record, the other with a line break
        text = bom + end.join(lines) + end * k
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    whole = read_annotations_csv(spark, str(tmp_path))
    got = read_annotations_csv(spark, str(tmp_path), in_ranges=True)
    assert got.columns == whole.columns
    assert counted(got) == counted(whole)
    assert got.count() == 2 * len(rows_of())
    ranges = read_records(spark, str(tmp_path), CSV)[0].select("file", "range").distinct().count()
    assert ranges > 5


@pytest.mark.parametrize("indent", [None, 1])
def test_json(spark, tmp_path, small_ranges, indent):
    records = [
        {"audio_path": p, "text": t, "more": {"a": [{"b": "}"}, {}], "c": '{"'}}
        for p, t in rows_of()
    ]
    for k in range(2):
        text = json.dumps(records, ensure_ascii=k == 0, indent=indent) + "\n" * k
        (tmp_path / f"{k}.json").write_text(text)
    (tmp_path / "empty.json").write_text("[]")
    whole = read_annotations_json(spark, str(tmp_path))
    got = read_annotations_json(spark, str(tmp_path), in_ranges=True)
    assert counted(got) == counted(whole)
    assert got.count() == 2 * len(records)
    records, _ = read_records(spark, str(tmp_path), JSON_ARRAY)
    assert records.select("file", "range").distinct().count() > 5
    assert records.select(F.spark_partition_id()).distinct().count() > 5


def test_broken_files(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('text,audio_path\n"open,' + "x" * 900)
    with pytest.raises(ValueError, match="open quote"):
        read_annotations_csv(spark, str(tmp_path / "a.csv"), in_ranges=True)
    (tmp_path / "a.json").write_text('[{"audio_path": "a", "text": "b"}, {"audio_path": "c"')
    with pytest.raises(ValueError, match="end of the array"):
        read_annotations_json(spark, str(tmp_path / "a.json"), in_ranges=True)
    kept = read_annotations_json(spark, str(tmp_path / "a.json"), mode="quarantine", in_ranges=True)
    rows = {r.audio_path: r._corrupt for r in kept.collect()}
    assert rows["a"] is None
    assert len(rows) == 2


def test_small_ranges_share_tasks(spark, tmp_path, small_ranges):
    rows = [(f"rec/{k}.wav", f"line {k}\nof a text " + "y" * 300) for k in range(1500)]
    lines = ["audio_path,text", *(f'{p},"{t}"' for p, t in rows)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    records, broken = read_records(spark, str(tmp_path / "a.csv"), CSV)
    assert records.rdd.getNumPartitions() < 50
    assert records.select("range").distinct().count() > 200
    assert broken.isEmpty()
    got = read_annotations_csv(spark, str(tmp_path / "a.csv"), in_ranges=True)
    assert counted(got) == sorted(map(repr, rows))
