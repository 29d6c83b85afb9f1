"""Text functions against Python's own Unicode rules."""

import os
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hearken.functions import (
    absolute_path,
    fill_template,
    merge_request,
    normalize_cyrillic,
    normalize_full,
    normalize_punct,
    percent,
    prefix_path,
    rebase_path,
    render_chat,
    strip,
    strip_lower,
)


def column_of(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(rows.select("i", make("x").alias("y")).collect())]


LITERAL = [
    ("Приём, поезд 2034!", "приём поезд 2034", "приём поезд ", "приём поезд 2034"),
    ("кое-что  «Ёлка»", "коечто ёлка", "коечто  ёлка", "коечто  ёлка"),
    ("?!", "", "", ""),
    (None, "", None, None),
]


def test_literal_rows(spark):
    texts = [row[0] for row in LITERAL]
    assert column_of(spark, texts, normalize_full) == [r[1] for r in LITERAL]
    assert column_of(spark, texts, normalize_cyrillic) == [r[2] for r in LITERAL]
    assert column_of(spark, texts, normalize_punct) == [r[3] for r in LITERAL]


def python_full(text):
    kept = re.sub(r"[^\w\s]", "", text.lower())
    return re.sub(r"\s+", " ", kept).strip()


ALPHABETS = st.text(
    st.sampled_from("aZ09_ ёЁЖя-—«»…,.!?\t\n\x1c\x85\xa0  　éßñ٣Ⅷ中+=$|{}\"'")
)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ALPHABETS, min_size=1, max_size=40))
def test_same_as_python(spark, texts):
    full = column_of(spark, texts, normalize_full)
    assert full == [python_full(t) for t in texts]
    assert column_of(spark, full, normalize_full) == full
    assert column_of(spark, texts, normalize_cyrillic) == [
        re.sub("[^Ѐ-ӿ\\s]", "", t).lower() for t in texts
    ]
    assert column_of(spark, texts, normalize_punct) == [
        re.sub(r'[,?!.\-;:"«»]', "", t).lower() for t in texts
    ]
    assert column_of(spark, texts, strip) == [t.strip() for t in texts]
    assert column_of(spark, texts, strip_lower) == [t.strip().lower() for t in texts]


def test_every_whitespace_and_word_character_of_the_plane(spark):
    """All characters up to U+FFFF, but for those newer than the JVM's tables."""
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    kept = column_of(spark, [f"a{c}b" for c in chars], normalize_full)
    wrong = [c for c, k in zip(chars, kept) if k != python_full(f"a{c}b")]
    assert len(wrong) <= 61
    assert not [c for c in wrong if ord(c) < 0x530]


@pytest.mark.parametrize(
    "path", ["rec/1.wav", "a/../b", "/x/./y/", "//net/a", "///a", "../../..", "a//b", "", "."]
)
def test_absolute_path(spark, path):
    got = column_of(spark, [path], lambda c: absolute_path(c, "/data/set"))
    assert got == [os.path.normpath(os.path.join("/data/set", path))]


def test_other_paths(spark):
    paths = ["a/b/1.wav", "1.wav", "a/b/", "a/.", "", None]
    assert column_of(spark, paths, lambda c: rebase_path(c, "/new/")) == [
        "/new/1.wav", "/new/1.wav", "/new/b", "/new/a", "/new", None
    ]
    assert column_of(spark, ["x.wav", None], lambda c: prefix_path(c, "../../data")) == [
        "../../data/x.wav", None
    ]


def test_templates_keep_braces_of_values(spark):
    make = lambda c: fill_template("{{{a}}}: {b}/{a}", a=c, b=F.lit("{a}"))
    assert column_of(spark, ["{b}", "x"], make) == ["{{b}}: {a}/{b}", "{x}: {a}/x"]
    with pytest.raises(KeyError):
        fill_template("{missing}", a=F.lit(""))


def test_chat(spark):
    messages = spark.range(1).select(merge_request(F.lit("раз"), F.lit("два"), "Merge.").alias("m"))
    row = messages.select("m", render_chat("m").alias("p")).first()
    assert [m["role"] for m in row["m"]] == ["system", "user"]
    assert row["m"][1]["content"] == 'Версия А: "раз"\n\nВерсия Б: "два"'
    assert row["p"].startswith("<|system|>\nMerge.\n<|user|>\n")
    assert row["p"].endswith("<|assistant|>\n")


def test_percent(spark):
    assert spark.range(1).select(percent(F.lit(0.123456))).first()[0] == 12.35


def test_column_functions_accept_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("А, б!",)], "text string").write.json(source)
    stream = spark.readStream.schema("text string").json(source)
    query = (
        stream.select(normalize_full("text").alias("n"))
        .writeStream.format("memory").queryName("cleaned")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert [r["n"] for r in spark.table("cleaned").collect()] == ["а б"]
