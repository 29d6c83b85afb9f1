"""Inputs of many small files are made by many tasks, in few folders."""

from checks import source_queries


def test_files_of_one_array(spark, tmp_path, monkeypatch):
    turns = [(c, t, "user", f"text {t}") for c in [*range(30), None] for t in range(3)]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    kept = tmp_path / "kept"
    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, label: str(kept))
    made = source_queries.bad_json_files(spark, str(tmp_path))
    found = {r.bad: (r.rows, r.paths) for r in made.collect()}
    # turns without a conversation have no path
    assert found == {True: (10, 0), False: (63, 60)}
    files = list(kept.rglob("part-*"))
    assert len([f for f in files if f.is_file()]) == 31
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 1 < len({f.parent for f in files if f.is_file()}) <= tasks


def test_outputs_of_all_systems_on_assembled_rows(spark, tmp_path):
    from checks.prepare_queries import attached

    turns = [(1, 0, "user", "One two"), (1, 1, "user", ""), (2, 0, "user", "b c"), (2, 0, "user", "b c")]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = attached(spark, str(tmp_path)).collect()
    assert sorted((r.utt_id, r.system) for r in got) == [
        *[("1-0", s) for s in "abc"],
        *[("2-0", s) for s in "abc" for _ in range(4)],
    ]
    outputs = {(r.utt_id, r.system): r.out for r in got}
    assert all(r.a == outputs[r.utt_id, "a"] for r in got)
    assert {r.ref for r in got} == {"one two", "b c"}
