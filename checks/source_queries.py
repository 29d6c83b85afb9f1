"""Round trips through the readers and writers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from checks.fixtures import SQL_UTT, sql_split, table, texts, utt
from hearken.functions import normalize_full
from hearken.operators import alphabet, ctc_vocab, exact_split, with_existing_audio
from hearken.runtime import scratch_path
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

ROWS_PER_JSON_ARRAY = 1000


def annotations_csv(spark, d):
    path = scratch_path(spark, "csv")
    write_results_csv(utt(spark, d).select("utt_id", "path", "text", "role"), path)
    schema = "path string, text string, role string"
    return read_annotations_csv(spark, path, schema, null_values=["system"])


def annotations_json(spark, d):
    """Files of one array each, every array from a bounded group of rows."""
    path = scratch_path(spark, "json")
    rows = utt(spark, d).select(F.col("path").alias("audio_path"), "text")
    groups = rows.agg(F.ceil(F.count("*") / F.lit(ROWS_PER_JSON_ARRAY)).cast("long")).scalar()
    grouped = rows.groupBy(F.pmod(F.xxhash64("audio_path"), groups).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("audio_path", "text"))).alias("value")
    )
    grouped.write.partitionBy("part").text(path)
    return read_annotations_json(spark, f"{path}/*").select("audio_path", "text")


def jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    utt(spark, d).select(
        F.col("path").alias("audio"), F.col("text").alias("transcription")
    ).write.json(path)
    return read_jsonl(spark, path)


def dataset_dir(spark, d):
    path = scratch_path(spark, "dataset")
    save_dataset(utt(spark, d), path)
    return load_dataset_dir(spark, path).select("utt_id", "path", "ref")


def split_jsonl(spark, d):
    path = scratch_path(spark, "records")
    write_split_jsonl(exact_split(utt(spark, d), "utt_id"), path, "path", "text")
    return read_jsonl(spark, path, "audio string, transcription string, split string")


def manifest(spark, d):
    path = scratch_path(spark, "manifest")
    write_manifest(exact_split(utt(spark, d), "utt_id"), path, "path", "ref")
    return spark.read.text(path).select(F.col("value").alias("line"), "split")


def alphabet_file(spark, d):
    path = scratch_path(spark, "alphabet")
    write_alphabet(alphabet(utt(spark, d), "ref"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def vocab_json(spark, d):
    path = scratch_path(spark, "vocab")
    write_vocab_json(ctc_vocab(utt(spark, d), "ref"), path)
    parsed = spark.read.text(path).select(F.from_json("value", "map<string,int>").alias("m"))
    return parsed.select(F.explode("m").alias("ch", "id"))


def results_csv(spark, d):
    path = scratch_path(spark, "results")
    write_results_csv(utt(spark, d).select("utt_id", "ref", "text"), path, bom=True)
    return read_annotations_csv(spark, path, "text string, utt_id string")


def audio_listing(spark, d):
    """Documents stored in one folder per source, found again through the listing."""
    path = scratch_path(spark, "clips")
    docs = table(spark, d, "documents")
    docs.select("doc_id", "source").write.partitionBy("source").parquet(path)
    found = list_audio(spark, path, "*.parquet").select(
        F.regexp_extract("path", "source=([^/]+)", 1).alias("source")
    )
    return with_existing_audio(docs, found, "source").groupBy("source").agg(
        F.count("*").alias("clips")
    )


def dataset_versions(spark, d):
    """Different contents, the second one published twice, then renamed and retyped ones."""
    root = scratch_path(spark, "versions")
    rows = utt(spark, d)
    publish_version(rows.select("utt_id", "text"), root, "asr")
    publish_version(rows.select("utt_id", "ref"), root, "asr")
    publish_version(rows.select("ref", "utt_id"), root, "asr")
    publish_version(rows.select("utt_id", F.col("ref").alias("words")), root, "asr")
    for kind in ("bigint", "string"):
        publish_version(rows.select("utt_id", F.col("turn").cast(kind)), root, "asr")
    return registry(spark, root).select(
        "name", "version", "rows", F.col("fingerprint").cast("string").alias("fingerprint")
    )


def latest_version(spark, d):
    root = scratch_path(spark, "versions")
    rows = utt(spark, d)
    publish_version(rows.select("utt_id", "text"), root, "asr")
    publish_version(rows.select("utt_id", F.col("ref").alias("text")), root, "asr")
    return read_version(spark, root, "asr")


def row_fingerprint(spark, d):
    docs = texts(spark, d, "documents").select("doc_id", "lang", "text")
    return fingerprint(docs).select(
        "rows", F.col("fingerprint").cast("string").alias("fingerprint")
    )


@contextmanager
def small_files(spark, size: str = "64k"):
    """Ranges of this size, so that the files of the test tables have several."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, (size, "0")):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def _kept(spark, df):
    path = scratch_path(spark, "records")
    save_dataset(df, path)
    return load_dataset_dir(spark, path)


def csv_in_ranges(spark, d):
    """One CSV file with line breaks inside texts, read by many tasks."""
    path = scratch_path(spark, "csv")
    docs = texts(spark, d, "documents").select(F.col("doc_id").cast("string").alias("audio_path"), "text")
    write_results_csv(docs.coalesce(1), path)
    with small_files(spark):
        return _kept(spark, read_annotations_csv(spark, path, in_ranges=True))


def json_in_ranges(spark, d):
    """One JSON array, a file of all utterances, read by many tasks."""
    path = scratch_path(spark, "json")
    rows = utt(spark, d).select(F.col("path").alias("audio_path"), "text")
    lines = rows.select(F.to_json(F.struct("audio_path", "text")).alias("value"))
    # the first record opens the array, the last line closes it: one task writes the file
    opened = spark.range(1).select(F.lit("[{}").alias("value"))
    closed = spark.range(1).select(F.lit("]").alias("value"))
    later = lines.select(F.concat(F.lit(","), "value").alias("value"))
    opened.unionByName(later).unionByName(closed).coalesce(1).write.text(path)
    with small_files(spark, "16k"):
        found = read_annotations_json(spark, path, in_ranges=True)
        return _kept(spark, found.where("audio_path is not null"))


def bad_json_files(spark, d):
    """Files of one array each, some cut short. A task writes its files into one folder, so there
    are as many folders to move and to list as tasks, not as conversations."""
    path = scratch_path(spark, "json")
    # a number of its own: these tasks have little to read but many files to make
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = utt(spark, d).repartition(tasks, "conv_id").groupBy("conv_id").agg(
        F.min("turn").alias("turn"), F.to_json(F.collect_list(F.struct("path"))).alias("value")
    )
    cut = F.when(F.col("conv_id") % 3 == 0, F.expr("left(value, length(value) - 2)"))
    rows.select(
        F.spark_partition_id().alias("part"), cut.otherwise(F.col("value")).alias("value")
    ).write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    found = read_annotations_json(spark, f"{path}/*", "path string", mode="quarantine")
    bad = F.col("_corrupt").isNotNull()
    return found.groupBy(bad.alias("bad")).agg(
        F.count("*").alias("rows"), F.count("path").alias("paths")
    )


def bad_json_lines(spark, d):
    """JSON lines, some of them cut short."""
    path = scratch_path(spark, "jsonl")
    line = F.to_json(F.struct(F.col("path").alias("audio"), F.col("ref").alias("transcription")))
    cut = F.when(F.col("turn") % 3 == 0, F.left("line", F.lit(20))).otherwise(F.col("line"))
    rows = utt(spark, d).withColumn("line", line).select(cut.alias("value"))
    rows.write.text(path)
    found = read_jsonl(spark, path, mode="quarantine")
    return found.select("audio", "transcription", "_corrupt")


def _touch(frames):
    """Write small files at the paths of a table: names and sizes are what is looked for."""
    from pathlib import Path

    for frame in frames:
        for path, size in zip(frame["path"], frame["size"]):
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            Path(path).write_bytes(b"." * int(size))
        yield frame[["path"]]


def clip_name(doc_id):
    """Names that readers of tables take for hidden, among others."""
    return F.concat(F.element_at(F.array(F.lit(""), F.lit("_"), F.lit(".")), (doc_id % 3 + 1).cast("int")),
                    doc_id.cast("string"), F.lit(".wav"))


def touch_clips(spark, rows):
    rows.mapInPandas(_touch, "path string").write.format("noop").mode("overwrite").save()


def listed_files(spark, d):
    """Clips in nested folders: empty ones, and names that begin with a dot or an underscore."""
    root = scratch_path(spark, "clips").removeprefix("file:")
    doc_id = F.col("doc_id")
    folder = F.concat_ws("/", F.lit(root), "source", (doc_id % 5).cast("string"))
    rows = table(spark, d, "documents").select(
        F.concat_ws("/", folder, clip_name(doc_id)).alias("path"), (doc_id % 4).alias("size")
    )
    touch_clips(spark, rows)
    touch_clips(spark, rows.limit(3).withColumn("path", F.concat("path", F.lit(".txt"))))
    found = list_audio(spark, root)
    return found.select(F.regexp_extract("path", "[^/]+/[^/]+/[^/]+$", 0).alias("path"), "length")


def stage_after_change(spark, d):
    """A stage that is asked for with other arguments is made anew, and so is the one after it."""
    root = scratch_path(spark, "stages")
    rows = utt(spark, d)

    def run(shift: int):
        first = materialize_once(
            spark,
            f"{root}/first",
            lambda: rows.select("utt_id", (F.col("turn") + shift).alias("turn")),
            arguments={"shift": shift},
        )
        return materialize_once(
            spark,
            f"{root}/second",
            lambda: first.select("utt_id", (F.col("turn") * 2).alias("twice")),
            inputs=[f"{root}/first"],
        )

    run(1)
    return run(5)


def stage_once(spark, d):
    path = scratch_path(spark, "stage")
    materialize_once(spark, path, lambda: utt(spark, d).select("utt_id", normalize_full("text").alias("ref")))
    return materialize_once(spark, path, lambda: 1 / 0)


def _sql_fingerprint(cells: str, source: str) -> str:
    number = f"('0x' || left(md5({cells}),15))::bigint"
    return f"select count(*) as rows, sum({number})::varchar as fingerprint from {source}"


def _cells(**columns: str) -> str:
    """Cells of columns, by name: type and, if it is another, SQL of the value."""
    parts = {n: (*t.split(" ", 1), n)[:2] for n, t in columns.items()}
    return " || '|' || ".join(
        f"'{n}:{kind}=' || length(({value})::varchar) || ':' || ({value})"
        for n, (kind, value) in parts.items()
    )


SQL_NAME = "['', '_', '.'][(doc_id % 3 + 1)::int] || doc_id || '.wav'"

QUERIES = {
    "annotations_csv_in_ranges": (
        csv_in_ranges,
        "select doc_id::varchar as audio_path, nullif(text, '') as text from documents",
    ),
    "annotations_json_in_ranges": (
        json_in_ranges,
        f"with {SQL_UTT} select path as audio_path, text from utt",
    ),
    "json_bad_files": (
        bad_json_files,
        """select bad, count(*) filter (not bad or first) as rows,
          count(*) filter (not bad) as paths
        from (select conv_id % 3 = 0 as bad,
                row_number() over (partition by conv_id) = 1 as first from conversations)
        group by bad""",
    ),
    "jsonl_bad_lines": (
        bad_json_lines,
        f"""with {SQL_UTT}, lines as (
          select path, ref, turn, '{{"audio":"' || path || '"' as line from utt)
        select case when turn % 3 <> 0 then path end as audio,
          case when turn % 3 <> 0 then ref end as transcription,
          case when turn % 3 = 0 then left(line, 20) end as _corrupt from lines""",
    ),
    "audio_listing_files": (
        listed_files,
        f"""select source || '/' || (doc_id % 5) || '/' || {SQL_NAME} as path,
          doc_id % 4 as length from documents""",
    ),
    "stage_after_change": (
        stage_after_change,
        f"with {SQL_UTT} select utt_id, (turn + 5) * 2 as twice from utt",
    ),
    "annotations_csv_round_trip": (
        annotations_csv,
        f"with {SQL_UTT} select path, text, nullif(role,'system') as role from utt",
    ),
    "annotations_json_round_trip": (
        annotations_json,
        f"with {SQL_UTT} select path as audio_path, text from utt",
    ),
    "jsonl_round_trip": (
        jsonl,
        f"with {SQL_UTT} select path as audio, text as transcription from utt",
    ),
    "dataset_round_trip": (dataset_dir, f"with {SQL_UTT} select utt_id, path, ref from utt"),
    "split_jsonl_round_trip": (
        split_jsonl,
        f"""with {SQL_UTT}, s as ({sql_split('utt', 'utt_id')})
        select path as audio, text as transcription, split from s""",
    ),
    "manifest_round_trip": (
        manifest,
        f"""with {SQL_UTT}, s as ({sql_split('utt', 'utt_id')})
        select path || '|' || ref as line, split from s""",
    ),
    "alphabet_file_round_trip": (
        alphabet_file,
        f"""with {SQL_UTT} select '_' as line union all
        select distinct unnest(string_split(ref,'')) from utt where ref <> ''""",
    ),
    "vocab_json_round_trip": (
        vocab_json,
        f"""with {SQL_UTT},
        chars as (select distinct unnest(string_split(ref,'')) ch from utt where ref <> '')
        select case when ch=' ' then '|' else ch end as ch,
               (row_number() over (order by ch) - 1)::int as id from chars
        union all select '[UNK]', count(*)::int from chars
        union all select '[PAD]', count(*)::int + 1 from chars""",
    ),
    "results_csv_round_trip": (results_csv, f"with {SQL_UTT} select text, utt_id from utt"),
    "audio_listing": (
        audio_listing,
        "select source, count(*) as clips from documents group by source",
    ),
    "dataset_versions": (
        dataset_versions,
        f"""with {SQL_UTT},
        one as ({_sql_fingerprint(_cells(text='string', utt_id='string'), 'utt')}),
        two as ({_sql_fingerprint(_cells(ref='string', utt_id='string'), 'utt')}),
        three as ({_sql_fingerprint(_cells(utt_id='string', words='string ref'), 'utt')}),
        four as ({_sql_fingerprint(_cells(turn='bigint', utt_id='string'), 'utt')}),
        five as ({_sql_fingerprint(_cells(turn='string', utt_id='string'), 'utt')})
        select 'asr' as name, 1 as version, rows, fingerprint from one
        union all select 'asr', 2, rows, fingerprint from two
        union all select 'asr', 3, rows, fingerprint from three
        union all select 'asr', 4, rows, fingerprint from four
        union all select 'asr', 5, rows, fingerprint from five""",
    ),
    "latest_version": (latest_version, f"with {SQL_UTT} select utt_id, ref as text from utt"),
    "dataset_fingerprint": (
        row_fingerprint,
        _sql_fingerprint(_cells(doc_id="bigint", lang="string", text="string"), "documents"),
    ),
    "stage_once": (stage_once, f"with {SQL_UTT} select utt_id, ref from utt"),
}
