"""Whole jobs, from files written out of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    SQL_CLIPS,
    SQL_EDITS,
    SQL_HYP,
    SQL_LAB,
    SQL_UTT,
    SQL_WIDE,
    SYSTEMS,
    hyp,
    lab,
    present,
    sql_norm,
    sql_raw_words,
    sql_split,
    sql_words,
    table,
    texts,
    utt,
)
from checks.prepare_queries import INSTRUCTION_TEMPLATE, PREFERENCE_TEMPLATE
from checks.score_queries import sql_rover
from checks.source_queries import ROWS_PER_JSON_ARRAY, SQL_NAME, clip_name, touch_clips
from checks.text_queries import joined, sql_vocab
from hearken.plans import (
    build_instruction_set,
    build_preference_set,
    evaluate_raw,
    evaluate_systems,
    prepare_corpus,
    prepare_flagged_corpus,
    prepare_json_corpus,
)
from hearken.plans.corpus import FLAG_COLUMN, PATH_COLUMN, TEXT_COLUMN
from hearken.runtime import scratch_path
from hearken.sources import write_results_csv


def _document_csv(spark, d):
    source = scratch_path(spark, "annotations")
    path = F.concat(F.lit("old/place/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    rows = texts(spark, d, "documents").select(
        path.alias(PATH_COLUMN), F.col("text").alias(TEXT_COLUMN)
    )
    write_results_csv(rows, source)
    return source


def _prepared(spark, d):
    return prepare_corpus(
        spark, _document_csv(spark, d), scratch_path(spark, "corpus"), "rec", present(spark, d)
    )


def corpus(spark, d):
    return _prepared(spark, d).records.select("audio", "transcription", "split")


def corpus_report(spark, d):
    return _prepared(spark, d).report


def corpus_listed(spark, d):
    """The job over real files, some hidden or empty, by paths that need folding; run twice on
    one folder, the second time with another split."""
    root = scratch_path(spark, "audio").removeprefix("file:")
    labelled = table(spark, d, "labels").select("doc_id").distinct()
    rows = labelled.select(
        F.concat(F.lit(f"{root}/rec/"), clip_name(F.col("doc_id"))).alias("path"),
        (F.col("doc_id") % 2).alias("size"),
    )
    touch_clips(spark, rows)
    source = scratch_path(spark, "annotations")
    docs = texts(spark, d, "documents").select(
        F.concat(F.lit("old/place/"), clip_name(F.col("doc_id"))).alias(PATH_COLUMN),
        F.col("text").alias(TEXT_COLUMN),
    )
    write_results_csv(docs, source)
    out = scratch_path(spark, "corpus")

    def run(test_size, seed):
        return prepare_corpus(
            spark, source, out, "./x/../rec", cwd=root, test_size=test_size, seed=seed
        )

    run(0.1, 42)
    return run(0.2, 7).records.select(
        F.regexp_replace("audio", "^.*/", "").alias("audio"), "transcription", "split"
    )


def corpus_manifest(spark, d):
    out = scratch_path(spark, "corpus")
    prepare_corpus(spark, _document_csv(spark, d), out, "rec", present(spark, d), cwd="/data")
    lines = spark.read.text(f"{out}/manifest")
    letters = spark.read.text(f"{out}/alphabet").select("value", F.lit("alphabet").alias("split"))
    return lines.unionByName(letters).select(F.col("value").alias("line"), "split")


def cyrillic_corpus(spark, d):
    source = scratch_path(spark, "annotations")
    rows = utt(spark, d).select(F.col("path").alias("audio_path"), F.col("cyr").alias("text"))
    groups = rows.agg(F.ceil(F.count("*") / F.lit(ROWS_PER_JSON_ARRAY)).cast("long")).scalar()
    rows.groupBy(F.pmod(F.xxhash64("audio_path"), groups).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("audio_path", "text"))).alias("value")
    ).write.partitionBy("part").text(source)
    return prepare_json_corpus(spark, f"{source}/*", scratch_path(spark, "corpus"))


def labelled_corpus(spark, d):
    source = scratch_path(spark, "annotations")
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".wav"))
    rows = lab(spark, d).select(
        path.alias(PATH_COLUMN),
        F.col("text").alias(TEXT_COLUMN),
        F.col("test").alias(FLAG_COLUMN),
    )
    write_results_csv(rows, source)
    made = prepare_flagged_corpus(
        spark, source, scratch_path(spark, "corpus"), "../../data", word_mark="drop"
    )
    return made.records.select(
        "audio", "text", "split", F.md5(joined(F.col("labels"))).alias("labels")
    )


def labelled_vocab(spark, d):
    """The vocabulary file of the job, and how many texts held the word mark."""
    source, out = scratch_path(spark, "annotations"), scratch_path(spark, "corpus")
    rows = lab(spark, d).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias(PATH_COLUMN),
        F.concat("text", F.lit("|")).alias(TEXT_COLUMN),
        F.col("test").alias(FLAG_COLUMN),
    )
    write_results_csv(rows, source)
    made = prepare_flagged_corpus(spark, source, out, "../../data", word_mark="space")
    parsed = spark.read.text(f"{out}/vocab_json").select(
        F.explode(F.from_json("value", "map<string,int>")).alias("ch", "id")
    )
    return parsed.withColumn("marked", F.lit(made.marked).cast("long"))


def _records(spark, d):
    return utt(spark, d).select(
        F.col("path").alias("audio"), F.col("ref").alias("transcription")
    )


def _segments(spark, d):
    """Output of system a, one segment per word with a leading blank."""
    heard = hyp(spark, d).where("system = 'a'").join(
        utt(spark, d).select("utt_id", F.col("path").alias("audio")), "utt_id"
    )
    return heard.select("audio", F.posexplode(F.split("hyp", " ")).alias("seg_no", "w")).select(
        "audio", "seg_no", F.concat(F.lit(" "), "w").alias("text")
    )


def preference_set(spark, d):
    return build_preference_set(
        _records(spark, d),
        _segments(spark, d),
        PREFERENCE_TEMPLATE,
        scratch_path(spark, "preferences"),
        scratch_path(spark, "versions"),
    )


def chat_preference_set(spark, d):
    return build_preference_set(
        _records(spark, d),
        _segments(spark, d),
        PREFERENCE_TEMPLATE,
        scratch_path(spark, "preferences"),
        chat=True,
    ).select(
        F.inline(
            F.transform(
                F.arrays_zip("prompt", "chosen", "rejected"),
                lambda x: F.struct(
                    x["prompt"]["role"].alias("prompt_role"),
                    x["prompt"]["content"].alias("prompt"),
                    x["chosen"]["role"].alias("chosen_role"),
                    x["chosen"]["content"].alias("chosen"),
                    x["rejected"]["content"].alias("rejected"),
                ),
            )
        )
    )


def instruction_set(spark, d):
    return build_instruction_set(
        _records(spark, d),
        _segments(spark, d),
        INSTRUCTION_TEMPLATE,
        scratch_path(spark, "instructions"),
    )


def evaluation(spark, d):
    corrected = hyp(spark, d).where("system = 'c'").select(
        "utt_id", F.concat(F.col("hyp"), F.lit(" !")).alias("corrected")
    )
    made = evaluate_systems(
        utt(spark, d),
        hyp(spark, d),
        SYSTEMS,
        scratch_path(spark, "evaluation"),
        corrected,
        "word_over_null",
    )
    return made.summary


def evaluation_details(spark, d):
    """The stored table of the job, with the texts as given."""
    made = evaluate_systems(
        utt(spark, d).withColumn("ref", F.col("text")),
        hyp(spark, d),
        SYSTEMS,
        scratch_path(spark, "evaluation"),
    )
    return made.details.select("utt_id", "ref", "a", "b", "c", "ref_raw", "a_raw")


def evaluation_prompts(spark, d):
    return evaluate_systems(
        utt(spark, d),
        hyp(spark, d),
        SYSTEMS,
        scratch_path(spark, "evaluation"),
        prompt_system="b",
        prompt_template="Correct this: {instruction}",
    ).prompts


def _raw_outputs(spark, d):
    """Outputs by clip; a system fails on outputs with one letter."""
    said = hyp(spark, d).join(
        utt(spark, d).select("utt_id", F.col("path").alias("audio")), "utt_id"
    )
    failed = F.when(F.col("hyp").contains("ß"), F.lit("failed"))
    return said.select("audio", "system", "hyp", failed.alias("error"))


def _evaluated_raw(spark, d):
    rows = utt(spark, d)
    annotations = rows.select(
        F.col("path").alias("audio"), "text", (F.col("role") == "assistant").cast("int").alias("test")
    )
    files = rows.where(~F.col("text").contains("ç")).select("path")
    return evaluate_raw(
        annotations,
        files,
        _raw_outputs(spark, d),
        SYSTEMS,
        scratch_path(spark, "evaluation"),
        merge=("a", "b"),
        merge_text="Merge both versions.",
    )


def raw_evaluation(spark, d):
    return _evaluated_raw(spark, d).summary


def raw_left_out(spark, d):
    """Clips without scores and outputs that failed, as the job reports them."""
    made = _evaluated_raw(spark, d)
    skipped = made.skipped.select("audio", F.lit(None).cast("string").alias("system"))
    return skipped.unionByName(made.errors.select("audio", "system"))


def raw_merges(spark, d):
    made = _evaluated_raw(spark, d).merges
    return made.select(
        "audio",
        F.col("messages")[0]["content"].alias("system_text"),
        F.col("messages")[1]["content"].alias("user_text"),
    )


SQL_KEPT = f"""{SQL_CLIPS}, cleaned as (
  select path, {sql_norm('text')} as text from clips join documents using (doc_id)
  where {sql_norm('text')} <> ''),
kept as (select * from cleaned semi join present using (path)),
corpus as ({sql_split('kept', 'path')})"""

QUERIES = {
    "prepare_corpus": (
        corpus,
        f"""with {SQL_KEPT}
        select path as audio, text as transcription, split from corpus""",
    ),
    "prepare_corpus_report": (
        corpus_report,
        f"""with {SQL_KEPT}
        select (select count(*) from cleaned) as rows_clean, count(*) as rows_found,
          count(*) filter (split='train') as rows_train,
          count(*) filter (split='test') as rows_test from corpus""",
    ),
    "prepare_corpus_listed": (
        corpus_listed,
        f"""with cleaned as (
          select {SQL_NAME} as name, {sql_norm('text')} as text from documents semi join labels using (doc_id)
          where {sql_norm('text')} <> ''),
        kept as (select *, './x/../rec/' || name as path from cleaned)
        select name as audio, text as transcription,
          case when row_number() over (order by md5('7:' || path), path)
            <= ceil(count(*) over () * 0.2::double) then 'test' else 'train' end as split
        from kept""",
    ),
    "prepare_corpus_manifest": (
        corpus_manifest,
        f"""with {SQL_KEPT}
        select '/data/' || path || '|' || text as line, split from corpus
        union all select '_', 'alphabet'
        union all select distinct unnest(string_split(text, '')), 'alphabet'
        from corpus where split = 'train'""",
    ),
    "prepare_json_corpus": (
        cyrillic_corpus,
        f"""with {SQL_UTT}, rows as (select path as audio_path,
          lower(regexp_replace(cyr,'[^\\x{{0400}}-\\x{{04FF}}\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]','','g')) as text
          from utt)
        {sql_split('rows', 'audio_path')}""",
    ),
    "prepare_flagged_corpus": (
        labelled_corpus,
        f"""with {SQL_LAB}, rows as (
          select '../../data/' || doc_id || '.wav' as audio,
            lower(translate(replace(text,'|',''), ',?!.-;:"«»', '')) as text,
            case test when 0 then 'train' else 'eval' end as split
          from lab where test in (0,1) and replace(text,'|','') <> ''),
        train as (select text from rows where split = 'train'),
        {sql_vocab('train')},
        labelled as (select audio, text, split, list_transform(
            list_filter(string_split(text,''), lambda c: c <> ''),
            lambda c: coalesce(list_position(l, c) - 1, len(l))) as ids from rows, letters)
        select audio, text, split, md5(array_to_string(ids, ',')) as labels from labelled""",
    ),
    "prepare_flagged_vocab": (
        labelled_vocab,
        f"""with {SQL_LAB}, rows as (
          select lower(translate(replace(text || '|', '|', ' '), ',?!.-;:"«»', '')) as text, test
          from lab where test in (0,1)),
        train as (select text from rows where test = 0),
        {sql_vocab('train')}
        select ch, id, (select count(*) from rows) as marked from vocab""",
    ),
    "build_chat_preference_set": (
        chat_preference_set,
        f"""with {SQL_UTT}, {SQL_HYP} select 'user' as prompt_role,
        'Correct this transcript: ' || trim(hyp) as prompt, 'assistant' as chosen_role,
        ref as chosen, trim(hyp) as rejected
        from hyp join utt using (utt_id) where system = 'a'""",
    ),
    "build_preference_set": (
        preference_set,
        f"""with {SQL_UTT}, {SQL_HYP} select 'Correct this transcript: ' || trim(hyp) as prompt,
        ref as chosen, trim(hyp) as rejected
        from hyp join utt using (utt_id) where system = 'a'""",
    ),
    "build_instruction_set": (
        instruction_set,
        f"""with {SQL_UTT}, {SQL_HYP}
        select '### Heard:\n' || trim(hyp) || '\n\n### Said:\n' || ref as text
        from hyp join utt using (utt_id) where system = 'a'""",
    ),
    "evaluate_systems": (
        evaluation,
        f"""with recursive {SQL_UTT}, {SQL_HYP}, {SQL_WIDE}, {sql_rover(True)},
        scored as (
          select 'a' as system, ref, a as hyp from wide
          union all select 'b', ref, b from wide
          union all select 'c', ref, c from wide
          union all select 'rover', ref, rover from wide join voted using (utt_id)
          union all select 'corrected', ref, c from wide),
        lists as materialized (select system, {sql_words('ref')} r, {sql_words('hyp')} h from scored)
        select system, 100.0::double * sum({SQL_EDITS}) / sum(len(r)) as wer
        from lists group by system""",
    ),
    "evaluate_systems_details": (
        evaluation_details,
        f"""with {SQL_UTT}, {SQL_HYP}, {SQL_WIDE}
        select utt_id, ref, {sql_norm('a')} as a, {sql_norm('b')} as b, {sql_norm('c')} as c,
          text as ref_raw, a as a_raw from wide join utt using (utt_id, ref)""",
    ),
    "evaluate_systems_prompts": (
        evaluation_prompts,
        f"""with {SQL_UTT}, {SQL_HYP}
        select utt_id, '<|user|>\nCorrect this: ' || hyp || '\n<|assistant|>\n' as prompt
        from hyp where system = 'b'""",
    ),
    "evaluate_raw_left_out": (
        raw_left_out,
        f"""with {SQL_UTT}, {SQL_HYP}, test as (select * from utt where role = 'assistant'),
        complete as (select utt_id from hyp where not contains(hyp, 'ß')
          group by utt_id having count(*) = 3)
        select path as audio, null as system from test
        where contains(text, 'ç') or utt_id not in (select utt_id from complete)
        union all select path, system from hyp join utt using (utt_id) where contains(hyp, 'ß')""",
    ),
    "evaluate_raw_merges": (
        raw_merges,
        f"""with {SQL_UTT}, {SQL_HYP}, {SQL_WIDE},
        complete as (select utt_id from hyp where not contains(hyp, 'ß')
          group by utt_id having count(*) = 3)
        select path as audio, 'Merge both versions.' as system_text,
          'Версия А: "' || a || '"\n\nВерсия Б: "' || b || '"' as user_text
        from wide join utt using (utt_id, ref) semi join complete using (utt_id)
        where role = 'assistant' and not contains(text, 'ç')""",
    ),
    "evaluate_raw": (
        raw_evaluation,
        f"""with {SQL_UTT}, {SQL_HYP}, test as (
          select utt_id, text from utt where role = 'assistant' and not contains(text, 'ç')),
        passed as (select * from hyp where not contains(hyp, 'ß')),
        complete as (select utt_id from passed group by utt_id having count(*) = 3),
        lists as materialized (
          select system, {sql_raw_words('text')} r, {sql_words('hyp')} h
          from passed join test using (utt_id) semi join complete using (utt_id))
        select system, 100.0::double * sum({SQL_EDITS}) / sum(len(r)) as wer
        from lists group by system""",
    ),
}
