"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearken.llm.best_fit import best_fit_packing
from hearken.llm.common import stored, table
from hearken.llm.cross_align import alignments, link_counts, link_scores
from hearken.llm.fingerprints import fingerprint_report
from hearken.llm.language import identify
from hearken.llm.lexical import ranked_search
from hearken.llm.ngram_join import jaccard_classes
from hearken.llm.packing import harmonic_packing
from hearken.llm.quality import quality_scores
from hearken.llm.repeats import remove_repeats
from hearken.llm.secrets import secret_report
from hearken.llm.tiling import contaminated
from hearken.llm.token_counts import token_counts
from hearken.llm.warc import archive_pages


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_classes(docs, width=3, percent=90)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, tokenizer_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return harmonic_packing(docs, tokenizer_path("byte_bpe_50k.json"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # what remains, as text: a character that was cut in two is replaced
    remains = F.make_valid_utf8(F.col("kept").cast("string"))
    return remove_repeats(docs, length=400).withColumn("text", remains).drop("kept")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, items).drop("name")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = alignments(docs, a, b).withColumn("groups_sha256", digest).drop("groups")
    kept = stored(aligned, "alignments")
    return link_scores(kept, link_counts(kept)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_secret_scans": op8_secret_scans,
    "op9_warc": op9_warc,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_best_fit_packing": op13_best_fit_packing,
}

_TERMS = (
    "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
)

ORACLE_SQL: dict[str, str] = {
    # every document scored for every item
    "op12_ranked_lexical_search": f"""
        with d as (select row_number() over () as r, doc_id, text from documents),
        t as (select r, doc_id, {_TERMS} as term from d),
        lengths as (select r, count(*) as n from t group by r),
        tf as (select r, doc_id, term, count(*) as tf from t group by all),
        df as (select term, count(*) as df from tf group by term),
        c as (select count(*) as docs, cast(sum(n) as bigint) as terms from lengths),
        i as (select row_number() over () as i, item_id, text from benchmark),
        q as (
            select i, item_id, term, count(*) as repeats
            from (select i, item_id, {_TERMS} as term from i) group by all
        ),
        s as (
            select i, item_id, r, doc_id, cast(sum(
                repeats * cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
                * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))
            ) as bigint) as score
            from q join tf using (term) join df using (term) join lengths using (r), c
            group by all
        ),
        ranked as (
            select *, row_number() over (partition by i order by score desc, doc_id, r) as rank
            from s where score > 0
        )
        select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
    """,
    # what must come out of the archives, from the pages themselves
    "op9_warc": """
        with p as (
            select page_id, coalesce(html, '') as html,
                   max(page_id) over (partition by coalesce(html, '')) as last
            from pages
        )
        select page_id, cast(strlen(html) as bigint) as payload_bytes,
               sha1(html) as payload_digest,
               case when strlen(html) >= 1000 and page_id <> last
                    then 'revisit' else 'response' end as record_type,
               case when strlen(html) >= 1000 and page_id <> last then last end as refers_to
        from p
    """,
}
