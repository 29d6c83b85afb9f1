"""From raw documents to packed sequences: language, copies, leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearken.llm.common import stored, table
from hearken.llm.language import document_items, fuse
from hearken.llm.ngram_join import jaccard_classes
from hearken.llm.packing import harmonic_packing
from hearken.llm.queries import tokenizer_path
from hearken.llm.secrets import secret_spans
from hearken.llm.tiling import contaminated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MASK = "[SECRET]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that language ID rejects go. lang stays as declared."""
    items = document_items(docs)
    rejected = (
        fuse(items, items.select("text", "declared"))
        .where("rejected")
        .select(F.col("id"), F.col("name"))
        .distinct()
    )
    same = docs["doc_id"].eqNullSafe(rejected["id"]) & (
        F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == rejected["name"]
    )
    return docs.join(rejected, same, "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 and more.

    The one with the smallest id stays. Of rows that agree in id and text one stays; rows of one
    id with different texts are all kept with that id. Rows without an id are in no group and
    stay.
    """
    stay = (
        jaccard_classes(docs, width=5, percent=80)
        .where("doc_id = component_id")
        .select("doc_id")
        .distinct()
    )
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item that tiles cover by half or more."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("name").distinct()
    name = F.sha2(docs["text"], 256)
    return docs.join(leaks, name == leaks["name"], "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each found secret replaced by MASK and n_chars counted again."""
    found = secret_spans(docs.select(*COLUMNS))
    # spans are ordered; what follows the furthest end so far is kept
    pieces = F.expr(
        "aggregate(spans, named_struct('at', 0L, 'parts', cast(array() as array<string>)), "
        "(acc, x) -> named_struct('at', greatest(acc.at, x.end), 'parts', "
        "if(x.start < acc.at, acc.parts, array_append(acc.parts, "
        "substring(text, cast(acc.at + 1 as int), cast(x.start - acc.at as int))))), "
        "acc -> array_append(acc.parts, substring(text, cast(acc.at + 1 as int))))"
    )
    masked = F.when(F.size("spans") > 0, F.array_join(pieces, MASK)).otherwise(F.col("text"))
    return found.withColumn("text", masked).select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.when(F.size("spans") > 0, F.char_length("text").cast("long"))
        .otherwise(F.col("n_chars"))
        .alias("n_chars"),
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids of all documents, packed into sequences of 2048."""
    return harmonic_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express language ID, tiling and tokenizing; the tests compare with plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
