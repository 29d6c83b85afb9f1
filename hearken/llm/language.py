"""Language identification by Bayesian fusion of evidence.

Each item has a text and may have a declared language (markup), a host and, by the host, a
domain and an address suffix. The posterior over languages multiplies

* the likelihood of the text under byte trigrams of each language, tempered for its length,
  with a uniform model for what is no language at all,
* P(declared | language) and P(suffix | language), and
* the prior of the host, smoothed towards that of its domain, and that towards the corpus.

Trigram counts come from all labelled documents; the tables of declared languages, suffixes,
hosts and domains from what the texts alone say about all items, all by grouped aggregation.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearken.llm.common import IS_PUNCTUATION, LOWER, stored, text_slices

BUCKETS = 1 << 14
# pseudo-counts of the corpus as a whole in each language's trigrams
BACKGROUND = 4096.0
MOST_LANGUAGES = 2000
SMOOTHING = 20.0
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.001
LEAST_POSTERIOR = 0.5


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash classes of the trigrams of each row, and the range of each row.

    Trigrams hold letters and single spaces for all else, and cross no row.
    """
    letters = np.where(IS_PUNCTUATION[data] | ((data >= 48) & (data <= 57)), 32, LOWER[data])
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    inner = offsets[:-1]
    keep[inner[inner < len(letters)]] = True
    places = np.concatenate([[0], np.cumsum(keep)])
    letters, starts = letters[keep].astype(np.uint32), places[offsets]
    n = max(0, len(letters) - 2)
    code = (letters[:n] << 16) | (letters[1 : n + 1] << 8) | letters[2 : n + 2]
    code = (code * np.uint32(2654435761)) >> np.uint32(18)
    ranges = np.minimum(starts, n)
    ends = np.maximum(np.minimum(starts[1:] - 2, n), ranges[:-1])
    return code.astype(np.int64), np.stack([ranges[:-1], ends])


def _counts(languages: list[str]):
    def work(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            known = batch.column("declared").to_pylist()
            for row, data, offsets in text_slices(batch.column("text")):
                code, (starts, ends) = trigrams(data, offsets)
                for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    total[number[known[row + k]]] += np.bincount(code[a:b], minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])],
            ["lang", "bucket", "n"],
        )

    return work


def trigram_model(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """log P(trigram class | language) from all labelled texts; the last row is uniform.

    Each language is smoothed towards the corpus, so that one with few texts has a model, too.
    """
    counts = (
        labelled.where(F.col("declared").isin(languages))
        .select("declared", "text")
        .mapInArrow(_counts(languages), "lang long, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    # at most BUCKETS rows a language, whatever the corpus
    total = np.zeros((len(languages), BUCKETS))
    for row in counts.toLocalIterator():
        total[row.lang, row.bucket] += row.n
    corpus = total.sum(axis=0) + 0.5
    total += BACKGROUND * corpus / corpus.sum()
    model = np.log(total / total.sum(axis=1, keepdims=True))
    return np.vstack([model, np.full((1, BUCKETS), -math.log(BUCKETS))])


def _score(model):
    def work(batches):
        table = model.value
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text")):
                code, (starts, ends) = trigrams(data, offsets)
                sums = np.concatenate(
                    [np.zeros((len(table), 1)), np.cumsum(table[:, code], axis=1)], axis=1
                )
                n = ends - starts
                # neighbouring trigrams depend on each other: evidence grows with the root
                evidence = (sums[:, ends] - sums[:, starts]) / np.sqrt(np.maximum(1, n))
                others = [batch.column(c).slice(row, len(n)) for c in _KEPT]
                yield pa.RecordBatch.from_arrays(
                    [*others, pa.array(n), pa.array(list(evidence.T), pa.list_(pa.float64()))],
                    [*_KEPT, "n_trigrams", "evidence"],
                )

    return work


_KEPT = ("kind", "id", "name", "declared", "host", "domain", "suffix")


def _zipped(*columns: Column) -> Column:
    out = columns[0]
    for more in columns[1:]:
        out = F.zip_with(out, more, lambda x, y: x + y)
    return out


def _shares(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """Numbers of rows of each key by the language that their text is likeliest in."""
    return rows.groupBy(*key).agg(
        F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(n)]).alias("n")
    )


def _smoothed(own: Column, above: Column) -> Column:
    """(own + SMOOTHING x above) / (sum of own + SMOOTHING)."""
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) + SMOOTHING
    return F.zip_with(own, above, lambda x, p: (x + p * SMOOTHING) / total)


def fuse(items: DataFrame, labelled: DataFrame) -> DataFrame:
    """Language of each of `items(kind, id, name, text, declared, host, domain, suffix)`.

    `labelled(text, declared)` trains the trigrams. Languages are all those declared there,
    however few rows they have; more than MOST_LANGUAGES are no languages and an error, since
    each task holds a model of 128 KB for each. Returns the columns without the text, and lang (UNKNOWN where no
    language model explains the text best), posterior, rejected (UNKNOWN, without any trigram,
    or a posterior under LEAST_POSTERIOR).

    Any column may be null: missing evidence is left out of the product. A null or empty text
    has no trigram and is rejected. Repeated rows are counted and returned as often.
    """
    spark = items.sparkSession
    declared = labelled.where("declared is not null").select("declared").distinct()
    languages = sorted(r.declared for r in declared.limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} declared languages")
    k = len(languages)
    model = spark.sparkContext.broadcast(trigram_model(labelled, languages))
    scored = items.mapInArrow(
        _score(model),
        "kind string, id long, name string, declared string, host string, domain string, "
        "suffix string, n_trigrams long, evidence array<double>",
    )
    top = F.array_position(F.col("evidence"), F.array_max("evidence")).cast("int") - 1
    rows = stored(scored.withColumn("best", top), "languages")
    usable = rows.where(f"best < {k} and n_trigrams > 0")

    base = [1.0] * k
    for row in usable.groupBy("best").count().collect():
        base[row.best] += row["count"]
    base = [x / sum(base) for x in base]
    globally = F.array(*[F.lit(x) for x in base])
    domains = _shares(usable.where("domain is not null"), ["domain"], k).select(
        "domain", _smoothed(F.col("n"), globally).alias("of_domain")
    )
    hosts = (
        _shares(usable.where("host is not null"), ["host", "domain"], k)
        .join(domains, "domain", "left")
        .select(
            "host",
            F.col("domain").alias("host_domain"),
            _smoothed(F.col("n"), F.coalesce("of_domain", globally)).alias("of_host"),
        )
    )

    def conditional(column: str, name: str) -> DataFrame:
        """log P(value | language), up to a factor common to all languages."""
        return _shares(usable.where(F.col(column).isNotNull()), [column], k).select(
            column,
            F.zip_with(
                _smoothed(F.col("n"), globally), globally, lambda x, p: F.log(x / p)
            ).alias(name),
        )

    same_host = (F.col("host") == F.col("host_key")) & F.col("domain").eqNullSafe(
        F.col("host_domain")
    )
    joined = (
        rows.join(hosts.withColumnRenamed("host", "host_key"), same_host, "left")
        .join(conditional("declared", "of_declared"), "declared", "left")
        .join(conditional("suffix", "of_suffix"), "suffix", "left")
    )
    nothing = F.array(*[F.lit(0.0)] * k)
    prior = F.transform(F.coalesce("of_host", globally), lambda p: F.log(p * (1 - UNKNOWN_PRIOR)))
    weight = _zipped(
        F.slice("evidence", 1, k),
        prior,
        F.coalesce("of_declared", nothing),
        F.coalesce("of_suffix", nothing),
    )
    weight = F.concat(weight, F.array(F.col("evidence")[k] + math.log(UNKNOWN_PRIOR)))
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    result = joined.withColumn("weight", weight).withColumn("most", F.array_max("weight"))
    result = result.withColumn(
        "posterior",
        1 / F.aggregate("weight", F.lit(0.0), lambda s, w: s + F.exp(w - F.col("most"))),
    ).withColumn("lang", names[F.array_position("weight", F.col("most")).cast("int") - 1])
    return result.select(
        *_KEPT,
        "lang",
        "posterior",
        (
            (F.col("lang") == UNKNOWN)
            | (F.col("n_trigrams") == 0)
            | (F.col("posterior") < LEAST_POSTERIOR)
        ).alias("rejected"),
    )


def document_items(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text, lang, source, ..)`: lang is declared, the source is the host."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("id"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("name"),
        "text",
        F.col("lang").alias("declared"),
        F.col("source").alias("host"),
        none.alias("domain"),
        none.alias("suffix"),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """`pages(page_id, url, html, ..)`: text outside markup, its language, and the address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)
    some = lambda c: F.when(c != "", c)
    return pages.select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        F.lit(None).cast("string").alias("name"),
        plain.alias("text"),
        some(F.lower(declared)).alias("declared"),
        some(host).alias("host"),
        some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        some(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"),
    )


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of all documents and all pages; trigrams are learnt from the documents.

    Returns kind, doc_id (of documents), page_id (of pages), declared, host, lang, posterior,
    rejected. Empty tables and nulls: see `fuse`; a null id is kept.
    """
    items = document_items(docs)
    found = fuse(items.unionByName(page_items(pages)), items.select("text", "declared"))
    return found.select(
        "kind",
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "declared",
        "host",
        "lang",
        "posterior",
        "rejected",
    )
