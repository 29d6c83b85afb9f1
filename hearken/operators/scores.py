"""Word error rates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearken.functions.words import edit_detail, split_words, word_edits
from hearken.runtime import ColumnLike, as_column, quoted

Normalizer = Callable[[ColumnLike], Column]


def pooled_wer(edits: ColumnLike, ref_words: ColumnLike) -> Column:
    """100 * all edits / all reference words; null when there is no reference word."""
    return F.try_divide(F.lit(100.0) * F.sum(edits), F.sum(ref_words))


def corpus_wer(ref: ColumnLike, hyp: ColumnLike) -> Column:
    """Pooled word error rate in percent, as an aggregate: long texts weigh more.

    An empty hypothesis counts as deletions, an empty reference adds its insertions.
    """
    return pooled_wer(word_edits(ref, hyp), F.size(split_words(ref)))


def utterance_edits(
    hyps: DataFrame,
    refs: DataFrame,
    normalizer: Normalizer | None = None,
    key: str = "utt_id",
    ref: str = "ref",
    hyp: str = "hyp",
    detail: bool = False,
) -> DataFrame:
    """Edits and reference length per utterance and system, from long hypotheses.

    `detail` adds substitutions, deletions and insertions.
    """
    if normalizer is not None:
        refs = refs.withColumn(ref, normalizer(ref))
        hyps = hyps.withColumn(hyp, normalizer(hyp))
    pairs = hyps.join(refs.select(key, ref), key)
    if detail:
        counted = pairs.select(key, "system", edit_detail(ref, hyp).alias("_e"))
        return counted.select(key, "system", "_e.*")
    return pairs.select(
        key,
        "system",
        word_edits(ref, hyp).alias("edits"),
        F.size(split_words(ref)).alias("ref_words"),
    )


def wer_by_system(
    hyps: DataFrame,
    refs: DataFrame,
    normalizer: Normalizer | None = None,
    key: str = "utt_id",
    ref: str = "ref",
    hyp: str = "hyp",
) -> DataFrame:
    """Summary over all systems of a long hypothesis table.

    Sums are formed map-side, so a system with most of the rows costs no more.
    """
    rows = utterance_edits(hyps, refs, normalizer, key, ref, hyp)
    return (
        rows.groupBy("system")
        .agg(
            F.count("*").alias("utterances"),
            F.sum("ref_words").alias("ref_words"),
            F.sum("edits").alias("edits"),
            pooled_wer("edits", "ref_words").alias("wer"),
        )
        .withColumn("wer_2", F.round("wer", 2))
    )


def wer_of_columns(
    df: DataFrame,
    ref: str,
    systems: Sequence[str],
    normalizer: Normalizer | None = None,
    counts: bool = False,
) -> DataFrame:
    """Summary `(system, wer)` over hypothesis columns, all of them in one pass.

    `counts` adds what the rate is made of: `utterances`, `ref_words` and `edits`.
    """
    clean = normalizer or as_column
    places = range(len(systems))
    texts = df.select(
        clean(F.col(quoted(ref))).alias("ref"),
        *[clean(F.col(quoted(s))).alias(f"hyp{i}") for i, s in enumerate(systems)],
    )
    edits = texts.select(
        F.size(split_words("ref")).alias("words"),
        *[word_edits("ref", f"hyp{i}").alias(f"edits{i}") for i in places],
    )
    pooled = edits.agg(
        F.count(F.lit(1)).alias("utterances"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("ref_words"),
        *[F.coalesce(F.sum(f"edits{i}"), F.lit(0)).alias(f"edits{i}") for i in places],
        *[pooled_wer(f"edits{i}", "words").alias(f"wer{i}") for i in places],
    )
    known = [F.col("utterances"), F.col("ref_words")]
    named = [
        F.struct(
            F.lit(s).alias("system"),
            *[*known, F.col(f"edits{i}").alias("edits")][: 3 * counts],
            F.col(f"wer{i}").alias("wer"),
        )
        for i, s in enumerate(systems)
    ]
    return pooled.select(F.inline(F.array(*named)))
