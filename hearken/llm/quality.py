"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it learns from. With the class prior p, the
risk of calling all unlabelled text negative, less the part that positives among it add, is an
unbiased estimate of the risk on negatives; it may not fall below zero (non-negative PU risk,
Kiryo et al. 2017). The model is logistic over standardised features of a text, so gradient
and curvature are sums over rows: every step is one pass over a narrow
table, and only sums of fixed size reach the driver.

The prior is the least ratio of unlabelled to positive mass above any score of a classifier that
tells labelled from unlabelled: where no negatives are, the ratio is the prior itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearken.llm.common import stored, text_slices, word_hashes

STEPS = 12
RIDGE = 4e-3
LABELLED_RIDGE = 3e-2
BINS = 1000
LEAST_MASS = 0.5
DEVIATIONS = 2.0
STEP_SIZES = (1.0, 0.5, 0.25, 0.0625)

_GROUPS = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    ".",
    ",",
    "!?",
    "%&$#*@^~",
    "|<>{}[]=/\\_",
    "\n",
    " \t",
)
_MEMBER = np.zeros((256, len(_GROUPS) + 1))
for _k, _group in enumerate(_GROUPS):
    _MEMBER[[ord(c) for c in _group], _k] = 1
_MEMBER[128:, -1] = 1
N_FEATURES = len(_GROUPS) + 1 + 10


def text_features(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers that describe how a text is written, not what it says or where it is from."""
    shares = np.bincount(data, minlength=256) @ _MEMBER / max(1, len(data))
    n = len(words)
    out = np.zeros(N_FEATURES)
    out[: len(shares)] = np.sqrt(shares)
    out[len(shares)] = np.log1p(n)
    if n:
        _, counts = np.unique(words, return_counts=True)
        pairs = np.unique(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
        share = counts / n
        out[len(shares) + 1 :] = (
            len(data) / n,
            np.log(len(data) / n),
            len(counts) / n,
            len(counts) / np.sqrt(n),
            share.max(),
            np.sort(share)[-5:].sum(),
            float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
            len(pairs) / max(1, n - 1),
            float(-(share * np.log(share)).sum()) - 0.7 * np.log(n),
        )
    return out


def _features(batches):
    for batch in batches:
        texts = batch.column("text")
        for row, data, offsets in text_slices(texts):
            words, ranges = word_hashes(data, offsets)
            found = [
                text_features(data[offsets[k] : offsets[k + 1]], words[ranges[k] : ranges[k + 1]])
                for k in range(len(offsets) - 1)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(found)),
                    pa.array(found, pa.list_(pa.float64())),
                ],
                ["doc_id", "features"],
            )


def _expand(values: pd.Series, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    x = np.clip((np.stack(values.to_numpy()) - mean) / deviation, -6, 6)
    return np.hstack([np.ones((len(x), 1)), x])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum of `of(frame)` over all batches; partial sums are combined in tasks first."""

    def add(frames, part):
        total = None
        for frame in frames:
            if len(frame):
                more = part(frame)
                total = more if total is None else total + more
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    partial = rows.mapInPandas(lambda fs: add(fs, of), "sums binary")
    few = partial.repartition(8).mapInPandas(
        lambda fs: add(fs, lambda f: sum(np.frombuffer(x) for x in f["sums"])), "sums binary"
    )
    found = [np.frombuffer(r.sums) for r in few.collect()]
    return sum(found) if found else np.zeros(0)


class PuClassifier:
    """Logistic model with the moments of the features it was fitted to."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.deviation = mean, deviation
        self.weights = np.zeros(1 + len(mean))
        self.prior = 0.5

    def margins(self, features: pd.Series) -> np.ndarray:
        return _expand(features, self.mean, self.deviation) @ self.weights

    def _curvature(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of positives and of unlabelled rows: count, sums of x, of s(z)x, of s'(z)xx'."""
        mean, deviation, w = self.mean, self.deviation, self.weights
        d = len(w)

        def of(frame: pd.DataFrame) -> np.ndarray:
            out = []
            for positive in (True, False):
                part = frame[frame["positive"] == positive]
                if not len(part):
                    out.append(np.zeros(1 + 2 * d + d * d))
                    continue
                x = _expand(part["features"], mean, deviation)
                s = _sigmoid(x @ w)
                curve = (x * (s * (1 - s))[:, None]).T @ x
                out.append(np.concatenate([[len(x)], x.sum(0), s @ x, curve.ravel()]))
            return np.concatenate(out)

        total = _sums(rows, of)
        out = []
        for half in np.split(total, 2):
            n = max(1.0, half[0])
            out.append((half[1 : d + 1] / n, half[d + 1 : 2 * d + 1] / n, half[2 * d + 1 :].reshape(d, d) / n))
        return out

    def _risks(self, rows: DataFrame, tries: np.ndarray) -> np.ndarray:
        """For each weight vector: mean loss of positives as such, as negatives, of unlabelled as negatives."""
        mean, deviation = self.mean, self.deviation

        def of(frame: pd.DataFrame) -> np.ndarray:
            z = _expand(frame["features"], mean, deviation) @ tries.T
            p = frame["positive"].to_numpy(bool)
            return np.concatenate(
                [
                    [p.sum(), (~p).sum()],
                    np.logaddexp(0, -z[p]).sum(0),
                    np.logaddexp(0, z[p]).sum(0),
                    np.logaddexp(0, z[~p]).sum(0),
                ]
            )

        total = _sums(rows, of)
        as_positive, as_negative, unlabelled = np.split(total[2:], 3)
        n, m = np.maximum(total[:2], 1)
        return np.array([as_positive / n, as_negative / n, unlabelled / m])

    def fit_labelled(self, rows: DataFrame) -> None:
        """Tell labelled from unlabelled rows, both with equal weight."""
        eye = LABELLED_RIDGE * np.eye(len(self.weights))
        for _ in range(STEPS):
            (xp, sp, hp), (_, su, hu) = self._curvature(rows)
            gradient = 0.5 * (sp - xp + su) + LABELLED_RIDGE * self.weights
            self.weights = self.weights - np.linalg.solve(0.5 * (hp + hu) + eye, gradient)
            if np.abs(gradient).max() < 1e-4:
                break

    def estimate_prior(self, rows: DataFrame) -> None:
        model = self

        def work(frames):
            for frame in frames:
                place = np.minimum(BINS - 1, (_sigmoid(model.margins(frame["features"])) * BINS))
                yield pd.DataFrame({"positive": frame["positive"], "bin": place.astype(np.int64)})

        counts = np.zeros((2, BINS))
        found = rows.mapInPandas(work, "positive boolean, bin long").groupBy("positive", "bin")
        for row in found.count().collect():
            counts[int(row.positive), row.bin] = row["count"]
        # among the texts above a cut, the unlabelled ones are mostly good where their share is
        # smallest against that of the positives; few rows make a share look smaller than it
        # is, so cuts are judged by an upper bound, and those within the best bound count alike
        above = counts[:, ::-1].cumsum(axis=1)
        n = np.maximum(1, above[:, -1:])
        unlabelled, positive = above / n
        error_u, error_p = DEVIATIONS * np.sqrt(above / n * (1 - above / n) / n)
        bound = (unlabelled + error_u) / np.maximum(positive - error_p, 1e-9)
        enough = positive >= LEAST_MASS
        least = bound[enough].min()
        ratio = unlabelled[enough] / positive[enough]
        near = ratio[ratio <= least]
        self.prior = float(np.clip(near.mean() if len(near) else least, 0.01, 0.99))

    def fit(self, rows: DataFrame) -> None:
        """Minimise the non-negative PU risk by Newton steps, the best of a few lengths each."""
        p, d = self.prior, len(self.weights)
        self.weights = np.zeros(d)
        for _ in range(STEPS):
            (xp, _, _), (_, su, hu) = self._curvature(rows)
            gradient = su - p * xp + RIDGE * self.weights
            step = np.linalg.solve(hu + RIDGE * np.eye(d), gradient)
            tries = np.array([self.weights] + [self.weights - s * step for s in STEP_SIZES])
            as_positive, as_negative, unlabelled = self._risks(rows, tries)
            negative_risk = np.maximum(0.0, unlabelled - p * as_negative)
            risk = p * as_positive + negative_risk + RIDGE / 2 * (tries**2).sum(axis=1)
            best = int(np.argmin(risk))
            self.weights = tries[best]
            if best == 0 or risk[0] - risk[best] < 1e-6:
                break


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores of all whole texts of `docs(doc_id, text, ..)` for quality.

    `labels(doc_id, quality, ..)` are read for rows whose crc32 of the id, as text, has a
    remainder by 4 other than 2; of these, rows of quality 1 are the trusted positives, and
    rows without a label are the unlabelled text. Returns doc_id, held_out, score (0 to 1) and
    predicted (score of at least `threshold`).

    A null or empty text is scored by its features, all zero; null ids are never labelled and
    not held out; an id with several labels is positive if one of them is 1; repeated rows are
    scored alike. Without positives or unlabelled rows all scores are 0.5. An empty table gives
    an empty result; other columns are ignored.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(remainder == 2, F.lit(False))
    known = (
        labels.where(~held_out & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("quality") == 1).alias("positive"), F.lit(True).alias("labelled"))
    )
    rows = stored(
        docs.select("doc_id", "text")
        .mapInArrow(_features, "doc_id long, features array<double>")
        .join(known, "doc_id", "left")
        .withColumn("held_out", held_out),
        "quality",
    )
    moments = rows.select(
        *[
            F.struct(
                F.avg(F.col("features")[k]).alias("m"), F.stddev_pop(F.col("features")[k]).alias("s")
            ).alias(f"f{k}")
            for k in range(N_FEATURES)
        ]
    ).first()
    mean = np.array([m["m"] or 0.0 for m in moments])
    deviation = np.array([m["s"] or 0.0 for m in moments])
    model = PuClassifier(mean, np.where(deviation > 1e-9, deviation, 1.0))
    training = rows.where(
        "not held_out and (labelled is null or positive)"
    ).select("features", F.coalesce("positive", F.lit(False)).alias("positive"))
    sides = {r.positive for r in training.select("positive").distinct().collect()}
    if len(sides) == 2:
        model.fit_labelled(training)
        model.estimate_prior(training)
        model.fit(training)

    def score(batches):
        for frame in batches:
            found = _sigmoid(model.margins(frame["features"])) if len(frame) else []
            yield frame[["id", "held_out"]].assign(score=found)

    # ids travel as text: pandas would turn a column with nulls into floats
    ids = rows.select(F.col("doc_id").cast("string").alias("id"), "held_out", "features")
    return ids.mapInPandas(score, "id string, held_out boolean, score double").select(
        F.col("id").cast("long").alias("doc_id"),
        "held_out",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
