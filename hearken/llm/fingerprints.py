"""Document fingerprints: digests of improbable features in chained Bloom filters.

Every window of WINDOW bytes has an entropy. How common each entropy class is over the whole
corpus says how improbable a window is; a window that is the most improbable of its surroundings
for long enough is a feature (similarity digests, Roussev 2010), as are the few most improbable
windows of the whole text, so that short texts have features by the same rule. The features of a document go
into a chain of Bloom filters of fixed size. Two documents are as alike as the filters of the
shorter chain are like their best counterparts: the bits both have, beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearken.llm.common import mix
from hearken.llm.repeats import _BYTE, _sliding

WINDOW = 64
SURROUNDING = 64
LEAST_POPULAR = 8
LEAST_FEATURES = 16
SAMPLED_PER_RANGE = 20
ENTROPY_CLASSES = 1024
FILTER_BITS = 2048
FEATURES_PER_FILTER = 160
HASHES = 5
SEGMENT = 1 << 19
# so much is worked through at once, so that short texts cost no calls of their own
SLICE = 1 << 17
GROUP = 1 << 20
ROWS = 500
_F = np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 2)])
_STEP = np.diff(_F)


def _equals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the WINDOW - 1 bytes before each byte equal it, and of as many after it."""
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, min(WINDOW, len(data))):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    return before, after


def entropy_classes(data: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
    """Entropy class of each window, from counts that change by one byte in and one out.

    `data` is one run of bytes, or those that `offsets` bound, of at least WINDOW bytes each; the
    windows of all runs follow each other, and none reaches from one into the next.
    """
    offsets = np.array([0, len(data)]) if offsets is None else offsets
    before, after = _equals(data)
    change = _STEP[before[WINDOW:]] - _STEP[after[: len(data) - WINDOW]]
    # the first window grows from nothing; from then on each byte in has one out
    runs = np.arange(len(offsets) - 1)
    firsts = data[offsets[:-1, None] + np.arange(WINDOW)] + 256 * runs[:, None]
    firsts = np.bincount(firsts.ravel(), minlength=256 * len(runs)).reshape(-1, 256)
    windows = np.diff(offsets) - (WINDOW - 1)
    ends = np.cumsum(windows)
    total = np.zeros(ends[-1])
    for start, end, n in zip(offsets.tolist(), ends.tolist(), windows.tolist(), strict=False):
        np.cumsum(change[start : start + n - 1], out=total[end - n + 1 : end])
    total += np.repeat(_F[firsts].sum(axis=1), windows)
    entropy = np.log2(WINDOW) - total / WINDOW
    scaled = np.rint(entropy * (ENTROPY_CLASSES - 1) / np.log2(WINDOW)).astype(np.int64)
    return np.clip(scaled, 0, ENTROPY_CLASSES - 1)


def _rolling(data: np.ndarray) -> np.ndarray:
    value, step, factor = _BYTE[data], 1, 0x9E3779B97F4A7C15
    while step < WINDOW:
        value = value[:-step] * np.uint64(factor) + value[step:]
        factor, step = factor * factor % (1 << 64), step * 2
    return mix(value)


def _rarest(values: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """The LEAST_FEATURES least values of different windows, with their hashes."""
    n = 4 * LEAST_FEATURES
    while True:
        some = np.arange(len(values))
        if n < len(values):
            some = np.flatnonzero(values <= np.partition(values, n)[n])
        _, first = np.unique(hashes[some], return_index=True)
        at = some[first]
        at = at[np.lexsort((hashes[at], values[at]))[:LEAST_FEATURES]]
        # equal windows may crowd out others: look further
        if len(at) == LEAST_FEATURES or len(some) == len(values):
            return [values[at], hashes[at]]
        n *= 4


def _popular(value: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows popular among their surroundings, in order, and each run's range of
    them; `windows` is how many each run has."""
    run = np.repeat(np.arange(len(windows)), windows)
    inner = np.flatnonzero(run[: 1 - SURROUNDING] == run[SURROUNDING - 1 :])
    if not len(inner):
        return inner, np.zeros(len(windows) + 1, np.int64)
    least, run = _sliding(value, SURROUNDING, np.minimum)[inner], run[inner]
    differ = (least[1:] != least[:-1]) | (run[1:] != run[:-1])
    edges = np.flatnonzero(np.concatenate([[True], differ, [True]]))
    edges = edges[:-1][np.diff(edges) >= LEAST_POPULAR]
    near = value[inner[edges, None] + np.arange(SURROUNDING)]
    bounds = np.searchsorted(run[edges], np.arange(len(windows) + 1))
    return inner[edges] + np.argmin(near, axis=1), bounds


def _segments(raws: Iterable[bytes], overlap: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts of at least a window in runs of SEGMENT windows, which overlap, about SLICE bytes at
    once: the text of each run, the bytes of all and where each begins among them."""
    held, size = [], 0
    for i, raw in enumerate(raws):
        for start in range(0, len(raw) - WINDOW + 1, SEGMENT):
            held.append((i, raw[start : start + SEGMENT + WINDOW - 1 + overlap]))
            size += len(held[-1][1])
            if size >= SLICE:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, bytes]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join([part for _, part in held]), np.uint8)
    return [i for i, _ in held], data, np.cumsum([0, *(len(part) for _, part in held)])


def features_of(raws: list[bytes], commonness: np.ndarray) -> list[np.ndarray]:
    """For each text the hashes of the selected windows: those popular among their surroundings,
    in order, then the LEAST_FEATURES most improbable ones of all. A text shorter than a window
    is one."""
    popular: list[list[np.ndarray]] = [[] for _ in raws]
    rarest: dict[int, list[np.ndarray]] = {}
    # segments overlap, so that each run of surroundings is seen once as a whole
    for texts, data, offsets in _segments(raws, SURROUNDING - 1):
        windows = np.diff(offsets) - (WINDOW - 1)
        inside = np.ones(len(data) - WINDOW + 1, bool)
        inside[(offsets[1:-1, None] - np.arange(1, WINDOW)).ravel()] = False
        hashed = _rolling(data)[inside]
        classes = entropy_classes(data, offsets)
        value = (commonness[classes] << np.uint64(32)) | (hashed >> np.uint64(32))
        at, bounds = _popular(value, windows)
        chosen = hashed[at]
        ends = np.cumsum(windows).tolist()
        for k, (i, end, n) in enumerate(zip(texts, ends, windows.tolist(), strict=True)):
            popular[i].append(chosen[bounds[k] : bounds[k + 1]])
            # windows of the next segment are seen there
            own = slice(end - n, end - n + min(n, SEGMENT))
            some = value[own], hashed[own]
            if i in rarest:
                some = [np.append(x, y) for x, y in zip(rarest[i], some, strict=True)]
            rarest[i] = _rarest(*some)
    out = []
    for i, raw in enumerate(raws):
        if i not in rarest:
            out.append(np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64))
            continue
        found = np.concatenate(popular[i])
        rare = rarest[i][1]
        out.append(np.append(found, rare[~(rare[:, None] == found).any(axis=1)]))
    return out


def features(raw: bytes, commonness: np.ndarray) -> np.ndarray:
    """The features of one text."""
    return features_of([raw], commonness)[0]


def chains(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the Bloom filters of its features, FEATURES_PER_FILTER to each, as rows of
    flags."""
    sizes = np.array([len(h) for h in hashes])
    ends = np.cumsum(-(-sizes // FEATURES_PER_FILTER))
    flags = np.zeros((int(ends[-1]), FILTER_BITS), bool)
    row = np.concatenate(
        [np.arange(n) // FEATURES_PER_FILTER + end for n, end in zip(sizes, [0, *ends], strict=False)]
    )
    value = np.concatenate(hashes)
    for _ in range(HASHES):
        value = mix(value + np.uint64(0x9E3779B97F4A7C15))
        flags[row, value & np.uint64(FILTER_BITS - 1)] = True
    return [flags[a:b] for a, b in pairwise([0, *ends.tolist()])]


def chain(hashes: np.ndarray) -> np.ndarray:
    """The chain of one text."""
    return chains([hashes])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain, its best counterpart, by set bits."""
    if len(a) > len(b):
        a, b = b, a
    size_a, size_b = a.sum(axis=1).astype(float), b.sum(axis=1).astype(float)
    right = b.T.astype(np.float32)
    score = 0.0
    for i in range(len(a)):
        both = (a[i : i + 1].astype(np.float32) @ right)[0]
        chance = size_a[i] * size_b / FILTER_BITS
        most = np.minimum(size_a[i], size_b)
        score += size_a[i] * float(np.max(np.maximum(0.0, (both - chance) / (most - chance))))
    # what the longer chain has beyond the shorter one is unlike it
    return float(min(1.0, score / size_a.sum())) * min(1.0, size_a.sum() / size_b.sum())


def _packed(flags: list[np.ndarray]) -> np.ndarray:
    return np.packbits(np.concatenate(flags), axis=1).view(np.uint64)


def likenesses(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """The likeness of each pair; pairs of single filters are compared at once."""
    single = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if len(x) == len(y) == 1]
    out = dict.fromkeys(range(len(a)), 0.0)
    if single:
        x, y = (_packed([side[k] for k in single]) for side in (a, b))
        size_x, size_y, both = (np.bitwise_count(z).sum(axis=1).astype(float) for z in (x, y, x & y))
        chance = size_x * size_y / FILTER_BITS
        score = size_x * np.maximum(0.0, (both - chance) / (np.minimum(size_x, size_y) - chance))
        found = np.minimum(1.0, score / size_x) * np.minimum(1.0, size_x / size_y)
        out |= zip(single, found.tolist(), strict=True)
    for k in out.keys() - set(single):
        out[k] = likeness(a[k], b[k])
    return list(out.values())


def to_text(flags: np.ndarray) -> str:
    return base64.b64encode(np.packbits(flags, axis=1).tobytes()).decode()


def _histogram(batches):
    total = np.zeros(ENTROPY_CLASSES, np.int64)
    for batch in batches:
        raws = ((value.as_py() or "").encode() for value in batch.column("text"))
        for _, data, offsets in _segments(raws, 0):
            total += np.bincount(entropy_classes(data, offsets), minlength=ENTROPY_CLASSES)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["class", "n"])


def commonness(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy class by its number of windows in all documents, rarest first."""
    counts = (
        docs.select("text")
        .mapInArrow(_histogram, "class long, n long")
        .groupBy("class")
        .agg(F.sum("n").alias("n"))
    )
    total = np.zeros(ENTROPY_CLASSES, np.int64)
    for row in counts.collect():
        total[row["class"]] = row.n
    rank = np.empty(ENTROPY_CLASSES, np.uint64)
    rank[np.lexsort((np.arange(ENTROPY_CLASSES), total))] = np.arange(ENTROPY_CLASSES)
    return rank


def _place(bounds: list[tuple]):
    """Which range a row is in, by its id (null first) and tie; `bounds` begin all but the first."""
    nulls = [tie for doc_id, tie in bounds if doc_id is None]
    others = [(doc_id, tie) for doc_id, tie in bounds if doc_id is not None]

    @F.arrow_udf("long")
    def place(ids: pa.Array, ties: pa.Array) -> pa.Array:
        tie = ties.to_numpy(zero_copy_only=False)
        no_id = ids.is_null().to_numpy(zero_copy_only=False)
        out = np.searchsorted(np.array(nulls, np.int64), tie, side="right")
        at = np.flatnonzero(~no_id)
        if len(at):
            known = ids.drop_null().to_numpy(zero_copy_only=False)
            firsts = np.array([x for x, _ in others], np.int64)
            low = np.searchsorted(firsts, known, side="left")
            high = np.searchsorted(firsts, known, side="right")
            # rows of an id that begins a range go by their tie
            for k in np.flatnonzero(low < high).tolist():
                own = [t for _, t in others[low[k] : high[k]]]
                high[k] = low[k] + np.searchsorted(own, tie[at[k]], side="right")
            out[at] = len(nulls) + high
        return pa.array(out, pa.int64())

    return place


def _bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """Where ranges of about equally many rows begin, from a sample of SAMPLED_PER_RANGE rows for
    each; it decides where rows are worked on, not what comes out."""
    n = keys.count()
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(n, 1))
    rows = {(r["doc_id"], r["tie"]) for r in keys.sample(share, seed=3).collect()}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    step = max(1, len(rows) // ranges)
    return rows[step::step]


def _in_order(docs: DataFrame) -> DataFrame:
    """Deal rows to ranges of (doc_id, hash of text), each with the row that follows it, in order.

    A range has its own rows (last = 0) and the first row of the next range that has any
    (last = 1), or of the first range. A task then sees each row's successor without a global
    order. The number of ranges is a few times that of shuffle partitions; they hold about
    equally many rows, however the ids lie. Rows that agree in both are in one range.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("tie", F.xxhash64("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = _place(_bounds(docs.select("doc_id", "tie"), ranges))
    docs = docs.withColumn("range", place("doc_id", "tie"))
    firsts = docs.select("range", F.struct("doc_id", "tie").alias("at")).groupBy("range").agg(
        F.min("at").alias("at")
    )
    order = Window.orderBy("range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        F.col("at.doc_id").alias("first_id"),
        F.col("at.tie").alias("first_tie"),
        F.coalesce(F.lag("range").over(order), F.last("range").over(whole)).alias("to"),
    )
    # at most one row a range: a bound that does not grow with the rows
    successor = (
        docs.join(
            F.broadcast(firsts),
            F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")),
        )
        .select("doc_id", "text", F.col("to").alias("range"), "tie", F.lit(1).alias("last"))
        .dropDuplicates(["range"])
    )
    return (
        docs.select("doc_id", "text", "range", "tie", F.lit(0).alias("last"))
        .unionByName(successor)
        .repartition("range")
        .sortWithinPartitions("range", "last", F.col("doc_id").asc_nulls_first(), "tie")
    )


def _report(common):
    def reported(rows: list[tuple], before: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """Rows of the report, and the last of `rows` with its chain, which begins the next call."""
        own = chains(features_of([text.encode() for *_, text in rows], common.value))
        rows = before + [(*row, flags) for row, flags in zip(rows, own, strict=True)]
        pairs = [(x, y) for x, y in pairwise(rows) if x[0] == y[0] and not x[1]]
        edited, changed = [], []
        for (*_, text, flags), (*_, after, _) in pairs:
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + after[:cut])
            changed.append(flags if edited[-1] == text else None)
        raws = [text.encode() for text in edited]
        at = [k for k, flags in enumerate(changed) if flags is None]
        if at:
            found = chains(features_of([raws[k] for k in at], common.value))
            for k, flags in zip(at, found, strict=True):
                changed[k] = flags
        flags = [x[-1] for x, _ in pairs]
        out = list(
            zip(
                (doc_id for (_, _, doc_id, _, _), _ in pairs),
                (len(text) for (_, _, _, text, _), _ in pairs),
                (hashlib.sha256(raw).hexdigest() for raw in raws),
                map(to_text, flags),
                map(to_text, changed),
                likenesses(flags, changed),
                likenesses(flags, [y[-1] for _, y in pairs]),
                strict=True,
            )
        )
        return out, rows[-1:]

    def work(batches):
        rows, size, before = [], 0, []
        for batch in batches:
            for where, last, doc_id, text in zip(
                batch.column("range").to_pylist(),
                batch.column("last").to_pylist(),
                batch.column("doc_id").to_pylist(),
                batch.column("text"),
                strict=True,
            ):
                rows.append((where, last, doc_id, text.as_py()))
                size += len(rows[-1][-1])
                if len(rows) == ROWS or size >= GROUP:
                    out, before = reported(rows, before)
                    rows, size = [], 0
                    if out:
                        yield _batch(out)
        if rows and (out := reported(rows, before)[0]):
            yield _batch(out)

    return work


_REPORT = (
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), _REPORT, strict=True)],
        [name for name, _ in _REPORT],
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of `docs(doc_id, text, ..)` and of their edited texts, and likenesses.

    In the edited text the last quarter of the code points is replaced by as many of the start
    of the next document by doc_id (after the last: the first). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty; a text shorter than a window is one feature as a whole; a null doc_id comes before all others; rows of one doc_id follow each other by a hash of
    their text; a single document follows itself; an empty table gives an empty result; other
    columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(commonness(docs))
    return _in_order(docs).mapInArrow(
        _report(common),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs(text, ..)` with a column `fingerprint`; nulls and short texts as in the report."""
    common = docs.sparkSession.sparkContext.broadcast(commonness(docs))

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        raws = [(t or "").encode() for t in texts]
        groups = (raws[k : k + ROWS] for k in range(0, len(raws), ROWS))
        found = (chains(features_of(some, common.value)) for some in groups)
        return pd.Series([to_text(flags) for some in found for flags in some], dtype=object)

    return docs.withColumn("fingerprint", digest("text"))
