"""Removal of long byte strings that repeat anywhere in the corpus, by a suffix array's
common-prefix interval tree.

A suffix array over all positions of a corpus would be hundreds of times its size. Two equal
strings of `length` bytes, however, have the same local minima of a rolling hash (winnowing), so
it is enough to sort the suffixes that begin at such anchors: one in about `length`/2 bytes.

1. Each text emits its anchors: the hash of the ANCHOR bytes there and the hash of all that a
   repeated string through this anchor can reach, `length` bytes to either side at most.
2. Anchors whose hash is nowhere else are dropped. Where also the reach is equal, all of it is
   repeated, and no byte has to be compared.
3. For the others, which are near the ends of repeats, the reach is cut out of the texts. Spark
   sorts it by anchor and what follows, which is the suffix array over anchors. A scan with
   a stack over the lengths of common prefixes gives the tree of intervals: each interval is all
   suffixes that share a prefix. Their left extensions, sorted backwards, are tested for
   diversity; the longest that a member shares with another is its repeat.
4. The repeated ranges of each text are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hearken.llm.common import mix, stored

ANCHOR = 64
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from each place on, by doubling the length."""
    value, step, factor = _BYTE[data], 1, _BASE
    while step < ANCHOR:
        value = value[:-step] * np.uint64(factor) + value[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    return mix(value)


def _sliding(value: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) value of each `width` neighbours, in a fixed number of passes."""
    n = len(value)
    padded = np.concatenate([value, np.repeat(value[-1:], -n % width)]).reshape(-1, width)
    ahead = least.accumulate(padded, axis=1).ravel()
    behind = least.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors and their hashes: least in a window of places that fit one string."""
    width = length - ANCHOR + 1
    places, keys = [], []
    for start in range(0, max(1, len(data) - length + 1), SEGMENT):
        part = data[start : start + SEGMENT + length - 1]
        if len(part) < length:
            break
        value = rolling(part)
        low = _sliding(value, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        high = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
        at = np.flatnonzero(high == value)
        places.append(at + start)
        keys.append(value[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(keys)[first]


def _texts(batch, name: str = "text") -> Iterator[bytes]:
    for value in batch.column(name):
        yield (value.as_py() or "").encode()


def _emit_anchors(length: int):
    reach = length - ANCHOR

    def work(batches):
        import xxhash

        schema = pa.schema(
            [
                ("key", pa.int64()),
                ("reach", pa.int64()),
                ("h1", pa.int64()),
                ("h2", pa.int64()),
                ("before", pa.int32()),
                ("after", pa.int32()),
                ("at", pa.list_(pa.int64())),
            ]
        )
        for batch in batches:
            rows: list[tuple] = []
            for raw, h1, h2 in zip(
                _texts(batch),
                batch.column("h1").to_pylist(),
                batch.column("h2").to_pylist(),
                strict=True,
            ):
                n = len(raw)
                places, keys = anchors(np.frombuffer(raw, np.uint8), length)
                found: dict[tuple, list[int]] = {}
                for p, key in zip(places.tolist(), keys.view(np.int64).tolist(), strict=True):
                    before, after = min(reach, p), min(length, n - p)
                    seen = xxhash.xxh3_64_intdigest(
                        raw[p - before : p + after], before * 4099 + after
                    )
                    found.setdefault((key, seen - (1 << 63), before, after), []).append(p)
                rows += [(k[0], k[1], h1, h2, k[2], k[3], at) for k, at in found.items()]
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema)],
                        schema=schema,
                    )
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema)],
                    schema=schema,
                )

    return work


def _cut_reach(batches):
    """The bytes around the wanted anchors of each text; what is before it, backwards."""
    for batch in batches:
        for raw, wanted in zip(_texts(batch), batch.column("wanted"), strict=True):
            wanted = wanted.as_py()
            for i in range(0, len(wanted), 1024):
                part = wanted[i : i + 1024]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["key"] for w in part], pa.int64()),
                        pa.array([w["reach"] for w in part], pa.int64()),
                        pa.array([w["h1"] for w in part], pa.int64()),
                        pa.array([w["h2"] for w in part], pa.int64()),
                        pa.array([w["place"] for w in part], pa.int64()),
                        pa.array(
                            [raw[w["place"] - w["before"] : w["place"]][::-1] for w in part],
                            pa.binary(),
                        ),
                        pa.array(
                            [raw[w["place"] : w["place"] + w["after"]] for w in part],
                            pa.binary(),
                        ),
                    ],
                    ["key", "reach", "h1", "h2", "place", "left", "right"],
                )


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def prefix_intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """All intervals (length, first, last) of a suffix array with common prefixes `shared`.

    `shared[i]` is what suffixes i and i + 1 have in common. One scan with a stack (Abouelhoda,
    Kurtz, Ohlebusch 2004).
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            yield top, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def group_repeats(
    lefts: list[bytes], rights: list[bytes], length: int
) -> Iterator[tuple[int, int, int]]:
    """What repeats through one anchor: (member, bytes before it, bytes from it on).

    `rights` are sorted suffixes from the anchor on, `lefts` the bytes before it, backwards.
    All repeats of a member hold its anchor, so together they are one run.
    """
    shared = [common(rights[i], rights[i + 1]) for i in range(len(rights) - 1)]
    backwards = sorted(range(len(lefts)), key=lefts.__getitem__)
    rank = np.empty(len(lefts), np.int64)
    rank[backwards] = np.arange(len(lefts))
    reach = np.array(
        [common(lefts[a], lefts[b]) for a, b in zip(backwards, backwards[1:], strict=False)],
        np.int64,
    )
    most_before = np.full(len(lefts), -1, np.int64)
    most_after = np.zeros(len(lefts), np.int64)
    greatest = int(reach.max(initial=0))
    for depth, first, last in prefix_intervals(shared):
        if depth + greatest < length:
            continue
        # members by left extension; two share the least of what lies between them
        order = np.sort(rank[first : last + 1])
        gaps = np.minimum.reduceat(reach[: order[-1]], order[:-1])
        longest = np.zeros(len(order), np.int64)
        longest[:-1] = gaps
        longest[1:] = np.maximum(longest[1:], gaps)
        diverse = order[depth + longest >= length]
        before = longest[depth + longest >= length]
        most_before[diverse] = np.maximum(most_before[diverse], before)
        most_after[diverse] = np.maximum(most_after[diverse], depth)
    for place in np.flatnonzero(most_before >= 0).tolist():
        yield backwards[place], int(most_before[place]), int(most_after[place])


def _repeats(length: int):
    def flush(rows):
        if len(rows) > 1:
            for i, before, after in group_repeats(
                [r[4] for r in rows], [r[5] for r in rows], length
            ):
                yield rows[i][1], rows[i][2], rows[i][3] - before, rows[i][3] + after

    def work(batches):
        key, rows, seen, out = None, [], set(), []
        for batch in batches:
            for k, reach, h1, h2, place, left, right in zip(
                *(
                    batch.column(c).to_pylist()
                    for c in ("key", "reach", "h1", "h2", "place", "left", "right")
                ),
                strict=True,
            ):
                if k != key:
                    out += flush(rows)
                    key, rows, seen = k, [], set()
                # copies of a text bring the same reach again
                if reach not in seen:
                    seen.add(reach)
                    rows.append((reach, h1, h2, place, left, right))
            if len(out) > 10_000:
                yield _spans(out)
                out = []
        out += flush(rows)
        if out:
            yield _spans(out)

    return work


def _spans(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["h1", "h2", "start", "end"]
    )


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges; touching ranges are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _remove(length: int):
    def work(batches):
        out, held = [], 0
        for batch in batches:
            for raw, doc_id, copies, spans in zip(
                _texts(batch),
                batch.column("doc_id").to_pylist(),
                batch.column("copies").to_pylist(),
                batch.column("spans"),
                strict=True,
            ):
                n, kept, runs = len(raw), [raw], 0
                if n >= length and copies > 1:
                    kept, runs = [], 1
                elif spans.is_valid:
                    flat = spans.values.flatten()
                    starts, ends = merged(*(x.to_numpy(zero_copy_only=False) for x in flat))
                    runs = len(starts)
                    edges = zip([0, *ends.tolist()], [*starts.tolist(), n], strict=True)
                    kept = [raw[a:b] for a, b in edges]
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                left = n - sum(map(len, kept))
                out.append((doc_id, n, left, runs, digest.hexdigest(), b"".join(kept)))
                held += n
                if held > SEGMENT:
                    yield _kept(out)
                    out, held = [], 0
        if out:
            yield _kept(out)

    return work


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array(x, pa.int64()) for x in columns[:4]),
            pa.array(columns[4], pa.string()),
            pa.array(columns[5], pa.binary()),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Cut out of each text every byte covered by a `length`-byte string that is also elsewhere.

    `docs(doc_id, text, ..)` are taken as UTF-8 bytes; strings never cross documents, may
    overlap, and are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and kept (what remains).

    A null text is empty; a text shorter than `length` is kept whole; a null doc_id is kept;
    repeated rows are copies of each other and lose all their bytes (from `length` on); an
    empty table gives an empty result; other columns are ignored. `length` is at least 128.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(_BASE >> 2), "text")}
    )
    long_texts = docs.where(F.octet_length("text") >= length)
    found = stored(
        long_texts.select("h1", "h2", "text").mapInArrow(
            _emit_anchors(length),
            "key long, reach long, h1 long, h2 long, before int, after int, at array<long>",
        ),
        "anchors",
    )
    shared = (
        found.groupBy("key")
        .agg(
            F.sum(F.size("at")).alias("n"),
            F.min("reach").alias("low"),
            F.max("reach").alias("high"),
        )
        .where("n > 1")
        .select("key", (F.col("low") != F.col("high")).alias("differ"))
    )
    found = stored(found.join(shared, "key"), "shared-anchors")
    classes = stored(
        found.groupBy("key", "reach").agg(F.sum(F.size("at")).alias("n")), "anchor-classes"
    )
    whole = (
        found.join(classes.where("n > 1"), ["key", "reach"])
        .where(F.col("before") + F.col("after") >= length)
        .select("h1", "h2", "before", "after", F.explode("at").alias("place"))
        .select(
            "h1",
            "h2",
            (F.col("place") - F.col("before")).alias("start"),
            (F.col("place") + F.col("after")).alias("end"),
        )
    )
    # where classes differ, one member of each class stands for it
    wanted = (
        found.where("differ")
        .dropDuplicates(["key", "reach"])
        .withColumn("place", F.col("at")[0])
        .groupBy("h1", "h2")
        .agg(
            F.collect_list(F.struct("key", "reach", "h1", "h2", "place", "before", "after")).alias(
                "wanted"
            )
        )
    )
    partial = (
        long_texts.select("h1", "h2", "text")
        .join(wanted, ["h1", "h2"])
        .select("text", "wanted")
        .mapInArrow(
            _cut_reach,
            "key long, reach long, h1 long, h2 long, place long, left binary, right binary",
        )
        .repartition("key")
        .sortWithinPartitions("key", "right")
        .mapInArrow(_repeats(length), "h1 long, h2 long, start long, end long")
    )
    spans = stored(whole.unionByName(partial), "spans")
    spans = spans.groupBy("h1", "h2").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    copies = docs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    facts = copies.join(spans, ["h1", "h2"], "left")
    return (
        docs.join(facts, ["h1", "h2"])
        .select("doc_id", "text", "copies", "spans")
        .mapInArrow(
            _remove(length),
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
            "kept binary",
        )
    )
