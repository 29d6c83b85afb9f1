"""N-gram Jaccard self-join by signature trees.

Documents are sets of word shingles; two of them link when their Jaccard similarity reaches a
threshold. The join is exact:

1. Equal sets are one class at once, represented by their smallest id.
2. Each class is put under the keys of its prefix: its rarest shingles, as many as a partner
   must share one of (prefix filter). Rarity comes from a table of counters of fixed size over
   all documents; any order is right, a good one keeps the classes of a key few.
3. Keys with the same classes are one block, of which classes without a partner near their
   size are left out. A block is cut into parts of bounded size, and
   each pair of parts is a task of its own, so a hot key is spread over many tasks.
4. In a task a signature tree is built over each part: nodes hold OR-combined bitmaps of their
   shingles and the range of set sizes. Both trees are walked together, dropping node pairs
   whose greatest possible overlap is too small. This is done twice. The first walk knows each
   set by its size and a bitmap of the whole set, of two to four bits a shingle; what it lets
   through overlaps nearly enough to link. The second is over the texts of the classes that such
   pairs connect, where what is left is compared exactly. A pair whose sides are already
   connected adds nothing and is skipped.
5. Components of the links are found by rounds of grouped minima.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearken.llm.common import shingle_sets, stored, text_slices
from hearken.llm.components import components

COUNTERS = 1 << 20
COUNTERS_PER_ROW = 1 << 14
FAN_OUT = 16
PART_DOCS = 512
PART_SHINGLES = 1 << 20
PAIRS_AT_ONCE = 1 << 14
LEAST_BITS = 256


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """A set as bits, each shingle at its hash modulo `bits` (a power of two)."""
    marks = np.zeros(bits, bool)
    marks[shingles & np.uint64(bits - 1)] = True
    return np.packbits(marks)


def own_bits(n: int) -> int:
    """Bits of the bitmap that a set of `n` shingles is known by: two to four for each."""
    return max(LEAST_BITS, 1 << (2 * n - 1).bit_length())


def folded(maps: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps of the same sets with fewer bits."""
    while maps.shape[1] * 8 > bits:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class SignatureTree:
    """Levels of nodes over sets; level 0 are the sets, each node above stands for FAN_OUT below.

    A node has the OR of its sets' bitmaps, the range of their sizes, and the most shingles that
    a set has beyond its bits.
    """

    def __init__(self, maps: np.ndarray, sizes: list[int]):
        size = np.array(sizes, np.int64)
        packed = np.ascontiguousarray(maps).view(np.uint64)
        order = np.lexsort((packed[:, 0], size))
        self.order = order.tolist()
        packed, size = packed[order], size[order]
        hidden = size - np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        self.levels = [(packed, size, size, hidden)]
        while len(self.levels[-1][1]) > FAN_OUT:
            maps, low, high, hidden = self.levels[-1]
            cut = np.arange(0, len(low), FAN_OUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, cut, axis=0),
                    np.minimum.reduceat(low, cut),
                    np.maximum.reduceat(high, cut),
                    np.maximum.reduceat(hidden, cut),
                )
            )

    def possible(self, other: SignatureTree, level: int, a, b, percent: int) -> np.ndarray:
        """Which node pairs may hold a pair that links: the set with fewer shingles beyond its
        bits shares at most those, besides the bits of both."""
        maps_a, low_a, high_a, hidden_a = (x[a] for x in self.levels[level])
        maps_b, low_b, high_b, hidden_b = (x[b] for x in other.levels[level])
        keep = (percent * low_a <= 100 * high_b) & (percent * low_b <= 100 * high_a)
        shared = np.bitwise_count(maps_a & maps_b).sum(axis=1, dtype=np.int64)
        most = shared + np.minimum(hidden_a, hidden_b)
        most = np.minimum(most, np.minimum(high_a, high_b))
        return keep & ((100 + percent) * most >= percent * (low_a + low_b))


def possible_pairs(
    left: np.ndarray,
    right: np.ndarray | None,
    sizes: list[int],
    percent: int,
    wanted,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk the trees over the bitmaps `left` and `right` (or `left` and itself) together.

    Yields arrays of numbers of sets, those of `right` after those of `left`, of all pairs
    whose possible overlap suffices and for which `wanted(a, b)` holds.
    """
    n, bits = len(left), left.shape[1] * 8
    tree = SignatureTree(left, sizes[:n])
    other = SignatureTree(right, sizes[n:]) if right is not None else tree
    names_a = np.array(tree.order)
    names_b = np.array(other.order) + (n if right is not None else 0)
    level = min(len(tree.levels), len(other.levels)) - 1
    top_a, top_b = len(tree.levels[level][1]), len(other.levels[level][1])
    pending = [(level, np.repeat(np.arange(top_a), top_b), np.tile(np.arange(top_b), top_a))]
    # wide bitmaps are compared in pieces
    step = max(1, (1 << 25) // bits)
    while pending:
        level, a, b = pending.pop()
        if len(a) > PAIRS_AT_ONCE:
            pending.append((level, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
            a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
        if right is None:
            keep = a <= b if level else a < b
            a, b = a[keep], b[keep]
        if level == 0 and len(a):
            keep = wanted(names_a[a], names_b[b])
            a, b = a[keep], b[keep]
        if not len(a):
            continue
        keep = np.concatenate(
            [
                tree.possible(other, level, a[i : i + step], b[i : i + step], percent)
                for i in range(0, len(a), step)
            ]
        )
        a, b = a[keep], b[keep]
        if level == 0:
            yield names_a[a], names_b[b]
        else:
            below_a, below_b = len(tree.levels[level - 1][1]), len(other.levels[level - 1][1])
            steps = np.arange(FAN_OUT)
            child_a = np.repeat(a[:, None] * FAN_OUT + steps, FAN_OUT, axis=1).ravel()
            child_b = np.tile(b[:, None] * FAN_OUT + steps, (1, FAN_OUT)).ravel()
            keep = (child_a < below_a) & (child_b < below_b)
            pending.append((level - 1, child_a[keep], child_b[keep]))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int((y[at] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def spanning(
    left: np.ndarray, right: np.ndarray | None, sizes: list[int], percent: int, links=None
) -> Iterator[tuple[int, int]]:
    """Pairs that connect all sets of `left` (and, if given, those across to `right`) that the
    pairs whose possible overlap suffices connect; with `links(i, j)`, those for which it holds.

    Sets are given by bitmaps and sizes, those of `right` are numbered after those of `left`.
    Pairs that an earlier one has connected are not looked at.
    """
    parent = np.arange(len(sizes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        roots = np.array([root(i) for i in range(len(sizes))])
        return roots[a] != roots[b]

    for a, b in possible_pairs(left, right, sizes, percent, apart):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            ri, rj = root(i), root(j)
            if ri != rj and (links is None or links(i, j)):
                parent[max(ri, rj)] = min(ri, rj)
                yield i, j


def tree_links(
    left: list[np.ndarray], right: list[np.ndarray] | None, percent: int
) -> Iterator[tuple[int, int]]:
    """Links that connect all linked sets of `left` (and, if given, those across to `right`)."""
    sets = left + (right or [])
    if len(sets) < 2:
        return
    sizes = [len(x) for x in sets]
    bits = max(LEAST_BITS, 1 << (4 * max(sizes) - 1).bit_length())
    maps = np.stack([bitmap(x, bits) for x in sets])
    yield from spanning(
        maps[: len(left)],
        maps[len(left) :] if right else None,
        sizes,
        percent,
        lambda i, j: linked(sets[i], sets[j], percent),
    )


def map_links(
    left: list[tuple[int, bytes]], right: list[tuple[int, bytes]] | None, percent: int
) -> Iterator[tuple[int, int]]:
    """Pairs that connect all sets that may link, by their sizes and own bitmaps.

    Sets of like size have bitmaps of like width: those of one width are compared with each
    other and with the next ones, folded to the smaller width.
    """
    everything = left + (right or [])
    widths: tuple[dict, dict] = {}, {}
    for i, (_, raw) in enumerate(everything):
        side = widths[0] if right is None or i < len(left) else widths[1]
        side.setdefault(len(raw) * 8, []).append(i)
    # widths of sets whose sizes allow a link differ by so many doublings
    reach = math.ceil(math.log2(100 / percent)) + 1

    def maps_of(some: list[int], bits: int) -> np.ndarray:
        raw = b"".join(everything[i][1] for i in some)
        return folded(np.frombuffer(raw, np.uint8).reshape(len(some), -1), bits)

    for first, a in widths[0].items():
        for second, b in (widths[0] if right is None else widths[1]).items():
            if right is None and second < first or max(first, second) >> reach > min(first, second):
                continue
            bits, same = min(first, second), right is None and first == second
            some = a if same else a + b
            if len(some) < 2:
                continue
            for i, j in spanning(
                maps_of(a, bits),
                None if same else maps_of(b, bits),
                [everything[k][0] for k in some],
                percent,
            ):
                yield some[i], some[j]


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _counts(width: int):
    def work(batches):
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column("text")):
                for one in shingle_sets(data, offsets, width):
                    # a set may hit a counter twice; that only shifts the order
                    np.add.at(counters, one & np.uint64(COUNTERS - 1), 1)
        if counters.any():
            rows = counters.astype("<u4").reshape(-1, COUNTERS_PER_ROW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows])],
                ["part", "counters"],
            )

    return work


def _sum_counts(frames):
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for part, raw in zip(frame["part"], frame["counters"], strict=True):
            more = np.frombuffer(raw, "<u4").astype(np.uint64)
            total[part] = total[part] + more if part in total else more
    yield pd.DataFrame(
        {
            "part": np.array(list(total), np.int32),
            "counters": [np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in total.values()],
        }
    )


def shingle_counters(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents have shingles of each of COUNTERS hash classes, over all documents.

    COUNTERS numbers whatever the size of the corpus (4 MiB), so each task may have a copy.
    """
    rows = (
        docs.select("text")
        .mapInArrow(_counts(width), "part int, counters binary")
        .repartition(COUNTERS // COUNTERS_PER_ROW, "part")
        .mapInPandas(_sum_counts, "part int, counters binary")
    )
    counters = np.zeros((COUNTERS // COUNTERS_PER_ROW, COUNTERS_PER_ROW), np.uint32)
    for row in rows.collect():
        counters[row.part] = np.frombuffer(row.counters, "<u4")
    return counters.ravel()


def _profiles(width: int, percent: int, counters):
    def work(batches):
        rarity = counters.value
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in text_slices(batch.column("text")):
                sizes, names, prefixes, maps = [], [], [], []
                for one in shingle_sets(data, offsets, width):
                    n = len(one)
                    sizes.append(n)
                    names.append(digest(one))
                    maps.append(bitmap(one, own_bits(n)).tobytes() if n else b"")
                    if n:
                        order = np.lexsort((one, rarity[one & np.uint64(COUNTERS - 1)]))
                        one = one[order[: n + (-percent * n) // 100 + 1]]
                    prefixes.append(one.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array(maps, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "name", "prefix", "map"],
                )

    return work


def _suspects(percent: int):
    """Pairs that may link, from sorted rows of blocks; enough to connect all such pairs."""

    def of(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        first, second = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == first]
        right = [r for r in rows if r[3] == second] if first != second else None
        if left and (right is None or right):
            rows = left + (right or [])
            for i, j in map_links(
                [r[5:] for r in left], None if right is None else [r[5:] for r in right], percent
            ):
                yield rows[i][4], rows[j][4]

    def pairs(batches) -> Iterator[tuple[int, int]]:
        task, rows = None, []
        for batch in batches:
            names = ("key", "first", "second", "part", "id", "n", "map")
            plain = (batch.column(c).to_pylist() for c in names)
            for row in zip(*plain, strict=True):
                if row[:3] != task:
                    if len(rows) > 1:
                        yield from of(rows)
                    task, rows = row[:3], []
                rows.append(row)
        if len(rows) > 1:
            yield from of(rows)

    def work(batches):
        out = []
        for pair in pairs(batches):
            out.append(pair)
            if len(out) == 10_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return work


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["a", "b"]
    )


def _block_links(width: int, percent: int):
    def sets_of(frame: pd.DataFrame) -> tuple[list[int], list[np.ndarray]]:
        ids, sets, seen = [], [], set()
        for row, data, offsets in text_slices(pa.array(frame["text"], pa.string())):
            for k, one in enumerate(shingle_sets(data, offsets, width)):
                i = int(frame["id"].iloc[row + k])
                if i not in seen and digest(one) == bytes(frame["name"].iloc[row + k]):
                    seen.add(i)
                    ids.append(i)
                    sets.append(one)
        return ids, sets

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        first, second = frame["first"].iloc[0], frame["second"].iloc[0]
        ids, left = sets_of(frame[frame["part"] == first])
        right = None
        if first != second:
            more, right = sets_of(frame[frame["part"] == second])
            ids += more
        usable = left and (right is None or right)
        found = [(ids[i], ids[j]) for i, j in tree_links(left, right, percent)] if usable else []
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return work


def _in_parts(members: DataFrame) -> DataFrame:
    """Deal the members of each block into parts of bounded size, and give each pair of parts."""
    parts = members.groupBy("key").agg(
        F.greatest(
            F.ceil(F.count("id") / PART_DOCS), F.ceil(F.sum("n") / PART_SHINGLES)
        ).alias("parts")
    )
    return (
        members.join(parts, "key")
        .withColumn("part", F.expr("pmod(xxhash64(id, key), parts)"))
        .withColumn("with", F.explode(F.expr("sequence(0L, parts - 1)")))
        .select(
            "key",
            "id",
            "n",
            "part",
            F.least("part", "with").alias("first"),
            F.greatest("part", "with").alias("second"),
        )
    )


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Each row of `docs(doc_id, text, ..)` with the class its links put it into.

    Returns `doc_id`, `n_shingles` (size of its set of `width`-word shingles) and
    `component_id`: the smallest doc_id reachable by links of at least `percent` hundredths
    Jaccard similarity. Words are split at ASCII white space, A-Z in lower case.

    Null and empty texts and texts without words have an empty set, link with nothing and are
    their own component. A null doc_id has a null component and takes part in no link. Rows
    that repeat are returned as often; a doc_id with several texts belongs to the class of
    each. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counters = spark.sparkContext.broadcast(shingle_counters(docs, width))
    profiles = stored(
        docs.mapInArrow(
            _profiles(width, percent, counters),
            "doc_id long, n_shingles long, name binary, prefix array<long>, map binary",
        ),
        "profiles",
    )
    rows = profiles.select("doc_id", "n_shingles", "name")
    usable = rows.where("doc_id is not null and n_shingles > 0")
    classes = stored(
        usable.groupBy("name").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n")),
        "classes",
    )

    # one column set for the grouping and the join, so that both use the same exchange
    prefixes = (
        profiles.join(classes.select(F.col("id").alias("doc_id"), "name", "n"), ["doc_id", "name"])
        .dropDuplicates(["doc_id", "name"])
        .select(F.col("doc_id").alias("id"), "n", "prefix", "map")
    )
    keys = prefixes.select(F.explode("prefix").alias("key"), "id", "n")
    keys = keys.repartition("key")
    shared = keys.groupBy("key").agg(
        F.count("id").alias("members"),
        F.expr("bit_xor(xxhash64(id))").alias("x"),
        F.expr("bit_xor(xxhash64(id, 1))").alias("y"),
    )
    shared = shared.where("members > 1")
    shared = stored(keys.join(shared, "key").select("key", "id", "n", "members", "x", "y"), "keys")
    blocks = shared.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key")
    # sizes in steps of half the greatest ratio: partners are at most two steps apart
    step = F.floor(F.log(F.col("n")) * (2 / math.log(100 / percent))) if percent < 100 else F.col("n")
    members = shared.join(blocks, "key").select("key", "id", "n", step.alias("step"))
    near = (
        members.groupBy("key", "step")
        .count()
        .select("key", F.explode(F.expr("sequence(step - 2, step + 2)")).alias("step"), "count")
        .groupBy("key", "step")
        .agg(F.sum("count").alias("near"))
        .where("near > 1")
    )
    members = stored(members.join(near, ["key", "step"]).select("key", "id", "n"), "members")
    tasks = ["key", "first", "second"]
    suspects = (
        _in_parts(members)
        .join(prefixes.select("id", "map"), "id")
        .select(*tasks, "part", "id", "n", "map")
        .repartition(*tasks)
        .sortWithinPartitions(*tasks)
        .mapInArrow(_suspects(percent), "a long, b long")
    )
    # classes that may link, directly or over others, are compared together; each is sent once
    members = stored(
        components(suspects)
        .withColumnRenamed("component_id", "key")
        .join(classes.select("id", "name", "n"), "id"),
        "suspects",
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    links = (
        _in_parts(members)
        .join(members.select("id", "name"), "id")
        .join(texts, "id")
        .groupBy(*tasks)
        .applyInPandas(_block_links(width, percent), "a long, b long")
    )
    named = usable.join(classes.select("name", "id"), "name")
    # a repeated id with different texts connects their classes
    repeated = (
        named.groupBy("doc_id")
        .agg(F.min("id").alias("a"), F.max("id").alias("b"))
        .where("a <> b")
        .select("a", "b")
    )
    joined = components(links.unionByName(repeated))
    return (
        rows.join(classes.select("name", "id"), "name", "left")
        .join(joined, "id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNull(), None)
            .otherwise(F.coalesce("component_id", "id", "doc_id"))
            .alias("component_id"),
        )
    )
