"""Best-fit packing by exact complements: as few sequences of a capacity as lengths allow.

Documents longer than the capacity C are cut into pieces of C tokens; all else stays whole. How
many pieces have each length is a table of at most C rows, however large the corpus, so the
packing is found on that table and only then applied to the pieces, which never leave the
workers:

1. A sequence is opened with the longest piece left. Indexes by single lengths, by sums of two
   and by sums of three tell which pieces fill its gap exactly; a combination is taken if enough
   pieces of its lengths are left. Without one, the longest piece that fits takes its place (best
   fit) and the rest of the gap is looked up again. The pattern found is used as often as its
   lengths allow, which uses up one of them.
2. Each pattern owns ranges of the pieces of its lengths, counted within a length. A piece finds
   its sequence and offset by its number alone.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearken.llm.common import stored, text_slices
from hearken.llm.units import SpacelessIds, encoder

Pattern = dict[int, int]


class Complements:
    """Which lengths are left, and which one, two or three of them make a given sum.

    The lists of the indexes are made when a sum is first asked for. Lengths only ever run out,
    so a list never misses a combination; what has run out is dropped when it is met.
    """

    def __init__(self, counts: dict[int, int]):
        self.left = Counter({length: n for length, n in counts.items() if n > 0})
        self.lengths = np.array(sorted(self.left), np.int64)
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def longest(self, most: int, used: Counter) -> int | None:
        """The longest length of at most `most` that is left."""
        at = int(np.searchsorted(self.lengths, most, side="right"))
        dead = 0
        found = None
        for length in self.lengths[:at][::-1].tolist():
            if self.left[length] > used[length]:
                found = length
                break
            dead += 1
        if dead > 8:
            self.lengths = np.array([n for n in self.lengths.tolist() if self.left[n]], np.int64)
        return found

    def _candidates(self, index: dict[int, list[int]], total: int, least: int) -> list[int]:
        """Lengths from `least` to `total - 1`, the longest last."""
        if total not in index:
            a, b = np.searchsorted(self.lengths, [least, total])
            index[total] = self.lengths[a:b].tolist()
        found = index[total]
        while found and not self.left[found[-1]]:
            found.pop()
        return found

    def _pair(self, total: int, used: Counter) -> tuple[int, ...] | None:
        if total not in self.pairs:
            own = self._candidates({}, total, -(-total // 2))
            self.pairs[total] = [n for n in own if self.left[total - n]]
        found, dead = self.pairs[total], 0
        for n in reversed(found):
            other = total - n
            if self.left[n] > used[n] + (n == other) and self.left[other] > used[other]:
                return n, other
            dead += 1
        if dead:
            self.pairs[total] = [n for n in found if self.left[n] and self.left[total - n]]
        return None

    def _triple(self, total: int, used: Counter) -> tuple[int, ...] | None:
        found, dead = self._candidates(self.triples, total, -(-total // 3)), 0
        for n in reversed(found):
            if self.left[n] > used[n]:
                used[n] += 1
                pair = self._pair(total - n, used)
                used[n] -= 1
                if pair:
                    return n, *pair
            dead += not self.left[n]
        if dead:
            self.triples[total] = [n for n in found if self.left[n]]
        return None

    def filling(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths left besides `used` whose sum is the gap."""
        if self.left[gap] > used[gap]:
            return (gap,)
        return self._pair(gap, used) or self._triple(gap, used)

    def pattern(self, capacity: int) -> Pattern | None:
        """The lengths of the next sequence."""
        used: Counter = Counter()
        gap = capacity
        while gap:
            longest = self.longest(gap, used)
            if longest is None:
                break
            if gap > 3 * longest:
                # beyond any three lengths: best fit, as often as it leaves room for three
                n = min(self.left[longest] - used[longest], (gap - 3 * longest - 1) // longest + 1)
                used[longest] += n
                gap -= n * longest
            elif gap < capacity and (exact := self.filling(gap, used)):
                used.update(exact)
                gap = 0
            else:
                used[longest] += 1
                gap -= longest
        return {length: n for length, n in used.items() if n} or None


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """How to pack `counts` pieces of each length: patterns of lengths, and how often each."""
    index = Complements(counts)
    found = []
    while own := index.pattern(capacity):
        times = min(index.left[length] // n for length, n in own.items())
        for length, n in own.items():
            index.left[length] -= n * times
        found.append((own, times))
    return found


def slots(found: list[tuple[Pattern, int]]) -> np.ndarray:
    """Ranges of pieces of a length and where they go, by length and first piece.

    Columns: length, first piece, first sequence, offset there, pieces in each sequence. A
    pattern has at most sqrt(2 C) different lengths, so the table is bounded by C alone.
    """
    rows, taken, sequence = [], Counter(), 0
    for own, times in found:
        offset = 0
        for length, n in sorted(own.items(), reverse=True):
            rows.append((length, taken[length], sequence, offset, n))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_PLACE = 1 << 44


def _pieces(path: str, end_id: int, capacity: int, shares: int):
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "share"]

    def work(batches):
        # which share numbers a piece is chosen once: the pieces are stored before they are read
        draw = np.random.default_rng()
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text"), 1 << 22):
                ids, at = encoder(SpacelessIds, path).rows(data, offsets)
                out = []
                doc_ids = batch.column("doc_id").slice(row, len(at) - 1).to_pylist()
                for k, doc_id in enumerate(doc_ids):
                    raw = memoryview(ids[at[k] : at[k + 1]].astype("<u4").tobytes() + end)
                    n = len(raw) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        out.append((doc_id, piece, start, length, crc))
                columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                columns.append(pa.array(draw.integers(shares, size=len(out))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return work


def _placed(table: np.ndarray):
    firsts = table[:, 0] * _PLACE + table[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def work(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            place = batch.column("place").to_numpy()
            own = table[np.searchsorted(firsts, length * _PLACE + place, side="right") - 1]
            beyond = place - own[:, 1]
            sequence = own[:, 2] + beyond // own[:, 4]
            offset = own[:, 3] + beyond % own[:, 4] * length
            columns = [batch.column(name) for name in names[:5]]
            columns[1] = columns[1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names
            )

    return work


def numbered(pieces: DataFrame) -> DataFrame:
    """`pieces` with `place`: their number within their length, counted share by share."""
    sizes = pieces.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("share")
    ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "share", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")
    return (
        pieces.withColumn("own", F.row_number().over(own) - 1)
        .join(sizes, ["length", "share"])
        .withColumn("place", F.col("ahead") + F.col("own"))
    )


def best_fit_packing(
    docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096
) -> DataFrame:
    """Pack the token ids of `docs(doc_id, text, ..)` into sequences of at most `capacity`.

    A document's ids are those of its text in the tokenizers file `path` (a vocabulary that
    drops white space and splits words by kind), without added special tokens, then `end_id`.
    Returns one row per piece: doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), sequence_id,
    offset.

    A null or empty text is packed as its `end_id` alone; a null doc_id is kept; repeated rows
    are packed as often; an empty table gives an empty result; other columns are ignored.
    """
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(
        docs.select("doc_id", "text").mapInArrow(
            _pieces(path, end_id, capacity, shares),
            "doc_id long, piece long, start long, length long, ids_crc32 long, share long",
        ),
        "best-fit-pieces",
    )
    counts = {
        r["length"]: r["n"]  # at most `capacity` rows
        for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    return numbered(pieces).mapInArrow(
        _placed(slots(patterns(counts, capacity))),
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long",
    )
