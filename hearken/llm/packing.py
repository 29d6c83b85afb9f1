"""Harmonic packing of documents into sequences of a fixed capacity.

Pieces of documents are in classes by the reciprocal of the capacity C: class k holds lengths
in (C/(k+1), C/k], and k pieces of a class always fit into one sequence. A document is cut so
that almost all of its tokens are in pieces of exactly floor(C/k), which fill their sequences
to the last few places; only its last piece, of at most C/16, may be shorter.

Each class fills its sequences with k pieces, one after the other: the worker of a share of a
class numbers its pieces, and the sizes of the shares before it say where it begins. The last,
incomplete sequences of all classes are mixed; they hold fewer than C tokens for each class,
however many documents there are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearken.llm.common import stored, text_slices
from hearken.llm.units import LedIds, encoder

SHORTEST_CUT = 16


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Lengths and classes of the pieces of a document of `n` tokens."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest > capacity // SHORTEST_CUT:
        k = -(-capacity // rest)
        # floor(capacity / k) is the longest exact piece within the rest
        length = capacity // k
        pieces.append((length, k))
        rest -= length
    if rest:
        pieces.append((rest, capacity // rest))
    return pieces


def _pieces(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text"), 1 << 22):
                ids, at = encoder(LedIds, path).rows(data, offsets)
                out = []
                doc_ids = batch.column("doc_id").slice(row, len(at) - 1).to_pylist()
                for k, doc_id in enumerate(doc_ids):
                    raw = ids[at[k] : at[k + 1]].astype("<u4").tobytes()
                    raw += end
                    n, start = len(raw) // 4, 0
                    view = memoryview(raw)
                    for length, k in cut(n, capacity):
                        crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                        out.append((doc_id, start, length, crc, n, k))
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*out, strict=True)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"],
                )

    return work


def _mix_leftovers(capacity: int):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        """First fit, longest first; the rows are bounded by the number of classes."""
        frame = frame.sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]
        )
        room = np.zeros(0, np.int64)
        bins, offsets = [], []
        for length in frame["length"]:
            fits = np.flatnonzero(room >= length)
            if not len(fits):
                room = np.append(room, capacity)
                fits = [len(room) - 1]
            bins.append(fits[0])
            offsets.append(capacity - room[fits[0]])
            room[fits[0]] -= length
        return frame.assign(sequence_id=bins, offset=offsets)[
            [
                "doc_id",
                "start",
                "length",
                "ids_crc32",
                "doc_tokens",
                "sequence_id",
                "offset",
            ]
        ]

    return work


def harmonic_packing(
    docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048
) -> DataFrame:
    """Pack the token ids of `docs(doc_id, text, ..)` into sequences of at most `capacity`.

    A document's ids are those of its text in the tokenizers file `path` (a byte-level BPE
    whose words take a leading space), without added special tokens, then `end_id`. Returns one
    row per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of the ids
    as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset.

    A null or empty text is packed as its `end_id` alone; a null doc_id is kept; repeated rows
    are packed as often; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(
        docs.select("doc_id", "text").mapInArrow(
            _pieces(path, end_id, capacity),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long",
        ),
        "pieces",
    ).withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)))
    sizes = pieces.groupBy("class", "share").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("class")
    ahead = by_class.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "class",
        "share",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"),
        F.sum("n").over(by_class).alias("total"),
    )
    what = ["doc_id", "start", "ids_crc32", "length", "doc_tokens"]
    own = F.row_number().over(Window.partitionBy("class", "share").orderBy(*what))
    numbered = (
        pieces.withColumn("own", own)
        .join(sizes, ["class", "share"])
        .withColumn("place", F.col("ahead") + F.col("own") - 1)
        .withColumn("bin", F.expr("place div class"))
        .withColumn("full", F.expr("bin < total div class"))
    )
    numbered = stored(numbered.select(*what, "class", "place", "bin", "full"), "numbered")
    before = Window.partitionBy("sequence_id").orderBy("place")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # the class in the upper bits keeps the numbers of the classes apart
    full = (
        numbered.where("full")
        .withColumn("sequence_id", F.col("class") * (1 << 44) + F.col("bin"))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .select(*result)
    )
    mixed = (
        numbered.where("not full")
        .groupBy(F.lit(0).alias("one"))
        .applyInPandas(
            _mix_leftovers(capacity),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
            "sequence_id long, offset long",
        )
    )
    return full.unionByName(mixed.select(*result))
