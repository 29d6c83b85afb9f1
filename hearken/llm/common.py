"""Helpers shared by the operators: tables, stored intermediate results, texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from hearken.runtime import scratch_path

# a batch is worked through in pieces of this many bytes, so that temporary arrays stay small
SLICE_BYTES = 1 << 20

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_WORD_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# all ASCII but letters and digits
IS_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table.

    Cuts the lineage: a lost executor costs the tasks that read it, not what came before.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def text_slices(
    column: pa.Array, size: int = SLICE_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A string column as (first row, bytes, row offsets) in slices of about `size` bytes.

    Null texts are empty. One text longer than the slice is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(flat):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(flat))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and for each row the range of its words.

    Words are runs of bytes outside the set `apart`, by default space and 0x09-0x0D, with A-Z
    in lower case.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~apart[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[:-1]
    before[inner[inner < n]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, lengths)
    power = np.empty(int(lengths.max()), np.uint64)
    power[0] = 1
    power[1:] = np.uint64(_WORD_BASE)
    np.multiply.accumulate(power, out=power)
    value = (LOWER[data[starts[0] :]].astype(np.uint64) + np.uint64(1)) * word[starts[0] :]
    hashed = mix(np.add.reduceat(value * power[place], starts - starts[0]))
    return hashed, np.searchsorted(starts, offsets)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, width: int
) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles.

    A row of fewer than `width` words has its whole sequence as one shingle; a row without
    words has none.
    """
    words, ranges = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = mix(rolled * _STEP + words[k : k + len(rolled)])
        for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                one = np.uint64(width)
                for w in words[a:b]:
                    one = mix(np.array([one * _STEP + w + np.uint64(b - a)]))[0]
                yield np.array([one], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
