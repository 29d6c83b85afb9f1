"""Token counts by overlap resynchronisation.

Huge documents are cut into overlapping chunks, which are encoded in different tasks. Two
neighbours are spliced at a place in their overlap where both begin a word right after white
space: the tokenizer splits there whatever surrounds it, so this boundary is proven stable. If
an overlap has no such place, the document is cut again with wider overlaps, up to the whole
text at last.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearken.llm.common import stored, text_slices
from hearken.llm.pieces import SpaceFreeCounts

STRIDE = 1 << 16
OVERLAP = 1 << 10
WIDEN = 8

_BOUNDARY = "array<struct<place:long,before:long>>"


def _whole(path: str):
    def work(batches):
        encoder = None
        for batch in batches:
            texts = batch.column("text")
            for row, _, offsets in text_slices(texts):
                encoder = encoder or SpaceFreeCounts(path)
                part = texts.slice(row, len(offsets) - 1)
                lists = encoder.words(t or "" for t in part.to_pylist())
                n = [sum(one) for one in encoder.counts(lists)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(n)),
                        batch.column("n_bytes").slice(row, len(n)),
                        pa.array(n, pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return work


def n_chunks(n_chars: int, stride: int, overlap: int) -> int:
    return max(1, -(-(n_chars - overlap) // stride))


def _cut(stride: int, overlap: int):
    def work(frames):
        for frame in frames:
            for name, text in zip(frame["name"], frame["text"], strict=True):
                for k in range(n_chunks(len(text), stride, overlap)):
                    part = text[k * stride : k * stride + stride + overlap]
                    yield pd.DataFrame({"name": [name], "chunk": [k], "part": [part]})

    return work


def chunk_boundaries(text: str, words: list[str], counts: list[int], start: int, reach: int):
    """Tokens of a chunk, and its stable boundaries in the first and last `reach` characters.

    A boundary is (place in the document, tokens of the chunk before it); it begins a word
    after white space. Lists hold those of the head and of the tail.
    """
    head, tail, place, before = [], [], 0, 0
    for word, n in zip(words, counts, strict=True):
        if place and word:
            if place <= reach:
                head.append({"place": start + place, "before": before})
            if place >= len(text) - reach:
                tail.append({"place": start + place, "before": before})
        place += len(word) + 1
        before += n
    return before, head, tail


def _encode(path: str, stride: int, overlap: int):
    def work(frames):
        encoder = None
        for frame in frames:
            encoder = encoder or SpaceFreeCounts(path)
            lists = encoder.words(frame["part"])
            found = [
                chunk_boundaries(text, words, counts, int(k) * stride, overlap)
                for text, words, counts, k in zip(
                    frame["part"], lists, encoder.counts(lists), frame["chunk"], strict=True
                )
            ]
            yield pd.DataFrame(
                {
                    "name": frame["name"],
                    "chunk": frame["chunk"],
                    "tokens": [x[0] for x in found],
                    "head": [x[1] for x in found],
                    "tail": [x[2] for x in found],
                }
            )

    return work


def _splice(chunks: DataFrame) -> DataFrame:
    """Counts of documents from their chunks; null where two neighbours do not align."""
    order = Window.partitionBy("name").orderBy("chunk")
    places = lambda c: F.transform(c, lambda x: x["place"])
    before = lambda c, at: F.get(F.filter(c, lambda x: x["place"] == at), F.lit(0))["before"]
    aligned = (
        chunks.withColumn("next", F.lead("head").over(order))
        .withColumn("last", F.lead("chunk").over(order).isNull())
        .withColumn("cut", F.array_min(F.array_intersect(places("tail"), places("next"))))
        .withColumn("entry", F.lag("cut").over(order))
        .withColumn(
            "upto", F.when(F.col("last"), F.col("tokens")).otherwise(before("tail", F.col("cut")))
        )
        .withColumn(
            "from", F.when(F.col("chunk") == 0, 0).otherwise(before("head", F.col("entry")))
        )
    )
    own = F.col("upto") - F.col("from")
    return aligned.groupBy("name").agg(
        F.when(F.count(own) == F.count(F.lit(1)), F.sum(own)).alias("n_tokens")
    )


def token_counts(
    docs: DataFrame, path: str, stride: int = STRIDE, overlap: int = OVERLAP
) -> DataFrame:
    """`doc_id`, `n_bytes` and `n_tokens` of each row of `docs(doc_id, text, ..)`.

    `path` names a file of the tokenizers library whose pre-tokenizer drops white space.
    Counts equal those of encoding each whole text without added special tokens. A null text
    is empty and has no tokens; a null doc_id is kept; repeated rows are returned as often; an
    empty table gives an empty result; other columns are ignored. Documents longer than
    `stride + overlap` characters are encoded in chunks.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "n_bytes", F.octet_length("text").cast("long")
    )
    huge = F.char_length("text") > stride + overlap
    result = docs.where(~huge).mapInArrow(_whole(path), "doc_id long, n_bytes long, n_tokens long")
    long_docs = docs.where(huge).withColumn("name", F.sha2("text", 256))
    pending = long_docs.select("name", "text").dropDuplicates(["name"])
    counts = None
    while True:
        chunks = (
            pending.mapInPandas(_cut(stride, overlap), "name string, chunk long, part string")
            .repartition("name", "chunk")
            .mapInPandas(
                _encode(path, stride, overlap),
                f"name string, chunk long, tokens long, head {_BOUNDARY}, tail {_BOUNDARY}",
            )
        )
        spliced = stored(_splice(chunks), "token-counts")
        done = spliced.where("n_tokens is not null")
        counts = done if counts is None else counts.unionByName(done)
        failed = spliced.where("n_tokens is null").select("name")
        if failed.isEmpty():
            break
        pending = pending.join(failed, "name", "left_semi")
        overlap *= WIDEN
    return result.unionByName(
        long_docs.drop("text").join(counts, "name").select("doc_id", "n_bytes", "n_tokens")
    )
