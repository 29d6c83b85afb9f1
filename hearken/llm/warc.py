"""WARC archives: writing pages as records with revisits, and reading by boundary chains.

Written archives are plain WARC 1.1 text, so Spark can split them. A reader that starts in the
middle of a file finds the version line of a record, but a payload may hold the same bytes.
Reading therefore verifies a chain:

1. Tasks cut their share of a file at every version line. Each piece is a candidate record, and
   its Content-Length says where the next record must begin.
2. A task follows the candidates of its share to where each leaves it. From the start of each
   file, pointer jumping over these exits (doubling in every round) finds the one candidate at
   which the true chain enters each share.
3. From there the chain is followed within each share. Only candidates on it are records; magic
   inside payloads is not, whatever follows it.
4. The few payloads that hold magic are put together from their pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearken.llm.common import stored
from hearken.runtime import scratch_path

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$")
_FIELD = rb"(?im)^%s:[ \t]*(.*?)[ \t]*\r?$"


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_pages(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record for each row of `pages(page_id, url, html)` to files below `path`.

    Of rows with equal html of at least LEAST_REVISIT bytes, that with the largest page_id is a
    response and the others are revisits of it; all other rows are responses. A null html is
    empty; a null url is left out of the header, as is a null page_id; rows that repeat the
    largest page_id are each a response.
    """
    pages = pages.select(
        "page_id",
        # a header line must stay a line
        F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    same = F.sha2("html", 256)
    large = pages.where(F.octet_length("html") >= LEAST_REVISIT).select(
        "page_id", same.alias("name")
    )
    last = large.groupBy("name").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")
    )
    # the narrow table of revisits: Spark sees its size and joins accordingly
    revisits = stored(
        large.join(last.where("n > 1"), "name")
        .where("not page_id <=> refers_to")
        .select("page_id", "name", "refers_to")
        .distinct(),
        "revisits",
    )
    # by id and payload: an id may have several payloads
    both = pages.join(
        revisits.select(F.col("page_id").alias("id"), "name", "refers_to"),
        F.col("page_id").eqNullSafe(F.col("id"))
        & (F.when(F.octet_length("html") >= LEAST_REVISIT, same) == F.col("name")),
        "left",
    )
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    record = F.concat(
        F.lit(MAGIC.decode()),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", _urn(F.col("refers_to"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
        F.col("block"),
    )
    both.withColumn("block", block).select(record.alias("value")).write.option(
        "lineSep", END
    ).text(path)


def parse_header(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Of what follows a version line: length of the header, of the block, and the fields."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = piece[: end + 2]
    length = _LENGTH.search(head)
    if not length:
        return None
    fields = {}
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest"):
        found = re.search(_FIELD % name.encode(), head)
        if found:
            fields[name] = found[1].decode("utf-8", "replace")
    return end + 4, int(length[1]), fields


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else b""


_CANDIDATE = (
    "file string, share long, piece long, place long, next long, leaves long, kind string, "
    "page_id long, refers_to long, size long, digest string, whole boolean, declared string"
)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _candidates(batches):
    """Candidates of each share, by place within it, and the length of all shares as rows.

    A share is what one task reads of a file. A row without `next` that has piece -1 is the
    number of bytes of the share.
    """
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in _CANDIDATE.split(", ")]

    def flush(share, rows, used) -> Iterator[pa.RecordBatch]:
        if share is None:
            return
        # pieces are in order: walked backwards, where each leaves the share is known
        leaves: dict[int, int] = {}
        for r in reversed(rows):
            if r[4] is not None:
                leaves[r[3]] = leaves.get(r[4], r[4])
                r[5] = leaves[r[3]]
        rows.append([*share, -1, used] + [None] * (len(names) - 4))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    share, rows, used, n = None, [], 0, 0
    for batch in batches:
        for file, start, value in zip(
            batch.column("file").to_pylist(),
            batch.column("share").to_pylist(),
            batch.column("value"),
            strict=True,
        ):
            if (file, start) != share:
                yield from flush(share, rows, used)
                share, rows, used, n = (file, start), [], 0, 0
            piece = value.as_py()
            # what is before the first version line of a file is no candidate
            if used or start:
                place = used - len(MAGIC)
                found = parse_header(piece)
                row = [file, start, n, place] + [None] * (len(names) - 4)
                if found:
                    head, length, fields = found
                    block = piece[head : head + length]
                    row[4] = place + len(MAGIC) + head + length + len(END)
                    row[6:9] = [
                        fields.get("WARC-Type"),
                        _page(fields.get("WARC-Record-ID")),
                        _page(fields.get("WARC-Refers-To")),
                    ]
                    row[12] = (fields.get("WARC-Payload-Digest") or "").removeprefix("sha1:")
                    if len(block) == length:
                        payload = payload_of(block)
                        row[9:12] = [len(payload), hashlib.sha1(payload).hexdigest(), True]
                    else:
                        row[11] = False
                rows.append(row)
            n += 1
            used += len(piece) + len(MAGIC)
    yield from flush(share, rows, used)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", MAGIC.decode())
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("share"),
            F.col("value").cast("binary").alias("value"),
        )
    )


def _follow(frame: pd.DataFrame) -> pd.DataFrame:
    """Walk from the entry of a share over its candidates."""
    following = dict(zip(frame["place"], frame["next"], strict=True))
    place = frame.loc[frame["entry"], "place"].iloc[0] if frame["entry"].any() else None
    on_chain = []
    while place in following:
        on_chain.append(place)
        place = following[place]
    return frame[frame["place"].isin(on_chain)][["file", "share", "place"]]


def _wanted_pieces(batches):
    """Bytes of the pieces, with their number in the share."""
    share, n = None, 0
    for batch in batches:
        numbers = []
        for key in zip(
            batch.column("file").to_pylist(), batch.column("share").to_pylist(), strict=True
        ):
            if key != share:
                share, n = key, 0
            numbers.append(n)
            n += 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"),
                batch.column("share"),
                pa.array(numbers, pa.int64()),
                batch.column("value"),
            ],
            ["file", "share", "piece", "value"],
        )


def _join_pieces(frame: pd.DataFrame) -> pd.DataFrame:
    piece = MAGIC.join(frame.sort_values("place")["value"].map(bytes))
    head, length, _ = parse_header(piece)
    payload = payload_of(piece[head : head + length])
    first = frame.sort_values("place").iloc[0]
    return pd.DataFrame(
        {
            "file": [first["file"]],
            "owner": [first["owner"]],
            "joined_size": [len(payload)],
            "joined_digest": [hashlib.sha1(payload).hexdigest()],
        }
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at `path`: kind, page_id, refers_to, size and digest of the
    payload, and the digest `declared` in the header.

    Only records on the chain from the start of their file are returned: magic inside payloads
    is rejected, and what follows a broken record is not guessed. `size` and `digest` (SHA-1)
    are measured on what was read; a revisit has no payload of its own. Empty files have none.
    """
    found = stored(_pieces(spark, path).mapInArrow(_candidates, _CANDIDATE), "candidates")
    # shares of a file follow each other: where each begins is the sum of those before it
    order = Window.partitionBy("file").orderBy("share")
    begins = found.where("piece = -1").select(
        "file",
        "share",
        F.coalesce(
            F.sum("place").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("base"),
    )
    found = found.where("piece >= 0").join(begins, ["file", "share"])
    for c in ("place", "next", "leaves"):
        found = found.withColumn(c, F.col(c) + F.col("base"))
    found = stored(found.drop("base"), "placed")

    # pointer jumping from the start of each file over the places where chains leave shares
    usable = found.where("leaves is not null")
    targets = usable.select("file", F.col("leaves").alias("place")).distinct()
    starts = usable.where("place = 0").select("file", "place")
    jumps = stored(
        usable.join(targets.unionByName(starts).distinct(), ["file", "place"]).select(
            "file", "place", "leaves"
        ),
        "jumps",
    )
    reached, count = stored(starts, "reached"), -1
    while True:
        ahead = reached.join(jumps, ["file", "place"]).select("file", F.col("leaves").alias("place"))
        reached = stored(reached.unionByName(ahead).distinct(), "reached")
        before, count = count, reached.count()
        if count == before:
            break
        twice = jumps.select("file", F.col("place").alias("leaves"), F.col("leaves").alias("end"))
        jumps = stored(
            jumps.join(twice, ["file", "leaves"], "left").select(
                "file", "place", F.coalesce("end", "leaves").alias("leaves")
            ),
            "jumps",
        )

    entries = reached.withColumn("entry", F.lit(True))
    on_chain = (
        found.where("next is not null")
        .join(entries, ["file", "place"], "left")
        .select("file", "share", "place", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
        .groupBy("file", "share")
        .applyInPandas(_follow, "file string, share long, place long")
    )
    chained = stored(
        found.join(on_chain.withColumn("real", F.lit(True)), ["file", "share", "place"], "left"),
        "chained",
    )
    records = chained.where("real")
    broken = records.where("not whole").select("file", F.col("place").alias("owner"))
    if not broken.isEmpty():
        # pieces up to the next true record belong to the one before them
        back = Window.partitionBy("file").orderBy("place")
        owned = chained.withColumn(
            "owner", F.last(F.when(F.col("real"), F.col("place")), ignorenulls=True).over(back)
        )
        owned = owned.join(broken, ["file", "owner"]).select(
            "file", "share", "piece", "place", "owner"
        )
        joined = (
            _pieces(spark, path)
            .mapInArrow(_wanted_pieces, "file string, share long, piece long, value binary")
            .join(owned, ["file", "share", "piece"])
            .groupBy("file", "owner")
            .applyInPandas(
                _join_pieces,
                "file string, owner long, joined_size long, joined_digest string",
            )
            .withColumnRenamed("owner", "place")
        )
        records = (
            records.join(joined, ["file", "place"], "left")
            .withColumn("size", F.coalesce("joined_size", "size"))
            .withColumn("digest", F.coalesce("joined_digest", "digest"))
        )
    return records.select("kind", "page_id", "refers_to", "size", "digest", "declared")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write `pages(page_id, url, html, ..)` as WARC files and report what is read back.

    Returns page_id, payload_bytes, payload_digest (SHA-1 in hex), record_type, refers_to, one
    row per page; size and digest of a revisit are those of the response it refers to. Rows of
    one page_id with different payloads are records of their own, found again by id and digest.
    See `write_pages` for nulls and repeated rows; an empty table gives an empty result. `path` is
    a new folder, by default one in the shared folder.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_pages(pages, path)
    records = read_records(spark, path)
    responses = records.where("kind = 'response'")
    # an id may have several payloads: a revisit names that of its response
    of = responses.select(
        F.col("page_id").alias("refers_to"),
        F.col("digest").alias("declared"),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
    ).dropDuplicates(["refers_to", "declared"])
    revisits = records.where("kind = 'revisit'").select("page_id", "kind", "refers_to", "declared")
    columns = [
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        "refers_to",
    ]
    return (
        responses.withColumnsRenamed({"size": "payload_bytes", "digest": "payload_digest"})
        .select(*columns)
        .unionByName(revisits.join(of, ["refers_to", "declared"], "left").select(*columns))
    )
