"""WARC archives as a chunked record table.

Writing: every page becomes one record, split into rows of at most `CHUNK_CHARS`
characters; the first row is the record, the others its `continuation` segments, so a
row never holds a whole oversized payload. Rows are written by Spark's text writer with
the record separator of the format between them, which makes every part file a WARC
file.

Reading: a compressed file is read by one task from front to back. Pieces between
separators are put together again by `Content-Length`, so separators inside payloads do
no harm; each segment is one row (record, chunk number), and a digest and a length are
carried from chunk to chunk until the record ends. Memory holds one segment.

Deduplication: of records with equal payloads of at least `LEAST_BYTES`, the one with the
smallest page_id is a response and the others are revisits, written without payload and
resolved against the response after reading.

Defined cases: null payloads are empty; pages that share payload and the smallest id are
all responses; null ids and urls are written as absent; equal payloads below
`LEAST_BYTES` are all responses; an empty table makes no archive; only the named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrain.llm.common import ship_package, small_side, stored
from fleetgrain.session import shared_dir

# Separators and version line of the format.
END = "\r\n\r\n"
VERSION = "WARC/1.1"

#: Characters of one segment.
CHUNK_CHARS = 256 << 10
#: Shorter payloads are never revisits.
LEAST_BYTES = 100
WRITTEN_AT = "2024-01-01T00:00:00Z"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(" ", *parts))
    groups = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, refers_to, digest) of the pages whose payload another page has, stored.

    Payloads are hashed where they are; only digests are shuffled, combined per task.
    """
    digests = stored(
        pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
        .where(F.octet_length("html") >= least)
        .select("page_id", F.unhex(F.sha2("html", 256)).alias("digest")),
        "page-digests",
    )
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    found = digests.join(firsts, "digest").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to")))
    return stored(found.select("page_id", "refers_to", F.lower(F.hex("digest")).alias("digest")).distinct(), "page-revisits")


def records(pages: DataFrame, seen: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The chunked table: a row per segment with its WARC head and payload, as `value`."""
    slim = pages.select(
        F.col(id_col).alias("page_id"), F.regexp_replace(F.col(url_col), "[\r\n]", " ").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    known = small_side(seen.select(F.col("page_id").alias("r_id"), "refers_to", "digest"), 120)
    joined = slim.join(known, F.col("page_id") == F.col("r_id"), "left").withColumn(
        "html", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit(""))
    )
    last = F.greatest(F.ceil(F.length("html") / F.lit(CHUNK_CHARS)).cast("int"), F.lit(1))
    parts = joined.withColumn("last", last).select(
        "page_id", "url", "refers_to", "digest", "last", "html", F.explode(F.sequence(F.lit(1), "last")).alias("chunk")
    )
    body = F.substr("html", (F.col("chunk") - 1) * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS))
    parts = parts.select("page_id", "url", "refers_to", "digest", "last", "chunk", body.alias("body"))
    name = lambda key, chunk: _uuid(F.coalesce(key.cast("string"), F.lit("-")), F.coalesce(F.col("url"), F.lit("-")), chunk.cast("string"))
    kind = F.when(F.col("chunk") > 1, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    line = lambda title, value: F.concat(F.lit(f"{title}: "), value.cast("string"))
    split = F.col("last") > 1
    later = F.col("chunk") > 1
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        line("WARC-Type", kind),
        line("WARC-Record-ID", name(F.col("page_id"), F.col("chunk"))),
        line("WARC-Date", F.lit(WRITTEN_AT)),
        line("WARC-Target-URI", F.col("url")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("body")),
        F.when(split, line("WARC-Segment-Number", F.col("chunk"))),
        F.when(later, line("WARC-Segment-Origin-ID", name(F.col("page_id"), F.lit(1)))),
        line("WARC-Page-ID", F.col("page_id")),
        F.when(~later, line("WARC-Refers-To-Page-ID", F.col("refers_to"))),
        F.when(~later, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))),
        F.when(split, line("WARC-Segments", F.col("last"))),
    )
    return parts.select(F.concat(head, F.lit(END), F.col("body")).alias("value"))


def write(pages: DataFrame, folder: str, **columns) -> None:
    """Write the archives of `pages` below `folder`, one per task."""
    rows = records(pages, revisits(pages, **{k: v for k, v in columns.items() if k != "url_col"}), **columns)
    rows.write.option("lineSep", END).option("compression", "gzip").text(folder)


class SegmentReader:
    """Takes the pieces of a file between separators, in order, and gives its segments."""

    def __init__(self):
        self.head: dict[str, str] | None = None
        self.body: list[bytes] = []
        self.left = 0
        self.stray = False

    def take(self, piece: bytes) -> tuple[dict[str, str], bytes] | None:
        if self.head is None:
            if self.stray:
                piece, self.stray = piece[2:], False
            if not piece:
                return None
            self.head = {}
            for line in piece.decode("utf-8", "replace").split("\r\n")[1:]:
                title, _, value = line.partition(": ")
                self.head[title.lower()] = value
            self.left = int(self.head["content-length"])
            self.body = []
            return None
        self.body.append(piece)
        self.left -= len(piece)
        if self.left == 2:
            # a payload that ends in a line break: the separator was found two bytes early
            self.body.append(b"\r\n")
            self.left, self.stray = 0, True
        if self.left > 0:
            self.left -= len(END)  # the separator was part of the payload
            self.body.append(END.encode())
            return None
        done = (self.head, b"".join(self.body))
        self.head = None
        return done


CHUNKS = "page_id bigint, record_type string, refers_to bigint, claimed string, chunk int, last int, chunk_bytes bigint, bytes_so_far bigint, digest_so_far string"


def read_chunks(spark, folder: str) -> DataFrame:
    """A row per segment of the archives below `folder`, lengths and digests carried along.

    `digest_so_far` of the last chunk is the digest of the whole payload.
    """
    ship_package(spark)
    shape = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("claimed", pa.string()), ("chunk", pa.int32()),
         ("last", pa.int32()), ("chunk_bytes", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader = None, SegmentReader()
        digest, total, origin = hashlib.sha256(), 0, None
        for batch in batches:
            rows: list[list] = [[] for _ in shape]
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if name != file:
                    file, reader = name, SegmentReader()
                segment = reader.take(piece.as_py())
                if segment is None:
                    continue
                head, body = segment
                chunk = int(head.get("warc-segment-number", 1))
                if chunk == 1:
                    digest, total, origin = hashlib.sha256(), 0, head
                digest.update(body)
                total += len(body)
                number = lambda title, h=origin: int(h[title]) if title in h else None
                row = (
                    number("warc-page-id"), origin["warc-type"], number("warc-refers-to-page-id"), origin.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                    chunk, int(head.get("warc-segments", 1)), len(body), total, digest.hexdigest(),
                )
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, shape, strict=True)], schema=shape)

    pieces = spark.read.option("lineSep", END).text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    return pieces.mapInArrow(run, CHUNKS)


def resolve(chunks: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes length and digest of the response that it names, read from the
    archive; the digests must agree.
    """
    whole = stored(chunks.where(F.col("chunk") == F.col("last")).drop("chunk", "last", "chunk_bytes"), "warc-records")
    responses = whole.where("record_type = 'response'").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to")
    )
    named = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "payload_digest"])
    later = whole.where("record_type = 'revisit'").join(named, "refers_to").where("claimed = payload_digest")
    return responses.unionByName(later.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def archive_and_read(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages as archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    write(pages, folder, **columns)
    return resolve(read_chunks(spark, folder))
