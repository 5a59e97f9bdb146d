"""WARC archives with duplicate payloads written as revisit records.

Digests and ids are shuffled to find the response of each payload; the pages meet the
repeated digests once, and one pass writes the records.  A record is text, so Spark's text writer with the record end as line
separator writes the archive: any file system, committed by task, no Python.
Reading back frames the records by Content-Length, then joins revisits to the
responses they refer to, by page and payload.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, small_batches, utf8

END = b"\r\n\r\n"
ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")
#: codes for line breaks in an address; only addresses that hold some are coded, and marked
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
CODED = "X-Coded-URI"
READ = "page_id long, url string, record_type string, refers_to long, digest string, length long, payload binary"


def resolve_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_digest, payload_bytes, record_type and refers_to.

    Of the rows with one payload of at least ``least_bytes`` the largest page_id is
    the response.  Digests of headers alone are shuffled to find the repeated ones; that
    table is written, so that its size is known before pages meet it: a small one is
    sent to them, and only beyond that are pages shuffled.  Smaller payloads have keys
    of their own there, spread over all tasks.
    """
    digest = F.sha1(utf8(F.col("html")))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    groups = (
        pages.where(size >= least_bytes)
        .groupBy(digest.alias("same"))
        .agg(F.max("page_id").alias("origin"), F.count("*").alias("n"))
        .where("n > 1 and origin is not null")
        .select("same", "origin")
    )
    groups, _ = materialize(groups, "repeated-payloads")
    whole = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), size.alias("payload_bytes"), digest.alias("payload_digest"))
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload_digest").cast("string"))
    key = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(alone)
    again = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    return (
        whole.withColumn("key", key)
        .join(groups, F.col("key") == F.col("same"), "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("origin")))
        .drop("origin", "same", "key")
    )


def write_archives(resolved: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", file_records: int = 2048) -> None:
    """Write the records of ``resolve_revisits`` as WARC/1.1 files under ``path``, headers made anew.

    Line breaks in a url are coded and the record is marked, so no value can end a
    header and reading gives the url back.  A file has ``file_records`` records
    at most, so that one large partition is read by several tasks.
    """
    coded = F.col("url")
    for plain, code in ESCAPES:
        coded = F.replace(coded, F.lit(plain), F.lit(code))
    broken = F.col("url").contains("\r") | F.col("url").contains("\n")
    target = F.when(broken, F.concat(F.lit(f"\r\n{CODED}: yes\r\nWARC-Target-URI: "), coded)).when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), "url")).otherwise("")
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit(f"\r\nWARC-Record-ID: <{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"),
        target,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID}"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string")), F.lit(END.decode()),
    )
    resolved.select(F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", END.decode()).option("compression", compression).option("maxRecordsPerFile", file_records).text(path)


def record(head: bytes, body: bytes) -> tuple:
    """One record's fields, in order of ``READ``."""
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record: {lines[0][:80]!r}")
    named = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])

    def page(name: str) -> int | None:
        return int(v[len(ID) + 1 : -1]) if (v := named.get(name, "")) not in ("", f"<{ID}>") else None

    url = named.get("WARC-Target-URI")
    for plain, code in reversed(ESCAPES) if CODED in named else ():
        url = url.replace(code, plain)
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if named["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"record {named['WARC-Record-ID']}: payload and digest differ")
    return page("WARC-Record-ID"), url, named["WARC-Type"], page("WARC-Refers-To"), digest, int(named["Content-Length"]), body


class Frames:
    """Records of a file that comes in pieces, each ending where ``END`` was; holds one record at most."""

    def __init__(self):
        self.head: bytes | None = None
        self.parts: list[bytes] = []
        self.size = self.wanted = 0

    def push(self, piece: bytes) -> tuple | None:
        """Take a piece with its end; a record that is complete now."""
        if self.head is None:
            self._open(piece)
            return None
        self.parts.append(piece + END)
        self.size += len(piece) + len(END)
        if self.size < self.wanted:
            return None
        whole = b"".join(self.parts)
        made = record(self.head, whole[: self.wanted - len(END)])
        # where a payload ends in half an END the reader cut too early: the rest of the piece opens the next record
        rest = whole[self.wanted :].removesuffix(END)
        self.head = None
        if rest:
            self._open(rest)
        return made

    def _open(self, head: bytes) -> None:
        self.head, self.parts, self.size = head, [], 0
        self.wanted = int(LENGTH.search(head)[1]) + len(END)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record under ``path``; a response's payload is held against its digest.

    Spark's text reader cuts a file at the records' ends and keeps its order, so a task
    holds a batch of records, never a file; payloads are put together again by
    Content-Length.  Files that are not compressed could be split between records' parts
    and are therefore read whole.
    """
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def framed(pieces: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        file, frames = None, Frames()
        rows: list[tuple] = []
        held = 0
        for of, piece in pieces:
            if of != file:
                if frames.head is not None:
                    raise ValueError(f"{file} ends within a record")
                file = of
            made = frames.push(piece)
            if made:
                rows.append(made)
                held += made[5]
            if len(rows) == 500 or held > 1 << 24:
                yield batch_of(rows)
                rows, held = [], 0
        if frames.head is not None:
            raise ValueError(f"{file} ends within a record")
        if rows:
            yield batch_of(rows)

    def cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for of, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in value.as_py().removesuffix(END).split(END) if whole else [value.as_py()]:
                    yield of, piece

    files = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "part-*.gz").text(path)
    plain = spark.read.option("pathGlobFilter", "part-*.txt").text(path, wholetext=True)
    columns = [F.input_file_name().alias("file"), F.col("value").cast("binary").alias("piece")]
    return files.select(*columns).mapInArrow(lambda b: framed(cut(b, False)), READ).unionByName(plain.select(*columns).mapInArrow(lambda b: framed(cut(b, True)), READ))


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to deduplicated archives and read them back, a row per page.

    Cases: null html is an empty payload; rows of one page_id are records each, whatever
    their payloads, and those that repeat the response's page_id and payload are
    responses as well; a null page_id can be a revisit, and a payload all of whose
    page_ids are null has responses only; payloads of any size that a row can hold; an
    empty table writes an empty archive; further columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    with small_batches(spark):
        write_archives(resolve_revisits(pages, least_bytes), path)
        # kept of a record are its headers; payloads were checked against their digests in the pass that read them
        read, _ = materialize(read_archives(spark, path).drop("payload"), "warc-headers")
    responses = read.where("record_type = 'response'")
    revisits = read.where("record_type = 'revisit'")
    # a revisit names its response by page and payload: pages may share an id
    origins = responses.groupBy(F.col("page_id").alias("origin"), F.col("digest").alias("same")).agg(F.first("length").alias("origin_bytes"))
    found = revisits.join(origins, (F.col("refers_to") == F.col("origin")) & (F.col("digest") == F.col("same")), "left")
    columns = ["page_id", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url"]
    every = responses.select(F.col("length").alias("payload_bytes"), *columns).unionByName(found.select(F.col("origin_bytes").alias("payload_bytes"), *columns))
    return every.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
