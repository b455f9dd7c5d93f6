"""WARC archives as a chunked record table: oversized payloads are streamed as rows of record identifier and chunk number."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path

#: Payload bytes in a chunk at most; a larger payload becomes a first segment and continuation records.
CHUNK = 1 << 20
#: A payload with more than one page in so many is heavy.
HEAVY = 1024
END = b"\r\n\r\n"
URN = "urn:evenstride:page:"
DATE = "2024-01-01T00:00:00Z"
CHUNK_SCHEMA = "page_id long, url string, refers_to long, chunk_no int, last boolean, total long, data binary, digest_so_far string, digest string"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_bounds(data: memoryview, size: int) -> list[int]:
    """Ends of chunks of at most ``size`` bytes that don't cut a UTF-8 character."""
    ends, at = [], 0
    while len(data) - at > size:
        end = at + size
        while end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return [*ends, len(data)]


def _chunks(size: int):
    """Of each page, its payload's chunks with the digest of all bytes so far; a revisit has one chunk without data."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "url", "refers_to", "chunk_no", "last", "total", "data", "digest_so_far", "digest"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.string()]
        rows, held = [], 0

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            page, url, ref, payload = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                data = memoryview(payload[i].as_buffer() if payload[i].is_valid else b"")
                ends, sha, so_far = chunk_bounds(data, size), hashlib.sha1(), []
                for s, e in zip([0, *ends], ends):
                    sha.update(data[s:e])
                    so_far.append(b32(sha.digest()))
                head = (page[i].as_py(), url[i].as_py(), ref[i].as_py())
                if head[2] is not None:
                    rows.append((*head, 0, True, len(data), b"", so_far[-1], so_far[-1]))
                    continue
                for k, (s, e) in enumerate(zip([0, *ends], ends)):
                    rows.append((*head, k, e == ends[-1], len(data), bytes(data[s:e]), so_far[k], so_far[-1]))
                    held += e - s
                    if held >= 4 * size:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)
                rows, held = [], 0

    return run


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``pages(page_id, url, html)`` as chunk rows (``CHUNK_SCHEMA``); of equal payloads only the smallest page_id's has data.

    Which payloads are equal is found on their SHA-256 alone: first page and pages per digest (an aggregation with map-side combine), then
    page and digest against that, then pages against the revisits by page. Payloads of more than one page in HEAVY are fewer than HEAVY
    and broadcast, so that the join by digest gets no hot group from a payload that a third of all pages share.
    """
    key = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    ids = cut(pages.select("page_id", key.alias("k")), "warc-ids")
    first = ids.groupBy("k").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("pages")).where("pages > 1")
    heavy = F.col("pages") * HEAVY > F.lit(ids.count())
    many = F.broadcast(first.where(heavy).select("k", "refers_to"))
    few = ids.join(many, "k", "left_anti").join(first.where(~heavy), "k")
    again = ids.join(many, "k").unionByName(few.select("k", "page_id", "refers_to")).where("page_id > refers_to").groupBy("page_id", "k").agg(F.min("refers_to").alias("refers_to"))
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), key.alias("k"))
    return full.join(again, ["page_id", "k"], "left").select("page_id", "url", "refers_to", "payload").mapInArrow(_chunks(chunk), CHUNK_SCHEMA)


def record_text(chunks: DataFrame) -> DataFrame:
    """The WARC record of each chunk row, without the two line ends that close it."""
    nl = F.lit("\r\n")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    cont, revisit, cut = F.col("chunk_no") > 0, F.col("refers_to").isNotNull(), ~(F.col("last") & (F.col("chunk_no") == 0))
    http = F.when(cont, F.lit("")).otherwise(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("total").cast("string"), nl, nl))
    field = lambda name, value, when=None: F.when(when if when is not None else F.lit(True), F.concat(F.lit(name + ": "), value, nl)).otherwise(F.lit(""))
    ident = F.concat(F.lit("<" + URN), page, F.when(cont, F.concat(F.lit("#"), (F.col("chunk_no") + 1).cast("string"))).otherwise(F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(cont, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", ident),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", uri, F.col("url").isNotNull()),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        field("WARC-Refers-To", F.concat(F.lit("<" + URN), F.col("refers_to").cast("string"), F.lit(">")), revisit),
        field("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), cut),
        field("WARC-Segment-Origin-ID", F.concat(F.lit("<" + URN), page, F.lit(">")), cont),
        field("WARC-Segment-Total-Length", F.col("total").cast("string"), cut & F.col("last")),
        field("X-Payload-Length", F.col("total").cast("string")),
        field("X-Digest-So-Far", F.concat(F.lit("sha1:"), F.col("digest_so_far")), cut),
        field("Content-Type", F.lit("application/http;msgtype=response"), ~cont),
        field("Content-Length", (F.octet_length(http) + F.octet_length("data")).cast("string")),
    )
    return chunks.select(F.concat(head, nl, http, F.col("data").cast("string")).alias("value"))


def write_warc(chunks: DataFrame, path: str) -> None:
    """Write gzipped WARC files. The text writer puts the record end after each row, so any store Spark can write to will do."""
    record_text(chunks).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class Parser:
    """Records of a byte stream that arrives in pieces; holds a header or one piece at most, never a whole record."""

    def __init__(self) -> None:
        self.state, self.buf, self.need = "head", b"", 0
        self.page = self.ref = self.sha = None
        self.length = 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        while True:
            if self.state == "head":  # empty lines between records: where a file ends within the last record end, the cut adds one
                self.buf = (self.buf + piece).lstrip(b"\r\n")
                piece = b""
                at = self.buf.find(END)
                if at < 0:
                    return
                self._head(self.buf[:at])
                piece, self.buf, self.state = self.buf[at + 4 :], b"", "body" if self.cont else "http"
            elif self.state == "http":
                self.buf += piece
                piece = b""
                at = self.buf.find(END)
                if at < 0:
                    return
                self.need -= at + 4
                piece, self.buf, self.state = self.buf[at + 4 :], b"", "body"
            elif self.state == "body":
                if not piece and self.need:
                    return
                take, piece = piece[: self.need], piece[self.need :]
                self.need -= len(take)
                self.sha.update(take)
                self.length += len(take)
                if not self.need:
                    self.state = "tail"
                    self.buf = b""
                if take or not self.need:
                    done = not self.need and self.whole
                    yield (*self._row(), self.chunk, take, done)
            else:
                self.buf += piece
                piece = b""
                if len(self.buf) < 4:
                    return
                if self.buf[:4] != END:
                    raise ValueError(f"record of page {self.page} does not end where its length says")
                piece, self.buf, self.state = self.buf[4:], b"", "head"
                if not piece:
                    return

    def _head(self, head: bytes) -> None:
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        h = dict(x.split(": ", 1) for x in lines[1:])
        self.need, self.kind = int(h["Content-Length"]), h["WARC-Type"]
        self.cont, self.digest, self.total = self.kind == "continuation", h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
        self.chunk = int(h.get("WARC-Segment-Number", 1)) - 1
        self.whole = "WARC-Segment-Number" not in h or "WARC-Segment-Total-Length" in h
        page = re.fullmatch(f"<{URN}(null|-?[0-9]+)(?:#[0-9]+)?>", h["WARC-Record-ID"])[1]
        page = None if page == "null" else int(page)
        if self.cont and (page != self.page or self.sha is None):
            raise ValueError(f"a continuation of page {page} follows page {self.page}")
        if not self.cont:
            self.page, self.sha, self.length, self.type = page, hashlib.sha1(), 0, self.kind
            self.ref = int(h["WARC-Refers-To"][len(URN) + 1 : -1]) if "WARC-Refers-To" in h else None

    def _row(self) -> tuple:
        if self.type == "revisit":
            return self.page, self.total, self.digest, self.type, self.ref
        got = b32(self.sha.digest())
        if self.whole and not self.need and (got != self.digest or self.length != self.total):
            raise ValueError(f"payload of page {self.page} differs from its digest")
        return self.page, self.length, got, self.type, self.ref


def _parsed(with_data: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.int32(), pa.binary(), pa.bool_()] * with_data
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["chunk_no", "data", "done"] * with_data
        parser = Parser()
        for b in batches:
            rows, held = [], 0
            for x in b.column(0):
                for piece in (x.as_buffer().to_pybytes(), END):
                    for r in parser.feed(piece):
                        if with_data or r[-1]:
                            rows.append(r if with_data else r[:5])
                            held += len(r[6])
                if rows and (len(rows) >= 5000 or with_data and held >= 4 * CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if parser.state != "head" or parser.buf:
            raise ValueError(f"the archive ends within the record of page {parser.page}")

    return run


RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    """Records of WARC files, each checked against its digest; ``with_data``: a row for each piece of payload instead, in order.

    The reader cuts the stream at empty lines; the parser joins the pieces again and follows Content-Length, so payloads may hold
    anything. A gzipped file is read by one task from front to back. A damaged or cut archive raises.
    """
    lines = spark.read.option("lineSep", END.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(_parsed(with_data), RECORD_SCHEMA + ", chunk_no int, data binary, done boolean" * with_data)


def archive(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Write a record per row of ``pages`` to WARC files in the shared folder and read them back.

    Null html is the empty payload, null url leaves its field out, a null page_id is written as such and is always a response.
    Repeated rows get a record each; equal payloads under one page_id are responses alike. An empty table gives no rows.
    """
    path = new_path(pages.sparkSession, "warc")
    write_warc(chunk_table(pages, chunk), path)
    return read_warc(pages.sparkSession, path)
