"""WARC archives as a chunked record table (op6).

Writing: a payload longer than ``chunk`` bytes becomes a WARC record of segment
1 and ``continuation`` records, so that a row is a record identifier, a chunk
number and at most ``chunk`` bytes; Spark's text writer writes the rows as they
are, with the record end as line end, through its commit protocol and to any
store. Reading: each archive is unzipped and parsed as a stream; a record of one
segment is digested on the spot, and only the segments of oversized records go
on as (record, chunk number, bytes) rows, which are digested in chunk order with
a digest carried from row to row. No step holds a whole oversized record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

CHUNK = 64 << 10
LEAST = 100
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
_CHUNKS = "page_id long, record_type string, refers_to long, said string, segment int, n_bytes long, digest string, data binary"


def mark_revisits(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload (binary), n_bytes, said (its SHA-256), refers_to (null: a response).

    The smallest id of equal payloads of ``least`` bytes and more is their
    response. A null payload is empty. A row without id is a response and never
    one that others refer to; rows that repeat the smallest id are responses too.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("said", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    ids = p.select("page_id", "said", "n_bytes").where(F.col("n_bytes") >= least)
    first = ids.groupBy("said").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = ids.select("page_id", "said").join(first, "said").where("page_id > refers_to").distinct()
    return p.join(later, ["page_id", "said"], "left")


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = LEAST, date: str = "2024-01-01T00:00:00Z", per_file: int = 2048) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files of at most ``per_file`` records below ``path``."""
    p = mark_revisits(pages, least)
    p = p.withColumn("parts", F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk))).otherwise(1).cast("int"))
    p = p.withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    rid = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    body = F.when(F.col("refers_to").isNull(), F.expr(f"cast(substring(payload, (segment - 1) * {chunk} + 1, {chunk}) as string)")).otherwise("")
    head = F.when(F.col("segment") == 1, F.lit(HTTP_HEAD)).otherwise("")
    split = F.col("parts") > 1
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("refers_to").isNotNull(), "revisit").when(F.col("segment") > 1, "continuation").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), rid, F.when(F.col("segment") > 1, F.concat(F.lit(":"), F.col("segment").cast("string"))).otherwise(""), F.lit(">"),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(F.regexp_replace("url", "[\r\n]", " "), F.lit("about:blank")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.when(split, F.concat(F.lit("\r\nWARC-Segment-Number: "), F.col("segment").cast("string"))).otherwise(""),
        F.when(F.col("segment") > 1, F.concat(F.lit("\r\nWARC-Segment-Origin-ID: <urn:page:"), rid, F.lit(">"))).otherwise(""),
        F.when(split & (F.col("segment") == F.col("parts")), F.concat(F.lit("\r\nWARC-Segment-Total-Length: "), (F.col("n_bytes") + len(HTTP_HEAD)).cast("string"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("said"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(F.concat(head, body)).cast("string"), F.lit(END), head, body,
    )
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class _Stream:
    """Bytes of an archive, gzipped (of one or more members) or not, unpacked little by little."""

    def __init__(self, raw: bytes | pa.Buffer, step: int = 64 << 10) -> None:
        self.raw, self.step, self.at, self.buf = memoryview(raw), step, 0, bytearray()
        self.unzip = zlib.decompressobj(31) if bytes(self.raw[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + self.step]
        self.at += len(piece)
        if self.unzip is None:
            self.buf += piece
            return True
        self.buf += self.unzip.decompress(piece)
        if self.unzip.eof:  # the next member
            self.at -= len(self.unzip.unused_data)
            self.unzip = zlib.decompressobj(31)
        return True

    def head(self) -> bytes | None:
        """Up to the blank line; None at the end."""
        while (i := self.buf.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buf[:i])
        del self.buf[: i + 4]
        return out

    def take(self, n: int) -> bytes:
        """At most n bytes, fewer only at the end."""
        while len(self.buf) < n and self._more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def records(raw: bytes | pa.Buffer, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of one archive: a row a record, or a row a chunk (with its bytes) where a record has segments or more than ``chunk`` bytes."""
    s = _Stream(raw)
    while (head := s.head()) is not None:
        if not (head := head.lstrip(b"\r\n")):
            continue
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
        page = lambda k: None if (x := h[k].strip("<>").split(":")[2]) == "null" else int(x)
        kind, left = h["warc-type"], int(h["content-length"])
        first = int(h.get("warc-segment-number", 1))
        if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
            got = s.take(min(left, len(HTTP_HEAD)))
            left -= len(got)
        row = {"page_id": page("warc-segment-origin-id" if kind == "continuation" else "warc-record-id"), "record_type": "response" if kind == "continuation" else kind, "refers_to": page("warc-refers-to") if kind == "revisit" else None, "said": h.get("warc-payload-digest", "").rpartition(":")[2]}
        if "warc-segment-number" not in h and left <= chunk:
            data = s.take(left)
            yield row | {"segment": 0, "n_bytes": len(data), "digest": hashlib.sha256(data).hexdigest(), "data": None}
        else:
            piece = 0
            while left or not piece:
                data = s.take(min(left, chunk))
                if not data and left:
                    raise ValueError("an archive ends within a record")
                left -= len(data)
                yield row | {"segment": (first << 12) + piece if piece else first << 12, "n_bytes": len(data), "digest": None, "data": data}
                piece += 1
        s.take(len(END))


def _batch(rows: list[dict], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    cols = [x.split() for x in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in cols], [n for n, _ in cols])


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives below ``path``: segment 0 is a record by itself; other rows are chunks in order, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for r in records(raw.as_buffer(), chunk):
                    rows.append(r)
                    held += len(r["data"] or b"") + 300
                    if held > 4 << 20:
                        yield _batch(rows, _CHUNKS)
                        rows, held = [], 0
                yield _batch(rows, _CHUNKS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _CHUNKS)


def join_chunks(chunks: DataFrame) -> DataFrame:
    """One row a record of several chunks: chunks in order, a digest carried along; a repeated chunk number is another copy of the same record."""
    fields = "page_id long, record_type string, refers_to long, said string, n_bytes long, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, copies, size, state, first = None, None, 0, 0, hashlib.sha256(), None

        def done() -> list[dict]:
            return [{"page_id": key[0], "record_type": "response", "refers_to": None, "said": key[1], "n_bytes": size, "digest": state.hexdigest()}] * copies if key else []

        for batch in batches:
            rows = []
            for page, said, segment, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                page, said, segment = page.as_py(), said.as_py(), segment.as_py()
                if (page, said) != key:
                    rows += done()
                    key, last, copies, size, state, first = (page, said), None, 0, 0, hashlib.sha256(), segment
                copies += segment == first
                if segment != last:
                    b = data.as_buffer()
                    state.update(b)
                    size += len(b)
                    last = segment
            if rows:
                yield _batch(rows, fields)
        yield _batch(done(), fields)

    parts = chunks.select("page_id", "said", "segment", "data").repartition("page_id", "said").sortWithinPartitions("page_id", "said", "segment")
    return parts.mapInArrow(run, fields)


def read_archives(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to, verified (the digest read is the one the record states). A revisit has its response's payload."""
    # the archives are read once; what is kept holds bytes of oversized records only
    chunks = written(read_chunks(spark, path, chunk), "chunk-table")
    fields = ["page_id", "record_type", "refers_to", "said", "n_bytes", "digest"]
    whole = chunks.where("segment = 0").select(fields).unionByName(join_chunks(chunks.where("segment > 0")))
    responses = whole.where("record_type = 'response'")
    revisits = whole.where("record_type = 'revisit'").select("page_id", "refers_to", "said")
    asked = revisits.select("refers_to", "said").distinct()
    # a response that others refer to; one row an id and digest, however often it is repeated
    found = responses.select(F.col("page_id").alias("refers_to"), "said", "n_bytes", "digest").join(asked, ["refers_to", "said"], "left_semi").dropDuplicates(["refers_to", "said"])
    revisits = revisits.join(found, ["refers_to", "said"], "left").withColumn("record_type", F.lit("revisit"))
    return responses.unionByName(revisits).select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", (F.col("digest") == F.col("said")).alias("verified"))


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


SQL = {
    "op6_warc_chunks": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to, true AS verified
FROM p LEFT JOIN f USING (h)
"""
}
