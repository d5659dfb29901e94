import gzip
import hashlib
from glob import glob

from tagloom.llm.warc import join_chunks, op6_warc_chunks, read_archives, read_chunks, records, write_archives

BIG = "é" * 5000 + "\r\n\r\nWARC/1.1\r\n" + "x" * 3001
ROWS = [(1, "u", "a" * 200), (2, "u", "a" * 200), (3, None, "short"), (4, "u\r\nX: y", "short"), (5, "u", None), (6, "u", ""), (7, "u", BIG), (8, "u", BIG), (None, "u", "a" * 200), (None, "u", "b" * 150), (1, "u", "a" * 200), (9, "u", "b" * 150), (10, "u", "c" * 100), (7, "u", BIG)]


def want(rows):
    first, out = {}, []
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        later = len(b) >= 100 and i is not None and i > first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if later else "response", first[b] if later else None, True))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "q") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    for k, chunk in enumerate((64, 1000, 1 << 16)):
        path = f"{tmp_path}/{k}"
        write_archives(pages, path, chunk=chunk, per_file=5)
        assert sorted((tuple(r) for r in read_archives(spark, path, chunk).collect()), key=str) == want(ROWS)
        assert max((r.n_bytes for r in read_chunks(spark, path, chunk).collect())) <= chunk
        # chunks smaller than those written, and whole files by another reader
        assert sorted((tuple(r) for r in read_archives(spark, path, 50).collect()), key=str) == want(ROWS)
        for f in glob(f"{path}/*.gz"):
            raw = gzip.open(f).read()
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
            assert len(list(records(raw, chunk))) == len(list(records(open(f, "rb").read(), chunk)))
    assert join_chunks(read_chunks(spark, f"{tmp_path}/0", 64).where("segment > 0")).count() > 0


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(pages, f"{tmp_path}/none")
    assert read_archives(spark, f"{tmp_path}/none").count() == 0


def test_members_and_plain_files():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = one.replace(b":4>", b":5>")
    assert [r["page_id"] for r in records(gzip.compress(one) + gzip.compress(two))] == [4, 5]
    assert [r["digest"] for r in records(one + two)] == [hashlib.sha256(b"abc").hexdigest()] * 2


def test_query(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op6_warc_chunks(spark, sf).collect()), key=str) == want(rows)
