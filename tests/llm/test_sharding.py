import zlib

from tagloom.llm.sharding import assign_shards, op3_sharding

from .common_rows import frame, rows


def brute(docs, shards):
    sized = sorted(((d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs))
    total, at, out, counts = sum(x[2] for x in sized), 0, [], {}
    for has, d, size, crc in sized:
        s = min(shards - 1, at * shards // total)
        counts[s] = counts.get(s, -1) + 1
        out.append((d if has else None, size, crc, s, counts[s]))
        at += size
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in rows()]
    for shards, ranges in ((40, 256), (3, 2), (1, 4)):
        assert plain(assign_shards(frame(spark), shards, ranges)) == brute(docs, shards)
    assert assign_shards(frame(spark).limit(0)).count() == 0
    assert assign_shards(frame(spark).where("doc_id is null"), 2).count() == 1


def test_ranges_within_ranges(spark):
    """Many rows without an id, many of one id, and rows equal in all three."""
    docs = [(None, "x" * (k % 97)) for k in range(300)] + [(5, f"{k} text") for k in range(300)] + [(5, "same")] * 400 + [(k, "y" * (k % 11)) for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for ranges, rows_a_range in ((8, 10), (3, 1), (2, 50), (256, 100_000)):
        assert plain(assign_shards(df, 7, ranges, rows_a_range)) == brute(docs, 7)


def test_equal_rows_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr("tagloom.llm.sharding.CHUNK", 16)
    docs = [(1, "same")] * 100 + [(None, None)] * 33 + [(2, "z")] * 16
    assert plain(assign_shards(spark.createDataFrame(docs, "doc_id long, text string"), 5, 2, 1)) == brute(docs, 5)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = op3_sharding(spark, sf)
    assert plain(out.select("doc_id", "size", "text_crc32", "shard", "slot")) == brute(docs, 40)
    sizes = {}
    for r in out.collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        assert r.law == "bytes" and r.grown_shard is None
    most = max(len((t or "").encode()) + 16 for _, t in docs)
    assert max(sizes.values()) - sum(sizes.values()) / 40 <= most
