import math
import re
import struct
from collections import Counter

import xxhash

from tagloom.llm.quality import BUCKETS, THRESHOLD, op2_llr_quality, score_documents, trusted


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return w, (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def cells(w, m):
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    le = lambda x: struct.pack("<Q", x)
    pair = [xxhash.xxh64_intdigest(le(b), xxhash.xxh64_intdigest(le(a), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % m for x in h + pair]


def brute(rows, ids, threshold, m):
    """rows: (doc_id, text)"""
    own = {k: cells(brute_base(t)[0], m) for k, (_, t) in enumerate(rows)}
    raw = Counter(c for x in own.values() for c in x)
    good = Counter(c for k, x in own.items() if rows[k][0] in ids for c in x)
    n_raw, n_good = sum(raw.values()) + m, sum(good.values()) + m
    out = []
    for k, (d, t) in enumerate(rows):
        w, base = brute_base(t)
        s = sum(round(math.log((good[c] + 1) / n_good) - math.log((raw[c] + 1) / n_raw), 6) for c in own[k]) / len(own[k]) if own[k] and good else 0.0
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        out.append((d, *base, failed, not failed and s >= threshold, round(s, 9)))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r)[:8] + (round(r.score, 9),) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids = {r.doc_id for r in trusted(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert plain(op2_llr_quality(spark, sf)) == brute(docs, ids, THRESHOLD, BUCKETS)


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b c d e " * 4), (4, "a b c d e " * 4), (None, "one two three four five six seven eight nine ten eleven"), (5, "x\n\nx\n x\ny # $%&\x0bz"), (6, "q " * 30000), (7, "ü " + "é" * 50000 + " 🙂 a"), (8, "a b c d e f"), (9, "a a a a a a")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ODD], "doc_id long, text string, kept int")
    ids = spark.createDataFrame([(4,), (None,), (99,), (6,), (6,)], "doc_id long")
    assert plain(score_documents(docs, ids, -0.5, 64)) == brute(ODD, {4, 6}, -0.5, 64)
    assert plain(score_documents(docs, ids.limit(0), -0.5, 64)) == brute(ODD, set(), -0.5, 64)
    assert score_documents(docs.limit(0), ids).count() == 0
    row = score_documents(docs, ids, row=["doc_id", "kept"]).select("row.*").collect()
    assert len(row) == len(ODD) and all(r.kept == 1 for r in row)


def test_junk_goes_and_clean_stays(spark):
    sf = "/root/testdata/sf0.01"
    out = op2_llr_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in out if r.quality == 1 and not r.toxic]
    junk = [r.kept for r in out if r.quality == 0]
    assert sum(clean) == len(clean)
    assert sum(junk) <= 0.2 * len(junk)
