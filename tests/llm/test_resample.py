import hashlib
import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import resample as r
from tagloom.llm.resample import op13_importance_resampling, resample, ring_buckets

from .common_rows import LONG, frame


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(w):
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, items):
    """(id, n_features, weight, score, rank) by the contract, plainly."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(words(text)))
    for text in items:
        t.update(features(words(text)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        f = features(words(text))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    may = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], math.inf if x[0] is None else x[0], x[1], x[2]))
    for k, x in enumerate(may[: 5 * len(may) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b1", "ü漢", "xyz"]), max_size=40), st.integers(1, 9), st.integers(1, 5))
def test_ring_over_blocks(w, block, n):
    before, r.BLOCK = r.BLOCK, block
    try:
        got = Counter(int(b) for x in ring_buckets(" ".join(w).encode(), n, 997) for b in x)
    finally:
        r.BLOCK = before
    assert got == Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 997 for k in range(1, n + 1) for i in range(len(w) - k + 1))


def test_query_by_the_contract(spark, sf):
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op13_importance_resampling(spark, sf).select(COLUMNS).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(docs, items)
    assert sum(x.rank is not None for x in got) > 5


def test_odd_rows(spark):
    many = [(100 + k, f"word{k % 7} and some more of it " * 5, None, None, k, "x") for k in range(150)]
    docs = frame(spark, *many, *[(900, "the very same text here again " * 5, None, None, 1, "x")] * 60, (None, "no id " * 15, None, None, 1, "x")).withColumnsRenamed({"kept": "rank", "n_chars": "weight", "lang": "copy"})
    target = spark.createDataFrame([("one two three", "t"), (None, "t"), ("", "t"), ("word3 AND some more", "t")], "text string, bucket string")
    got = resample(docs, target).select(COLUMNS).collect()
    want = brute([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()], [x.text for x in target.collect()])
    assert sorted((tuple(x) for x in got), key=str) == want
    ranks = sorted(x.rank for x in got if x.rank is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 5 * (1 + 150 + 60 + 1) // 100
    assert next(x for x in got if x.doc_id == 1)[:] and {x.n_features for x in got if x.doc_id in (1, 2, 3)} == {0}
    assert next(x for x in got if x.doc_id == 5).n_features == 3 * len(LONG.split()) - 3
    assert resample(docs.limit(0), target).collect() == []
    none = resample(docs, target.limit(0)).select(COLUMNS).collect()
    assert sorted((tuple(x) for x in none), key=str) == brute([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()], [])
