import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tagloom.llm.packing import Packer, WordTokenizer, op7_packing, pack, tokenizer_path

import pyarrow as pa

ODD = [None, "", " ", "\n\t", "a", "Héllo  WORLD x y", "é ́a", "don't we'll I'M", "<|endoftext|> x<|startoftext|>", "ΑΣ ΣΑΣ ς", "汉字 テスト 한국어", "İstanbul ß ﬁ", "\x00\x1f\x85a​b", "12345 &&& a.b,c", "x" * 5000, "🙂👍🏽 ok"]


def ids_of(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]


def test_words_give_the_ids_of_whole_texts():
    encode = WordTokenizer(tokenizer_path(), most=5)
    plain = [t for t in ODD if not t or "<|" not in t] + ["End. and, x. Y.", "a,. b., ,c .", "Don't, it's. Z,", ".", ",a", "é, ß."]
    for texts in (ODD, plain, plain[::-1]):
        for first, starts, ids in encode(pa.array(texts, pa.string())):
            for k in range(len(starts) - 1):
                assert ids[starts[k] : starts[k + 1]].tolist() == ids_of(texts[first + k]), repr(texts[first + k])


def whole(rows, texts):
    """Every id in one piece, sequences gapless, padding only where a length is no power of two."""
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(own) == set(texts)
    for d, pieces in own.items():
        ids, at = ids_of(texts[d]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_query_is_whole_and_unpadded(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert whole(op7_packing(spark, sf).collect(), texts) == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(ODD)], "doc_id long, text string, length string")
    assert whole(pack(docs).collect(), dict(enumerate(ODD))) == 0
    same = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x")], "doc_id long, text string")
    rows = pack(same).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 6 and sum(r.length for r in rows if r.doc_id is None) == 2
    assert pack(same.limit(0)).count() == 0


def test_placement_minimises_squared_counts():
    rng = np.random.default_rng(5)
    p, levels = Packer(16, 0, 10**9), defaultdict(int)
    for k in range(2000):
        s = int(rng.integers(1, 16))
        costs = {}
        for h in [0, *(h for h, n in levels.items() if n and h + s <= 16)]:
            after = dict(levels)
            if h:
                after[h] -= 1
            if h + s < 16:
                after[h + s] = after.get(h + s, 0) + 1
            costs[h] = sum(n * n for n in after.values())
        p._place((k, 0, np.zeros(s, np.uint32), s))
        now = {h: len(w) for h, w in p.open.items() if w}
        assert sum(n * n for n in now.values()) == min(costs.values())
        levels = defaultdict(int, now)


def test_ten_thousand_open_windows():
    """Remainders over half a window never share one; shorter ones that follow find the best of all levels then."""
    rng = np.random.default_rng(6)
    p = Packer(4096, 0)
    sizes = [*rng.integers(2100, 4001, 10_500).tolist(), *rng.integers(1, 1500, 1500).tolist()]
    count = np.zeros(4097, np.int64)
    for k, s in enumerate(sizes):
        h = np.concatenate(([0], 1 + np.flatnonzero(count[1 : 4097 - s])))
        grown = np.where(h + s < 4096, 2 * count[h + s] + 1, 0)
        left = np.where(h > 0, 1 - 2 * count[h], 0)
        before = int((count**2).sum())
        p.add(k, np.full(s, 49_000, np.uint32))
        count[:] = 0
        for level, windows in p.open.items():
            count[level] = len(windows)
        assert int((count**2).sum()) - before == int((grown + left).min())
        if k == 10_499:
            assert p.n_open == 10_500
    assert all(x[2].dtype == np.uint16 for w in p.open.values() for pieces in w for x in pieces)
    p.flush()
    lengths = defaultdict(int)
    for r in p.out:
        lengths[r[5]] += r[2]
    assert sum(lengths.values()) == sum(sizes) and all(n & (n - 1) == 0 for n in lengths.values())
    assert zlib.crc32(np.full(p.out[0][2], 49_000, "<u4").tobytes()) == p.out[0][3]


def test_flush_bounds_open_windows():
    p = Packer(64, 0, 3)
    for k in range(300):
        p.add(k, np.arange(1 + k * 7 % 63, dtype=np.uint32))
        assert p.n_open <= 3
    p.flush()
    lengths = defaultdict(int)
    for r in p.out:
        lengths[r[5]] += r[2]
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())
    assert sum(lengths.values()) == sum(1 + k * 7 % 63 for k in range(300))
