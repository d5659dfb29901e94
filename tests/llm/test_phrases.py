import random
import re

from pyspark.sql import functions as F

from tagloom.llm import phrases
from tagloom.llm.phrases import find_phrases

from .common_rows import frame, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            for s in range(max(1, len(v) - n + 1) if v else 0):
                g = v[s : s + n]
                for k in range(len(w) - len(g) + 1):
                    if w[k : k + len(g)] == g:
                        hit |= set(range(k, k + len(g)))
                        found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in df.collect()), key=str)


ITEMS = [(1, "one TWO, three"), (2, None), (3, ""), (4, "--- !!"), (5, "a b c d e f g h i j k l"), (6, "word"), (7, "one two three"), (7, "漢字"), (None, "x")]


def test_odd_rows(spark):
    more = [(10, "z a b c d e f g h i j k l z", "en", "s", 1, "x"), (11, "b c d e f g h i j k", "en", "s", 1, "x"), (12, "a b c d e f g h i", "en", "s", 1, "x"), (13, "A-B c/d e.f g_h i\nj", "en", "s", 1, "x")]
    items = spark.createDataFrame([(i, t, "q") for i, t in ITEMS], "item_id long, text string, items string")
    docs = frame(spark, *more)
    short = [(r[0], r[1]) for r in rows(*more) if r[0] != 5]
    known = [(i, t) for i, t in ITEMS if i is not None]
    assert plain(find_phrases(docs.where("doc_id is null or doc_id <> 5"), items)) == brute(short, known)
    long_ = find_phrases(docs.where("doc_id = 5"), items).first()
    assert (long_.n_words, long_.n_hit, long_.items) == (60_000, 60_000, ["6"])
    assert find_phrases(docs.limit(0), items).count() == 0
    assert all(r.n_hit == 0 for r in find_phrases(docs, items.limit(0)).collect())
    kept = find_phrases(docs, items, row=["doc_id", "kept"]).select("row.kept").collect()
    assert len(kept) == len(rows(*more)) and {r.kept for r in kept} == {"x"}


def test_blocks_and_random_texts(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs, items = [(k, text(rng.randrange(60))) for k in range(80)], [(k, text(rng.randrange(1, 9))) for k in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 4)
    assert plain(find_phrases(d, b, 4)) == want
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 15)
    assert plain(find_phrases(d, b, 4)) == want


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x a b q c d"), (2, "a b c d"), (3, "d c b a x x x x"), (4, "a q q q b c d")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "a b c d")], "item_id long, text string")
    got = {r.doc_id: (r.items, r.near) for r in find_phrases(d, b, 4, slop=1).collect()}
    assert got[1] == ([], ["9"]) and got[2][0] == ["9"] and got[3] == ([], []) and got[4] == ([], [])


def brute_near(docs, items, n, slop):
    """Ids of the items with a proximity match and no exact one, by document."""
    exact = {d: set(f) for d, _, _, f in brute(docs, items, n)}
    out = {}
    for d, t in docs:
        w, found = words(t), set()
        for i, x in items:
            v = words(x)
            for s in range(max(1, len(v) - n + 1) if v else 0):
                g = v[s : s + n]
                if any(all(any(w[p] == y for p in range(max(0, k + o - slop), min(len(w), k + o + slop + 1))) for o, y in enumerate(g)) for k in range(-slop, len(w) + slop)):
                    found.add(str(i))
        out[d] = sorted(found - exact[d])
    return out


def test_proximity_equals_brute_force(spark, monkeypatch):
    rng = random.Random(16)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    docs, items = [(k, text(rng.randrange(40))) for k in range(60)], [(k, text(rng.randrange(1, 9))) for k in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for block, starts in ((2_000_000, 1_000_000), (15, 7)):
        monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
        monkeypatch.setattr(phrases, "STARTS", starts)
        for slop in (1, 2):
            got = find_phrases(d, b, 4, slop=slop)
            assert {r.doc_id: list(r.near) for r in got.collect()} == brute_near(docs, items, 4, slop)
            assert plain(got) == brute(docs, items, 4)


def test_many_windows_cost_little_more():
    """Windows are reached by their rarest term: 100 times as many cost less than 3 times the time."""
    import time

    import pyarrow as pa

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(20_000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array([text(500) for _ in range(400)])], ["doc_id", "hash", "text"])
    index = list(phrases._index(iter([batch])))
    took = []
    for n in (1_000, 100_000):
        block = phrases.Windows([(str(k), text(10)) for k in range(n)], 10)
        began = time.time()
        list(phrases._ask(block, 0)(iter(index)))
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 0.5


def test_row_groups_of_the_index_hold_few_slices(spark):
    """Ten slices of one task: writers and readers never hold them all at once."""
    import pyarrow.parquet as pq

    docs = spark.range(10).coalesce(1).select(F.col("id").alias("doc_id"), F.expr("repeat('ab cd ', 700000)").alias("text"))
    index = phrases.build_index(docs)
    sizes = []
    for path in index.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        sizes += [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
    assert sum(sizes) == 10 and max(sizes) <= phrases.GROUP_ROWS
