import random
from collections import defaultdict

from tagloom.llm import lines
from tagloom.llm.lines import cut, dedup_lines

from .common_rows import frame, rows


def body(c):
    return ("" if c[2] else "\n").join(c[1])


def removable(c):
    return len(c[1]) >= 2 and len(body(c).split()) >= lines.MIN_WORDS


def brute(docs):
    """First occurrence by (doc_id, place) stays; rows of one id are one document."""
    first = {}
    for d, t in docs:
        for k, c in enumerate(cut(t or "")):
            if removable(c):
                at = (d is None, d or 0, k)
                first[body(c)] = min(first.get(body(c), at), at)
    out = []
    for d, t in docs:
        chunks = cut(t or "")
        gone = {k for k, c in enumerate(chunks) if removable(c) and first[body(c)] != (d is None, d or 0, k)}
        keep = defaultdict(str)
        for k, c in enumerate(chunks):
            if k not in gone:
                for n, u in zip(c[0], c[1]):
                    keep[n] += u
        out.append((d, t if not gone else "\n".join(keep.values()), 0 if t is None else t.count("\n") + 1, len(gone)))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 9)))
    passage = [line() + " and so it goes" for _ in range(9)]
    long_ = ". ".join(line() for _ in range(30)) + "."
    docs = []
    for k in range(n):
        t = [line() for _ in range(rng.randrange(12))]
        if rng.random() < 0.5:
            t += passage
        if rng.random() < 0.4:
            t += [long_]
        t += [line() for _ in range(rng.randrange(6))]
        if rng.random() < 0.2:
            t += t
        docs.append((k, "\n".join(t)))
    return docs, passage, long_


def test_chunks_tile_and_resynchronise():
    docs, passage, long_ = corpus(1)
    for _, t in docs:
        chunks = cut(t)
        parts = defaultdict(str)
        for n, u, _ in chunks:
            for a, b in zip(n, u):
                parts[a] += b
        assert "\n".join(parts.values()) == t
    one, two = ("\n".join([x, *passage, "the end"]) for x in ("some start", "another start\nof two lines\nor three"))
    assert {body(c) for c in cut(one)} & {body(c) for c in cut(two)}
    whole = [c for c in cut(f"x\n{long_}\ny") if c[2]]
    assert "".join(body(c) for c in whole) == long_ and all(len(c[1]) >= 2 for c in whole)


def test_equals_brute_force(spark):
    docs, passage, long_ = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = plain(dedup_lines(df))
    assert got == brute(docs)
    # a long passage on one line stays once
    assert sum(long_ in (t or "") for _, t, _, _ in got) == 1 < sum(long_ in t for _, t in docs)


def test_odd_rows(spark):
    twice = "\n".join(f"line number {k} of a text" for k in range(8))
    more = [(20, twice, "en", "s", 1, "x"), (21, twice, "en", "s", 1, "x"), (None, twice, "en", "s", 1, "x"), (22, twice + "\n" + twice, "en", "s", 1, "x"), (23, "a\n" * 3000, "en", "s", 1, "x")]
    docs = [(r[0], r[1]) for r in rows(*more)]
    assert plain(dedup_lines(frame(spark, *more))) == brute(docs)
    assert dedup_lines(frame(spark).limit(0)).count() == 0
    assert {r.kept for r in dedup_lines(frame(spark, *more), row=["kept"]).select("row.kept").collect()} == {"x"}
