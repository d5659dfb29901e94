import random

import pytest

from tagloom.llm import lines
from tagloom.llm.lines import dedup_lines, dedup_runs, units

from .common_rows import frame, rows
from .test_lines import plain


def brute(docs):
    """A unit goes if any run of two units and MIN_WORDS words that holds it stands before, without overlap."""
    at = {}
    cut = [units(t or "") for _, t in docs]

    def runs(own, tails):
        for a in range(len(own)):
            for b in range(a + 2, len(own) + 1):
                if sum(len(u.split()) for u in own[a:b]) >= lines.MIN_WORDS:
                    yield a, b, "".join(u + t for u, t in zip(own[a : b - 1], tails[a : b - 1])) + own[b - 1]

    key = lambda d: (d is None, d or 0)
    for (d, _), x in zip(docs, cut):
        for _, _, body in runs(*x):
            at[body] = min(at.get(body, key(d)), key(d))
    out = []
    for (d, t), (own, tails) in zip(docs, cut):
        gone, here = set(), {}
        for a, b, body in sorted(runs(own, tails), key=lambda r: r[0]):
            if at[body] < key(d) or here.setdefault(body, b) <= a:
                gone |= set(range(a, b))
        rest, line = [], None
        for k, (u, tail) in enumerate(zip(own, [*tails[:-1], "\n"])):
            if k not in gone:
                line = (line or "") + u + (tail if tail != "\n" else "")
            if tail == "\n":
                rest += [line] if line is not None else []
                line = None
        out.append((d, t if not gone else "\n".join(rest), 0 if t is None else t.count("\n") + 1, len(gone)))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(n))


@pytest.mark.parametrize("size", [3, 4, 5, 6])
def test_a_passage_of_few_lines_stays_once(spark, size):
    """50 words and more on 3 to 6 lines, and as 3 to 6 sentences in mid-paragraph, in three documents each."""
    rng, docs, planted = random.Random(size), [], []
    for k in range(20):
        passage = [words(rng, 60 // size) + "." for _ in range(size)]
        inline = k % 2
        planted.append((" " if inline else "\n").join(passage))
        for copy in range(3):
            around = [words(rng, rng.randrange(5, 12)) + "." for _ in range(40)]
            text = around[:20] + passage + around[20:]
            docs.append((3 * k + copy, (" " if inline else "\n").join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    texts = {d: t for d, t, *_ in plain(dedup_runs(df))}
    for k, p in enumerate(planted):
        assert p in texts[3 * k]
        for copy in (1, 2):
            rest = texts[3 * k + copy]
            assert not any(s in rest for s in p.replace("\n", " ").split(". "))
            assert len(rest.split()) == len(docs[3 * k + copy][1].split()) - len(p.split())
    if size == 3:  # the chunks of the other query leave most of these
        assert sum(p in t for p in planted for _, t, *_ in plain(dedup_lines(df))) > 20


def test_equals_brute_force(spark):
    rng = random.Random(7)
    pool = [words(rng, n) for n in (0, 1, 1, 2, 3, 4, 5, 9)]
    long_ = [". ".join(words(rng, rng.randrange(1, 30)) for _ in range(6)) + rng.choice([".", ". "]) for _ in range(3)]
    long_ += [x + long_[0] for x in ("Before it. ", "no end here ")] + [long_[1] + " After it."]
    docs = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.8 else rng.choice(long_) for _ in range(rng.randrange(14)))) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = plain(dedup_runs(df))
    assert got == brute(docs) and 0 < sum(r[3] for r in got)


def test_odd_rows(spark):
    twice = "\n".join(f"line number {k} of a text" for k in range(8))
    more = [(20, twice, "en", "s", 1, "x"), (21, twice, "en", "s", 1, "x"), (None, twice, "en", "s", 1, "x"), (22, twice + "\n" + twice, "en", "s", 1, "x"), (23, "a\n" * 60, "en", "s", 1, "x"), (24, "b\n" * 7 + "b", "en", "s", 1, "x")]
    odd = [r for r in rows(*more) if r[0] != 5]
    df = spark.createDataFrame(odd, frame(spark).schema)
    assert plain(dedup_runs(df)) == brute([(r[0], r[1]) for r in odd])
    assert dedup_runs(frame(spark).limit(0)).count() == 0
    assert {r.kept for r in dedup_runs(df, row=["kept"]).select("row.kept").collect()} == {"x"}
