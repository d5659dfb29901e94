import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import neardup
from tagloom.llm.components import components
from tagloom.llm.neardup import jaccard_components, shingle_sets

from .common_rows import frame, rows


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        r = find(k)
        if sets[k] and d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(docs)), key=str)


def plain(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus(seed, n):
    """Families of copies at all distances, chains of copies of copies, and a passage that half of the texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    docs, texts = [], []
    for k in range(n):
        if texts and rng.random() < 0.6:
            t = list(rng.choice(texts[-40:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                if t:
                    t[rng.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 120]))]
            if rng.random() < 0.5:
                t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        texts.append(t)
        docs.append((k, " ".join(t)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,group,frequent,hot,rows_", [(1, 64, 500_000, 8, 20_000), (2, 2, 50, 1, 5), (3, 5, 0, 8, 20_000), (4, 3, 500_000, 2, 20_000)])
def test_equals_all_pairs(spark, monkeypatch, seed, group, frequent, hot, rows_):
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "TOKEN_ROWS", rows_)
    monkeypatch.setattr(neardup, "ASKERS", rows_)
    docs = corpus(seed, 260)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert plain(jaccard_components(df)) == brute(docs)


def test_without_a_start(spark, monkeypatch):
    """The exact search alone finds every link."""
    monkeypatch.setattr(neardup, "ASKED", 1)
    monkeypatch.setattr(neardup, "LOCAL", 2)
    docs = corpus(9, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert plain(jaccard_components(df, 60)) == brute(docs, 60)


def test_hot_group(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(400):
        t = list(base)
        if k % 3:
            t[rng.randrange(60)] = f"x{k}"
        docs.append((k, " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r.component_id for r in jaccard_components(df).collect()} == {0}


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in rows()]
    assert plain(jaccard_components(frame(spark))) == brute(docs)
    assert jaccard_components(frame(spark).limit(0)).count() == 0
    assert plain(jaccard_components(frame(spark).where("doc_id <= 3"))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_sets():
    texts = ["A b c d e f", "a B", "", None, "a a a a a a a", "e d c b a", "\ta\x0bb\n"]
    at, tokens = shingle_sets(pa.array(texts))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    assert tokens[at[1]] == tokens[at[6]]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)] + [(500, 500 + k) for k in range(50)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
