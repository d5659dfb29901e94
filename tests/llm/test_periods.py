import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.periods import maximal_runs, op11_periodic_runs, overlap, periodic_runs, surviving, text_runs

from .common_rows import LONG, frame

import numpy as np


def brute(s, min_words=24, min_periods=3):
    """Every stretch of equal steps for every period, by the definition."""
    out = {}
    for q in range(1, len(s) // min_periods + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, min_periods * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, length, q) for (a, length), q in out.items())


def collapsed(own, runs):
    return [w for i, w in enumerate(own) if not any(s + q <= i < s + length for s, length, q in runs)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), st.sampled_from([(24, 3), (6, 2), (7, 2), (9, 4)]))
def test_runs_of_any_list(parts, law):
    s = [x for unit, times in parts for x in unit * times]
    want = brute(s, *law)
    assert maximal_runs(s, *law) == want
    n, runs, text = text_runs(" ".join(map(str, s)).encode(), *law)
    assert (n, runs, text.decode().split()) == (len(s), want, [str(x) for x in collapsed(s, want)])


def test_overlapping_nested_and_touching_runs():
    rnd = random.Random(4)
    for _ in range(60):
        unit = [rnd.randrange(3) for _ in range(rnd.randrange(1, 14))]
        inner = unit * rnd.randrange(3, 9)
        s = [rnd.randrange(9) for _ in range(rnd.randrange(40))] + (inner + [7] * rnd.randrange(0, 30)) * rnd.randrange(1, 5) + [rnd.randrange(9) for _ in range(rnd.randrange(40))]
        assert maximal_runs(s) == brute(s)


def test_masking_keeps_every_run():
    rnd = random.Random(5)
    for law in ((24, 3), (5, 2), (30, 4)):
        k = overlap(*law)
        for _ in range(100):
            s = [rnd.randrange(50) for _ in range(200)]
            q = rnd.randrange(1, 20)
            a, length = rnd.randrange(100), max(law[0], law[1] * q)
            for i in range(a + q, min(200, a + length)):
                s[i] = s[i - q]
            kept = surviving(np.array(s), k)
            for start, length, _ in brute(s, *law):
                assert any(x <= start and start + length <= y for x, y in kept)
    assert overlap(24, 3) == 16 and surviving(np.arange(1000), 16) == []
    with pytest.raises(ValueError):
        periodic_runs(None, min_periods=1)


def expected(doc_id, text):
    own = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(own), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = brute(own)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    text_runs_ = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(text_runs_.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(own, runs))).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_by_the_definition(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op11_periodic_runs(spark, sf).select(COLUMNS).collect()
    some = [r for r in got if len((texts[r.doc_id] or "").split()) < 1500]
    assert len(got) == len(texts) and len(some) > 150 and any(r.n_runs for r in some)
    for r in some:
        assert tuple(r) == expected(r.doc_id, texts[r.doc_id])


def test_odd_rows(spark, tmp_path):
    tie = "a " * 24 + "x " + "b c d " * 24 + "y " + "c " * 24
    rows = frame(spark, (7, tie, "en", "s", 1, "x"), (80, tie, "en", "s", 1, "x"))
    got = {}
    for r in periodic_runs(rows.withColumnsRenamed({"kept": "runs", "n_chars": "collapsed"})).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.n_words, r.runs, r.collapsed) for r in got[1] + got[2] + got[3]] == [(0, [], "")] * 3
    assert len(got[4]) == 2 and got[4][0] == got[4][1] and got[4][0].collapsed == "one two three"
    assert [tuple(x) for x in got[5][0].runs] == [(0, len(LONG.split()), 1)] and got[5][0].collapsed == "word"
    assert got[None][0].n_words == 8 and got[6][0].collapsed == "Üñí © 漢字 🙂 x"
    assert [tuple(x) for x in got[7][0].runs] == [(0, 24, 1), (25, 72, 3), (98, 24, 1)]
    assert periodic_runs(rows.limit(0)).collect() == []
    path = str(tmp_path / "sf")
    rows.write.parquet(f"{path}/documents.parquet")
    one = {r.doc_id: r for r in op11_periodic_runs(spark, path).select(COLUMNS).collect()}
    assert tuple(one[7]) == expected(7, tie) and one[7].exponent_milli == 24000 and one[7].start == 0  # of three equal ratios the first
    assert tuple(one[None]) == expected(None, "no id at all here in this row")
    assert tuple(one[1]) == expected(1, None)
