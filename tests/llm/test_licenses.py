import random
from collections import Counter

from tagloom.llm.licenses import COVERAGE, TEMPLATES, _common, find_licenses, op5_patience_licenses, patience, scan, template_words


def test_alignment_is_increasing_and_true():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(20))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(20))]
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:]))
        assert len(got) <= len(_common(a, b))
    a = list(range(50))
    assert patience(a, a) == [(k, k) for k in range(50)]


def test_anchors_survive_insertions():
    t = template_words(TEMPLATES["MIT-text"])
    noisy = [x for k, w in enumerate(t) for x in ([w, "zzz"] if k % 9 == 0 else [w])]
    ((coverage, matched, first, last),) = scan(["a", "b", *noisy, "c"], t)
    assert coverage == 1 and matched == len(t) and (first, last) == (2, 2 + len(noisy) - 0 - (0 if noisy[-1] == t[-1] else 1))


def brute(text):
    """Exact notices of the short templates: every place whose words are the template's in a row."""
    w, out = template_words(text or ""), Counter()
    for name in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "All-rights-reserved"):
        t = template_words(TEMPLATES[name])
        for k in range(len(w) - len(t) + 1):
            out[name] += w[k : k + len(t)] == t
    return +out


def test_query_finds_every_exact_notice(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_patience_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    n = 0
    for r in rows:
        want = brute(texts[r.doc_id])
        places = [p.rsplit(":", 2) for p in r.places.split(",") if p]
        got = Counter(p[0] for p in places)
        w = template_words(texts[r.doc_id] or "")
        for name, k in want.items():
            t = template_words(TEMPLATES[name])
            assert got[name] >= k, (r.doc_id, name)
            assert sum(w[int(a) : int(b)] == t for x, a, b in places if x == name) == k
        n += sum(want.values())
        for name, a, b in places:
            t = Counter(template_words(TEMPLATES[name]))
            have = Counter(w[int(a) : int(b)])
            assert sum(min(x, have[y]) for y, x in t.items()) >= COVERAGE * sum(t.values())
    assert n > 10


def test_odd_rows(spark):
    notice = TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, notice), (3, notice), (None, f"{notice} {notice}\n{notice}"), (4, "x " * 40000 + notice + " y" * 40000), (5, "license " * 5000), (6, "RELEASED under: THE mit-license")]
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, matches string")
    got = sorted(((r.doc_id or 0), [(m.license, m.first, m.last) for m in r.matches]) for r in find_licenses(docs).collect())
    m = lambda a: ("MIT", a, a + 5)
    assert got == [(0, [m(0), m(5), m(10)]), (1, []), (2, []), (3, [m(0)]), (3, [m(0)]), (4, [m(40000)]), (5, []), (6, [m(0)])]
    assert find_licenses(docs.limit(0)).count() == 0
