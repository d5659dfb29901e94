import random
import re
import warnings

import pytest

from tagloom.operators import anchors, digest, enzymes, screen


def site(e, k=0, fill="A"):
    w = [fill] * e.tag_len
    for at, b in e.patterns[k]:
        w[at] = b[0]
    return "".join(w)


def tags(spark, *seqs, panel=None):
    rows = [("g", k, s) for k, s in enumerate(seqs)]
    return digest.digest(spark.createDataFrame(rows, "genome_id string, contig_id long, seq string"), panel).collect()


def test_registry():
    assert len(enzymes.REGISTRY) == 16 and sum(len(e.patterns) for e in enzymes.REGISTRY.values()) == 29
    assert enzymes.get("bcgi").name == "BcgI" and enzymes.get("EcoRI") is None
    assert enzymes.get("BcgI").recognition == "CGA-N6-TGC"
    g = {e.name: (e.exact_site, e.d2, e.d3, e.body_len) for e in enzymes.REGISTRY.values()}
    assert g["BcgI"] == (6, 0, 0, 26) and g["BaeI"] == (6, 1, 0, 21) and g["HaeIV"] == (4, 2, 0, 21) and g["Hin4I"] == (4, 1, 1, 21)
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert [e.name for e in enzymes.resolve("CspCI,AlfI")] == ["AlfI"] and w
    with pytest.raises(ValueError):
        enzymes.resolve("Nope")


def test_goldens(spark):
    bcg = "A" * 10 + "CGA" + "A" * 6 + "TGC" + "A" * 10
    assert [(t.position, t.tag, t.enzyme) for t in tags(spark, bcg)] == [(0, bcg, "BcgI")]
    assert not tags(spark, bcg[:-1] + "N") and not tags(spark, "", "AT" * 100, None)
    assert [t.position for t in tags(spark, "A" * 990 + bcg + "A" * 3978)] == [990]
    assert tags(spark, bcg.lower())[0].tag == bcg


def test_degenerate_places(spark):
    for name in ("BaeI", "HaeIV", "Hin4I"):
        e = enzymes.get(name)
        for k, p in enumerate(e.patterns):
            w = site(e, k)
            assert any(t.position == 0 for t in tags(spark, w, panel=[e]))
            for at, allowed in p:
                for b in "ACGT":
                    hit = any(t.position == 0 for t in tags(spark, w[:at] + b + w[at + 1 :], panel=[e]))
                    if b in allowed:
                        assert hit


def brute(s, e):
    out = set()
    for p in e.patterns:
        rx = ["[ACGT]"] * e.tag_len
        for at, b in p:
            rx[at] = f"[{b}]"
        out |= {m.start() for m in re.finditer(f"(?={''.join(rx)})", s)}
    return out


def test_equals_lookahead_patterns(spark):
    rng = random.Random(7)
    s = "".join(rng.choice("ACGT" * 10 + "N") for _ in range(40_000))
    s += "GAGGAGAG" * 50
    got = {}
    for t in tags(spark, s, panel=enzymes.usable()):
        got.setdefault(t.enzyme, set()).add(t.position)
        assert t.tag == s[t.position : t.position + len(t.tag)]
    for e in enzymes.usable():
        assert got.get(e.name, set()) == brute(s, e), e.name


def test_screen_gate(spark):
    rows = spark.createDataFrame([(3, 1000, "pass"), (300, 10000, "pass"), (2, 10000, "fail"), (10, 100000, "fail"), (2, 100, "fail"), (100, 0, "fail")], "s long, t long, want string")
    from pyspark.sql import functions as F

    assert rows.where(screen.gate(F.col("s"), F.col("t")) != F.col("want")).count() == 0
    r = spark.createDataFrame([(86, 1000), (5, 0)], "s long, t long").select(screen.approx_ani(F.col("s"), F.col("t"), 11).alias("a")).collect()
    assert abs(r[0].a - 0.80) < 0.01 and r[1].a == 0


def test_anchors_equal_brute_force(spark):
    rng = random.Random(3)
    panel = enzymes.resolve("BcgI,AloI")
    rows = []
    for e in panel:
        base = ["".join(rng.choice("ACGT") for _ in range(e.tag_len)) for _ in range(30)]
        for g in ("a", "b"):
            for k, t in enumerate(base):
                t = list(t)
                for _ in range(rng.randrange(4)):
                    t[rng.randrange(len(t))] = rng.choice("ACGT")
                t = "".join(t)
                if rng.random() < 0.3:
                    t = t[::-1].translate(str.maketrans("ACGT", "TGCA"))
                rows.append((g, 0, e.name, 1000 * k + len(t), t))
    df = spark.createDataFrame(rows, digest.TAGS)
    pairs = spark.createDataFrame([("a", "b")], "query string, reference string")
    got = {(r.q_pos, r.r_pos, r.orient, r.mm) for r in anchors.find_anchors(df, df, pairs, panel).collect()}
    want = set()
    flip = str.maketrans("ACGT", "TGCA")
    for g, _, e, p, t in rows:
        for h, _, f, q, u in rows:
            if (g, h) == ("a", "b") and e == f:
                for o, v in (("+", u), ("-", u[::-1].translate(flip))):
                    if (m := sum(x != y for x, y in zip(t, v))) <= 2:
                        want.add((p, q, o, m))
    assert got == want and got


def test_scans_are_cut(spark, monkeypatch):
    """A batch of any size is scanned in slices, with the same tags and k-mers."""
    import pyarrow as pa

    from tagloom.operators import digest as dig

    seqs = ["ACGT" * 10, None, "", "ACCA" * 30, "GGT" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(["g"] * 5), pa.array(range(5), pa.int64()), pa.array(seqs)], ["genome_id", "contig_id", "seq"])
    cut = list(dig._slices(iter([batch]), 45))
    assert [x.column(1).to_pylist() for x in cut] == [[0, 1, 2], [3], [4]]
    c = spark.createDataFrame([("g", k, s) for k, s in enumerate(seqs)], "genome_id string, contig_id long, seq string").coalesce(1)
    got = [sorted(map(tuple, dig.kmers(c, 9, places=p).collect())) for p in (False, True)]
    assert got[0] == sorted({x[:3] for x in got[1]})
