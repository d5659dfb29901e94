"""The older path keeps tags that occur more often than the newer one takes."""

import math
import random

from pyspark.sql import functions as F

from tagloom.operators import legacy
from tagloom.queries import QUERIES


def table(spark, path, copies=8):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60_000))
    rows = [(k, text, "en", f"src{k % 2}", len(text)) for k in range(2 * copies)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_copies_within_a_source_match(spark, tmp_path):
    sf = table(spark, tmp_path)
    tags = QUERIES["digest_tags"](spark, sf)
    n = tags.count() // 16
    assert n > 0 and tags.where("genome_id = 'src0'").count() == 8 * n
    m = QUERIES["legacy_matches"](spark, sf).collect()
    assert len(m) == 8 * n and {r.mm for r in m} == {0}
    assert len({(r.q_contig, r.q_pos) for r in m}) == len({(r.r_contig, r.r_pos) for r in m}) == len(m)
    assert QUERIES["unmatched_tags"](spark, sf).where("genome_id = 'src0'").count() == 0
    assert QUERIES["contig_mash"](spark, sf).where(F.col("n") >= n).count() == 8
    assert QUERIES["legacy_ani"](spark, sf).first().raw_ani == 100.0


def plain_matches(q, r, tolerance=2):
    """All tags of two genomes, each in turn against every free one: (contig, pos, enzyme, tag) lists in order."""
    used, out, last = set(), [], None
    for qc, qp, qe, qt in q:
        best = None
        for k, (rc, rp, _, rt) in enumerate(r):
            n = min(len(qt), len(rt))
            mm = sum(a != b for a, b in zip(qt[:n], rt[:n]))
            if k in used or mm > tolerance:
                continue
            lead = 0 if last is None else abs((rp - last[3]) - (qp - last[1])) if (last[0], last[2]) == (qc, rc) else math.inf
            found = (qt.ljust(32, "A") != rt.ljust(32, "A"), mm, lead, k)
            best = found if best is None else min(best, found)
        if best:
            rc, rp, re_, _ = r[best[3]]
            out.append((qe, qc, qp, rc, rp, best[1], re_))
            used.add(best[3])
            last = (qc, qp, rc, rp)
    return out


def test_matches_are_those_of_all_tags_in_turn(spark, sf):
    """Across enzymes and lengths: a tag of 27 bases may match the beginning of one of 32."""
    t = QUERIES["digest_tags"](spark, sf)
    names = [r.genome_id for r in t.select("genome_id").distinct().orderBy("genome_id").limit(6).collect()]
    rows = [tuple(r) for r in t.where(F.col("genome_id").isin(names)).select("genome_id", "contig_id", "position", "enzyme", "tag").collect()]
    # copies, near copies, and prefixes under another enzyme
    rnd = random.Random(7)
    for k, (g, c, p, e, tag) in enumerate(rows[:60]):
        near = "".join(rnd.choice("ACGT") if rnd.random() < 0.04 else x for x in tag)
        rows.append((names[k % 6], 9000 + k % 3, p + k, "AloI" if len(tag) == 32 else e, near[:27] if len(tag) == 32 else near))
    df = spark.createDataFrame(rows, "genome_id string, contig_id long, position long, enzyme string, tag string").distinct()
    pairs = [(a, b) for a in names for b in names if a < b]
    got = {}
    for m in legacy.match_all(df, spark.createDataFrame(pairs, "query string, reference string")).collect():
        got.setdefault((m["query"], m.reference), []).append((m.enzyme, m.q_contig, m.q_pos, m.r_contig, m.r_pos, m.mm, m.r_enzyme))
    side = lambda n: sorted((c, p, e, x) for g, c, p, e, x in set(rows) if g == n)
    across = 0
    for a, b in pairs:
        want = plain_matches(side(a), side(b))
        assert sorted(got.get((a, b), [])) == sorted(want)
        across += sum(x[0] != x[6] for x in want)
    assert across > 0


def test_matches_weigh_by_themselves(spark):
    rows = [("a", "b", "BcgI", 0, 0, 0, 0, 0, 0), ("a", "b", "BcgI", 0, 100, 0, 100, 2, 0), ("a", "b", "AloI", 0, 90_000, 0, 500_000, 1, -4)]
    m = spark.createDataFrame(rows, legacy.MATCH)
    ani = [100.0, 100 * (1 - 2 / 32), 100 * (1 - 1 / 27)]
    weights = {"uniform": [1, 1, 1], "synteny": [2**0.5, 2**0.5, 1], "position": [1, 1 + math.sin(100 / 101), 1 + math.sin(90_000 / 90_001)], "gap": [1, 1, 0.8]}
    for scheme, w in weights.items():
        got = legacy.weighted_pairs(m, scheme).first()
        assert got.n_tags == 3 and abs(got.raw_ani - sum(ani) / 3) < 1e-9
        assert abs(got.weighted_ani - sum(x * y for x, y in zip(ani, w)) / sum(w)) < 1e-9, scheme


def test_unmatched_tags_are_those_of_all_anchors(spark):
    """Found between distinct contents of places: also where two enzymes share a place, and without a genome or contig."""
    from tagloom.operators import anchors as anc
    from tagloom.queries import halves

    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(32)) for _ in range(8)]

    def near(tag):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(32)
            tag = tag[:k] + rng.choice("ACGT") + tag[k + 1 :]
        return tag if rng.random() < 0.7 else tag[::-1].translate(str.maketrans("ACGT", "TGCA"))

    rows = []
    for k in range(160):
        g, at = rng.choice(["a", "b", "c", "d", None]), rng.randrange(30)
        for e in rng.sample(["BcgI", "AlfI"], rng.choice((1, 1, 2))):
            rows.append((g, None if k % 40 == 7 else k % 5, e, at, near(rng.choice(base))))
    t = spark.createDataFrame(rows, "genome_id string, contig_id long, enzyme string, position long, tag string")
    want = legacy.unmatched(t, halves(t, max_occurrence=anc.NO_LIMIT, max_bucket=anc.NO_LIMIT)).collect()
    got = legacy.unmatched_queries(t).collect()
    plain = lambda found: sorted(repr((r.genome_id, r.contig_id, r.enzyme, r.position, r.tag)) for r in found)
    assert plain(got) == plain(want) and 0 < len(got) < len(rows)


def test_best_contigs_by_profiles_are_those_of_all_anchors(spark, monkeypatch):
    """Whatever counts as common: repeated places, two enzymes at a place, either strand, ties, and without a genome or contig."""
    from tagloom.operators import anchors as anc
    from tagloom.queries import halves

    rng = random.Random(6)
    base = ["".join(rng.choice("ACGT") for _ in range(32)) for _ in range(14)]
    base.append("ATGCGCATGCGCATGCGCATGCGCATGCGCAT")

    def near(tag):
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            k = rng.randrange(32)
            tag = tag[:k] + rng.choice("ACGT") + tag[k + 1 :]
        return tag if rng.random() < 0.7 else tag[::-1].translate(str.maketrans("ACGT", "TGCA"))

    rows = []
    for k in range(420):
        g, at = rng.choice(["a", "b", "c", "d", None]), rng.randrange(60)
        for e in rng.sample(["BcgI", "AlfI"], rng.choice((1, 1, 2))):
            rows.append((g, None if k % 40 == 7 else k % 17, e, at, near(base[min(rng.randrange(15), rng.randrange(15))])))
    t = spark.createDataFrame(rows, "genome_id string, contig_id long, enzyme string, position long, tag string")
    want = legacy.contig_mash(halves(t, max_occurrence=anc.NO_LIMIT, max_bucket=anc.NO_LIMIT)).collect()
    plain = lambda found: sorted(repr(tuple(r)) for r in found)
    assert len(want) > 90
    for common in (0, 30, 80, 200, 1000):
        monkeypatch.setattr(legacy, "COMMON", common)
        assert plain(legacy.contig_mash_all(t).collect()) == plain(want), common


def test_best_contigs_of_copies_make_no_row_for_an_anchor(spark, tmp_path, monkeypatch):
    """40 copies of a text in each of two sources: anchors are found between distinct contents alone, and a profile of all is met once."""
    from tagloom.operators import anchors as anc

    found, plain = [], anc.find_anchors

    def seen(*args, **kwargs):
        found.append(plain(*args, **kwargs))
        return found[-1]

    monkeypatch.setattr(anc, "find_anchors", seen)
    monkeypatch.setattr(legacy, "find_anchors", seen)
    sf = table(spark, tmp_path, 40)
    n = QUERIES["digest_tags"](spark, sf).count() // 80
    got = QUERIES["contig_mash"](spark, sf).collect()
    assert len(got) == 40 and {(r.query, r.reference, r.r_contig) for r in got} == {("src0", "src1", 1)} and min(r.n for r in got) >= n
    assert 0 < sum(x.count() for x in found) < 9 * n
