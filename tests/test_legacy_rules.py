"""The older path's blocks, variants, weights, results and formats against plain rules."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import digest, legacy, legacy_report, report, sv, synteny
from tagloom.operators.enzymes import MarginEnzyme
from tagloom.sources import sketch

MARGINS = MarginEnzyme("Own", "GAC", "TRG", 4, 24, 9, 6)


def plain_ranges(points, strand, tolerance):
    """All pairs of matches looked at, as the rule says."""
    n = len(points)
    place = lambda p: (p[0], p[1] if strand == "+" else -p[1])
    size, before = [1] * n, [None] * n
    for i in range(n):
        for j in range(i):
            (qi, ri), (qj, rj) = place(points[i]), place(points[j])
            if qi > qj and abs((qi - qj) - (ri - rj)) <= tolerance and size[j] + 1 > size[i]:
                size[i], before[i] = size[j] + 1, j
    taken, out = set(), []
    for i in sorted(range(n), key=lambda k: (-size[k], k)):
        path = []
        while i is not None and i not in taken:
            path.append(i)
            i = before[i]
        if len(path) > 1:
            taken.update(path)
            out.append((path[-1], path[0]))
    return sorted(out + [(k, k) for k in range(n) if k not in taken])


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for strand in "+-":
        for c in range(3):
            for _ in range(60):
                q = rng.randrange(0, 4000, 50)
                r = (q if strand == "+" else 5000 - q) + rng.choice([0, 10, -10, 400, 900])
                rows.append(("a", "b", "BcgI", c, q, 0, r, rng.randrange(3), 0, strand))
    m = spark.createDataFrame(rows, legacy.MATCH + ", orient string")
    got = synteny.chained_blocks(m, tolerance=100).collect()
    sizes = {}
    for strand in "+-":
        for c in range(3):
            mine = sorted((r[4], r[6], r[7]) for r in rows if r[3] == c and r[9] == strand)
            want = plain_ranges([p[:2] for p in mine], strand, 100)
            have = sorted((b.block, b.n_tags, b.q_start, b.q_end, b.r_start, b.r_end, round(b.block_ani, 9)) for b in got if b.q_contig == c and b.orient == strand)
            full = lambda a, b: (b - a + 1, mine[a][0], mine[b][0], min(p[1] for p in mine[a : b + 1]), max(p[1] for p in mine[a : b + 1]))
            assert [h[1:6] for h in have] == [full(a, b) for a, b in want]
            sizes[c, strand] = sorted(max((b for b in want if b[0] <= k <= b[1]))[1] - max((b for b in want if b[0] <= k <= b[1]))[0] + 1 for k in range(len(mine)))
    for (c, strand), want in sizes.items():
        assert sorted(r.n_tags for r in synteny.block_sizes(m, 100).where(f"q_contig = {c} and orient = '{strand}'").collect()) == want
    assert synteny.chained_blocks(m.limit(0)).count() == 0 and synteny.block_sizes(m.limit(0)).count() == 0


def blocks(spark, rows):
    return spark.createDataFrame([("a", "b", 0, 0, o, k, 5, qs, qe, rs, re, 1.0) for k, (o, qs, qe, rs, re) in enumerate(rows)], "query string, reference string, q_contig long, r_contig long, orient string, block long, n_tags long, q_start long, q_end long, r_start long, r_end long, block_ani double")


def test_rearrangements(spark):
    b = blocks(spark, [("+", 0, 1000, 0, 1000), ("-", 2000, 3000, 2000, 3000), ("-", 4000, 5000, 203_001, 204_000), ("-", 6000, 7000, 304_000, 305_000)])
    got = sorted(map(tuple, synteny.rearrangements(b).select("sv_type", "q_start", "q_end", "r_start", "r_end", "size", "confidence").collect()))
    assert got == [("inversion", 1000, 2000, 1000, 2000, 3000, 0.85), ("translocation", 3000, 4000, 3000, 203_001, 200_001, 0.7)]
    assert synteny.rearrangements(b.limit(1)).count() == 0


def test_clusters_of_unmatched_tags(spark):
    schema = "genome_id string, contig_id long, enzyme string, position long, tag string"
    t = spark.createDataFrame([("a", 0, "BcgI", p, "x") for p in (0, 1000, 2001, 9000, 9500)] + [("b", 0, "BcgI", 70, "x")], schema)
    m = spark.createDataFrame([("a", "b", "BcgI", 0, 9500, 0, 70, 0, 0)], legacy.MATCH)
    pairs = spark.createDataFrame([("a", "b")], "query string, reference string")
    got = synteny.variants(t, pairs, m, synteny.chained_blocks(m)).collect()
    assert sorted((v.sv_type, v.q_start, v.q_end, v.r_start, v.size, v.confidence) for v in got) == [("insertion", 0, 1000, 0, 64, 0.6), ("insertion", 2001, 2001, 0, 32, 0.6), ("insertion", 9000, 9000, 0, 32, 0.6)]
    back = synteny.variants(t, pairs, m.limit(0), synteny.chained_blocks(m.limit(0))).where("sv_type = 'deletion'").collect()
    assert [(v.q_start, v.r_start, v.r_end, v.size) for v in back] == [(0, 70, 70, 32)]


def test_signed_gaps(spark):
    m = spark.createDataFrame([("a", "b", "BcgI", 0, q, 0, r, 0, 99) for q, r in ((0, 50), (100, 250), (300, 10))], legacy.MATCH)
    assert [r.gap_diff for r in synteny.signed_gaps(m).orderBy("q_pos").collect()] == [0, -100, 200]


def test_a_candidate_elsewhere_comes_last(spark):
    anchors = [("q", "r", "BcgI", 0, 0, 0, 0, "+", 0, True), ("q", "r", "BcgI", 0, 100, 1, 0, "+", 0, True), ("q", "r", "BcgI", 0, 100, 0, 900, "+", 0, True)]
    a = spark.createDataFrame(anchors, "query string, reference string, enzyme string, q_contig long, q_pos long, r_contig long, r_pos long, orient string, mm int, uniq boolean")
    assert {(r.q_pos, r.r_contig, r.r_pos) for r in legacy.match_tags(a).collect()} == {(0, 0, 0), (100, 0, 900)}


@pytest.fixture(scope="module")
def compared(spark):
    tag = "genome_id string, contig_id long, enzyme string, position long, tag string"
    t = spark.createDataFrame([(g, 0, "BcgI", 100 * k, "x") for g, n in (("a", 20), ("b", 25), ("c", 3)) for k in range(n)], tag)
    m = spark.createDataFrame([("a", "b", "BcgI", 0, 100 * k, 0, 100 * k, k % 2, 0) for k in range(16)] + [("a", "c", "BcgI", 0, 0, 0, 0, 0, 0)], legacy.MATCH)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "query string, reference string")
    return t, m, pairs


def test_summary(spark, compared):
    t, m, pairs = compared
    rows = {(r.query, r.reference): r for r in legacy_report.summary(m, t, pairs).collect()}
    assert len(rows) == 3
    ab = rows["a", "b"]
    assert (ab.af_query, ab.af_reference, ab.shared_tags) == (0.8, 0.64, 16)
    assert abs(ab.raw_ani - (1 - 0.5 / 32)) < 1e-12 and abs(ab.weighted_ani - ab.raw_ani) < 1e-12
    assert abs(ab.mash_ani - (1 + math.log(16 / math.sqrt(500)) / 32)) < 1e-12 and ab.ani == ab.mash_ani
    assert abs(ab.confidence - (1 - math.exp(-0.16)) * 0.8) < 1e-12 and not ab.below_detection
    plain = legacy_report.summary(m, t, pairs, mash=False).where("reference = 'b'").first().ani
    assert abs(plain - (100 * ab.raw_ani + 0.02 * (100 - 100 * ab.raw_ani) * 0.36) / 100) < 1e-12
    for key, af in ((("a", "c"), 1 / 20), (("b", "c"), 0.0)):
        r = rows[key]
        assert (r.ani, r.raw_ani, r.confidence, r.shared_tags, r.below_detection) == (0, 0, 0, 0, True) and abs(r.af_query - af) < 1e-12
    assert legacy_report.summary(m, t, pairs.limit(0)).count() == 0


def test_formats(spark, compared, tmp_path):
    t, m, pairs = compared
    s, b = legacy_report.summary(m, t, pairs), synteny.chained_blocks(m)
    v = synteny.variants(t, pairs, m, b)
    short, long = legacy_report.tsv_rows(s, v), legacy_report.tsv_rows(s, v, b)
    assert tuple(short.columns) == legacy_report.TSV and tuple(long.columns) == legacy_report.EXTENDED_TSV
    r = long.where("ref_name = 'b'").first()
    assert (r.af_q, r.af_r, r.shared_tags, r.sv_count, r.rearrangements, r.indels, r.synteny_blocks) == ("0.8000", "0.6400", 16, 2, 0, 2, 1)
    out = {(x.query, x.reference): json.loads(x.json) for x in legacy_report.nested_json(s, b, v).collect()}
    ab = out["a", "b"]
    assert list(ab) == ["query", "reference", "ani", "af_query", "af_reference", "weighted_ani", "confidence", "shared_tags", "synteny_blocks", "structural_variations"]
    assert ab["synteny_blocks"][0]["matched_tags"] == 16 and {x["sv_type"] for x in ab["structural_variations"]} == {"Insertion", "Deletion"}
    assert out["b", "c"]["synteny_blocks"] == []
    lengths = spark.createDataFrame([("a", 0, 2000), ("b", 0, 2500)], "genome_id string, contig_id long, length long")
    assert legacy_report.paf_lines(b, lengths).where("reference = 'b'").first().line.split("\t") == ["a", "2000", "0", "1500", "+", "b", "2500", "0", "1500", "16", "1500", "60"]
    lines = [x.line.split("\t") for x in legacy_report.variant_paf_lines(v.where("reference = 'b' and sv_type = 'insertion'")).collect()]
    assert lines == [["query", "0", "1600", "1900", "+", "ref", "0", "0", "0", "0", "128", "0", "Insertion", "128"]]
    legacy_report.write_lines(legacy_report.variant_paf_lines(v).coalesce(1), legacy_report.VARIANT_PAF, str(tmp_path / "paf"))
    text = spark.read.text(str(tmp_path / "paf")).collect()
    assert text[0][0] == "\t".join(legacy_report.VARIANT_PAF) and len(text) == 1 + v.count()


def plain_margin_tags(seq):
    turn = str.maketrans("ACGT", "TGCA")
    out = {}
    if seq is None or len(seq) < 24:
        return out
    s = seq.upper()
    for i in range(len(s) - 9):
        w = s[i : i + 10]
        for strand, hit, lead, tail in (("+", w[:3] == "GAC" and w[7] == "T" and w[8] in "AG" and w[9] == "G", 9, 6), ("-", w[0] == "C" and w[1] in "CT" and w[2] == "A" and w[7:] == "GTC", 6, 9)):
            a, b = max(i - lead, 0), i + 10 + tail
            if hit and b <= len(s) and set(s[a:b]) <= set("ACGT") and i not in out:
                out[i] = (strand, s[a:b] if strand == "+" else s[a:b].translate(turn)[::-1])
    return out


def test_margin_digest(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTacgt" if k % 2 else "ACGT") for _ in range(6000)) for k in range(4)]
    seqs += ["GAC" + "A" * 4 + "TAG" + "C" * 14, "GACAAAATAGCCCCC", "", None, "A" * 9 + "GACAANATAG" + "C" * 20, "CCAAAAAGTC" + "G" * 20]
    c = spark.createDataFrame([("g", k, s) for k, s in enumerate(seqs)], "genome_id string, contig_id long, seq string")
    got = {(r.contig_id, r.position): (r.strand, r.tag) for r in digest.margin_digest(c, [MARGINS]).collect()}
    want = {(k, i): v for k, s in enumerate(seqs) for i, v in plain_margin_tags(s).items()}
    assert got == want and (4, 0) in want and {v[0] for v in want.values()} == {"+", "-"}
    assert digest.margin_digest(c.limit(0), [MARGINS]).count() == 0


def test_tree_model_from_json(spark, tmp_path):
    nodes = [{"type": "split", "feature": 0, "feature_name": "raw_ani", "threshold": 0.9, "left": 1, "right": 2}, {"type": "leaf", "value": -0.5}, {"type": "leaf", "value": 0.25}]
    model = {"meta": {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.1, "init_value": 0.01, "feature_names": ["raw_ani"]}, "trees": [{"nodes": nodes}]}
    path = tmp_path / "model.json"
    path.write_text(json.dumps(model, indent=1))
    got = report.read_trees(spark, str(path))
    assert got == model
    d = spark.createDataFrame([(k, x, 0.5, 0.6, 10, 0.9, 0.95, 0.4) for k, x in enumerate((0.9, 0.95, 0.995))], "id int, raw_ani double, af_query double, af_reference double, shared_tags long, mash_ani double, chained_kmer_ani double, containment double")
    raw = [r.prediction for r in report.predict_model(d, got).orderBy("id").collect()]
    assert all(abs(a - b) < 1e-12 for a, b in zip(raw, [-0.04, 0.035, 0.035]))
    for version in report.RUNTIME:
        p = [r.prediction for r in report.predict_runtime(d, got, version).orderBy("id").collect()]
        want = raw if version == "v2" else [0.86, 0.985, 1.0]
        assert all(abs(a - b) < 1e-12 for a, b in zip(p, want)), version
    model["trees"][0]["nodes"][1]["type"] = "other"
    path.write_text(json.dumps(model))
    with pytest.raises(ValueError):
        report.read_trees(spark, str(path))


def test_one_enzyme_sketch(spark):
    d = spark.createDataFrame([(7, 0b11100100, 0), (9, -1, 1)], "position long, bits long, direction int")
    got = sorted(map(tuple, sketch.one_enzyme_tags(d, "BcgI", "g").collect()))
    assert got == [("g", 0, "BcgI", 7, "ACGT" + "A" * 28, "+"), ("g", 0, "BcgI", 9, "T" * 32, "-")]


def test_variants_in_order(spark):
    rows = [("a", "b", "deletion", 0, q, q + n, 0, 0, 0, 5, 1, 1) for q, n in ((500, 9), (20, 7), (20, 3))] + [("a", "a", "insertion", 3, 1, 1, 0, 0, 0, 5, 1, 1)]
    d = spark.createDataFrame(rows, "query string, reference string, sv_type string, q_contig long, q_start long, q_end long, r_contig long, r_start long, r_end long, size long, support_left long, support_right long")
    assert [(r.q_contig, r.q_start, r.q_end) for r in sv.ordered(d).collect()] == [(3, 1, 1), (0, 20, 23), (0, 20, 27), (0, 500, 509)]


def test_kmers_of_blocks(spark):
    """Both strands, other letters, ends beyond the contig, spans of no more than k bases, shared and repeated k-mers."""
    rng = np.random.default_rng(6)
    a = "".join(rng.choice(list("ACGT"), 20_000))
    b = a[:9_000] + "N" + a[9_001:15_000][::-1].translate(str.maketrans("ACGT", "TGCA")) + a[:3_000]
    contigs = spark.createDataFrame([("a", 1, a, len(a)), ("b", 2, b, len(b)), ("b", 3, "ACGT" * 3, 12)], "genome_id string, contig_id long, seq string, length long")
    blocks = [("a", "b", 0, 1, 100, 8_900, 2, 90, 9_100, 5), ("a", "b", 1, 1, 9_500, 99_999, 2, 8_000, 99_999, 2), ("a", "b", 2, 1, 10, 24, 2, 0, 500, 9), ("a", "b", 3, 1, 0, 400, 3, 0, 100, 9), ("a", "b", 4, 1, 0, 2_000, 2, 15_000, 17_500, 0)]
    spans = spark.createDataFrame(blocks, "query string, reference string, block long, q_contig long, q_start long, q_end long, r_contig long, r_start long, r_end long, n_tags long")
    k = 15
    turn = str.maketrans("ACGT", "TGCA")

    def own(seq, lo, end):
        w = seq[lo : min(end + 1, len(seq))]
        if len(w) <= k:
            return set()
        return {min(x, x[::-1].translate(turn)) for x in (w[i : i + k] for i in range(len(w) - k + 1)) if "N" not in x}

    seqs = {1: a, 2: b, 3: "ACGT" * 3}
    want, top, weight = {}, 0.0, 0
    for _, _, block, qc, q0, q1, rc, r0, r1, n in blocks:
        q, r = own(seqs[qc], q0, q1), own(seqs[rc], r0, r1)
        if q or r:
            want[block] = (len(q), len(r), len(q & r))
        if q and r:
            top += max(n, 1) * max(0.0, 1 + math.log(max(len(q & r) / min(len(q), len(r)), 1e-9)) / k)
            weight += max(n, 1)
    ids = ["query", "reference", "block"]
    assert {r.block: (r.n_query, r.n_reference, r.shared) for r in legacy.block_kmers(spans, contigs, ids).collect()} == want
    assert math.isclose(legacy.block_kmer_identity(spans, contigs, ids).first().kmer_ani, top / weight)
    assert legacy.block_kmer_identity(spans.limit(0), contigs, ids).count() == 0


def test_copies_are_stepped_over_once():
    """Greedy matches are those of all candidates in turn, and thousands of copies of one tag cost no product of them."""
    import time

    from tagloom.operators import legacy

    def plain(key, places):
        used, out, last = set(), [], None
        for (qc, qp, enzyme), candidates in places:
            best = None
            for differs, mm, (rc, rp, e) in candidates:
                if (rc, rp, e) not in used:
                    lead = 0 if not last else abs((rp - last[3]) - (qp - last[1])) if last[0] == qc and last[2] == rc else legacy.ELSEWHERE
                    best = min(best or (2,), (differs, mm, lead, (rc, rp, e)))
            if best:
                rc, rp, e = best[3]
                used.add(best[3])
                out.append((*key, enzyme, qc, qp, rc, rp, best[1], best[2] if last and last[0] == qc and last[2] == rc else 0, e))
                last = (qc, qp, rc, rp)
        return out

    for seed in range(300):
        r = random.Random(seed)
        lists = [[(r.randrange(3), r.randrange(12), r.choice("ab")) for _ in range(r.randrange(1, 9))] for _ in range(5)]
        at = sorted({(r.randrange(3), r.randrange(12), r.choice("ab")) for _ in range(r.randrange(1, 25))})
        near = {q: [(int(mm > 0), mm, k) for k, mm in ((r.randrange(5), r.randrange(3)) for _ in range(r.randrange(1, 4)))] for q in at}
        used: set = set()
        places = [legacy._Places(x, used) for x in lists]
        got = legacy._greedy(("x", "y"), used, ((q, [(d, m, places[k]) for d, m, k in near[q]]) for q in at))
        assert got == plain(("x", "y"), ((q, [(d, m, p) for d, m, k in near[q] for p in lists[k]]) for q in at))
    used = set()
    one = legacy._Places([(k, 5, "a") for k in range(20_000)], used)
    began = time.time()
    assert len(legacy._greedy(("x", "y"), used, (((k, 5, "a"), [(0, 0, one)]) for k in range(20_000)))) == 20_000
    assert time.time() - began < 5


def test_short_and_long_spans_count_alike(spark, monkeypatch):
    """Blocks cut out whole, by bins of places, or some of either: the same k-mers, also where a contig has two rows."""
    rng = np.random.default_rng(8)
    a = "".join(rng.choice(list("ACGT"), 3_000))
    b = a[:700] + "é" + a[500:2_900]
    contigs = spark.createDataFrame([("a", 1, a, len(a)), ("b", 2, b, len(b)), ("b", 2, a[:900], 900)], "genome_id string, contig_id long, seq string, length long")
    blocks = [("a", "b", k, 1, s, s + n, 2, s // 2, s // 2 + n) for k, (s, n) in enumerate([(0, 40), (100, 14), (300, 900), (650, 100), (2_900, 5_000)])]
    spans = spark.createDataFrame(blocks, "query string, reference string, block long, q_contig long, q_start long, q_end long, r_contig long, r_start long, r_end long")
    found = []
    for bound in (1 << 15, 200, 0):
        monkeypatch.setattr(legacy, "SHORT_SPAN", bound)
        found.append(sorted(map(tuple, legacy.block_kmers(spans, contigs, ["query", "reference", "block"]).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 4
