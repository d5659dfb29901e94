import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import anchors as anc
from tagloom.operators import chain, intervals, report, sv
from tagloom.operators import digest as dig
from tagloom.operators.chain import Config
from tagloom.plans import commands
from tests import pair_program

L = 400_000
FLIP = str.maketrans("ACGT", "TGCA")


def genome(rng, n=L):
    return np.array(list("ACGT"))[rng.integers(0, 4, n)]


def mutate(rng, g, rate):
    out = g.copy()
    at = rng.choice(len(g), int(rate * len(g)), replace=False)
    out[at] = np.array(list("ACGT"))[[("ACGT".index(x) + k) % 4 for x, k in zip(g[at], rng.integers(1, 4, len(at)))]]
    return out


def contigs(spark, genomes):
    rows = [(name, k, s, len(s)) for name, parts in genomes.items() for k, s in enumerate(parts)]
    return spark.createDataFrame(rows, "genome_id string, contig_id long, seq string, length long")


@pytest.fixture(scope="module")
def ladder(spark):
    rng = np.random.default_rng(11)
    base = genome(rng)
    parts = {"base": ["".join(base)]}
    for a in (90, 95, 98, 99.5):
        parts[f"m{a}"] = ["".join(mutate(rng, base, 1 - a / 100))]
    text = "".join(base)
    parts["rc"] = [text[::-1].translate(FLIP)]
    inverted = text[:150_000] + text[150_000:250_000][::-1].translate(FLIP) + text[250_000:]
    parts["inv"] = [inverted]
    parts["del"] = [text[:100_000] + text[112_000:]]
    cuts = [0, 5000, 60_000, 63_000, 200_000, 204_500, L]
    parts["frag"] = [("".join(mutate(rng, base, 0.02)))[a:b] for a, b in zip(cuts, cuts[1:])]
    parts["other"] = ["".join(genome(rng))]
    g = commands.Genomes.from_contigs(contigs(spark, parts))
    g.tags = g.tags.cache()
    pairs = spark.createDataFrame([("base", n) for n in parts], "query string, reference string")
    found = commands.results(g, g, pairs)
    return {r.reference: r for r in found.pairs.collect()}, g, found


def test_ladder(ladder):
    rows = ladder[0]
    for a in (95, 98, 99.5):
        assert abs(100 * rows[f"m{a}"].ani_uniform - a) < 0.35 and rows[f"m{a}"].af_query > 0.9
    assert abs(100 * rows["m90"].ani_uniform - 90) < 1.0
    assert rows["base"].ani_gated > 0.99999 and rows["base"].af_query > 0.95 and rows["base"].synteny_blocks == 1


def test_strand_and_fragments(ladder):
    rows, _, found = ladder
    assert rows["rc"].ani_gated > 0.99999 and {c.orient for c in found.chains.where("reference = 'rc'").collect()} == {"-"}
    assert abs(100 * rows["frag"].ani_uniform - 98) < 0.5


def test_unrelated(ladder):
    r = ladder[0]["other"]
    assert r.below_detection and r.unreliable and math.isnan(r.ani_gated) and r.n_chains == 0 and 0.5 <= r.ani_upper95 < 0.9


def test_variants(spark, ladder):
    g = ladder[1]
    pairs = spark.createDataFrame([("base", "inv"), ("base", "del")], "query string, reference string")
    calls = commands.struct(g, g, pairs=pairs).collect()
    inv = [c for c in calls if c.reference == "inv" and c.sv_type == "inversion"]
    assert len(inv) == 1 and abs(inv[0].q_start - 150_000) < 6000 and abs(inv[0].q_end - 250_000) < 6000
    gone = [c for c in calls if c.reference == "del" and c.sv_type == "insertion"]
    assert len(gone) == 1 and abs(gone[0].size - 12_000) < 100
    only = commands.struct(g, g, pairs=pairs, rearrangement=True).collect()
    assert {c.sv_type for c in only} <= {"inversion", "translocation"}


def test_plans(spark, ladder):
    g = ladder[1]
    t = commands.triangle(g)
    rows = {(r.query, r.reference): r for r in t.collect()}
    assert ("base", "m99.5") in rows and not any("other" in k for k in rows)
    names = sorted({x for k in rows for x in k})
    m = {r.genome: r for r in report.matrix(t, names).collect()}
    assert all(m[n][n] == 100.0 for n in names) and m["base"]["m98"] == m["m98"]["base"]
    q = commands.Genomes(g.contigs.where("genome_id = 'base'"), g.tags.where("genome_id = 'base'"))
    hits = commands.search(q, g, min_ani=0.9).orderBy("hit").collect()
    assert [h.ani_gated for h in hits] == sorted((h.ani_gated for h in hits), reverse=True) and len(hits) >= 6
    assert commands.dist(q, g, min_ani=0.97).count() < len(hits)
    assert commands.ani(q, g, calibrate=True, verbose=True).count() == 10


def test_chaining_rules():
    q = np.concatenate((np.arange(10) * 1000, 40_000 + np.arange(10) * 1000))
    rank = np.concatenate((np.arange(10), 30 + np.arange(10)))
    assert len(chain.best_chains(q, q, rank, math.inf, Config())) == 1
    assert len(chain.best_chains(q, q, rank, 5, Config())) == 2
    far = q + np.where(np.arange(20) >= 10, 40_000, 0)
    assert max(len(c) for c in chain.best_chains(q, far, np.arange(20), math.inf, Config())) >= 10
    assert chain.best_chains(np.arange(3), np.arange(3), np.arange(3), math.inf, Config()) == []


def test_equal_predecessors():
    """Two places before the last are as good (both begin a chain, with the same shift); the farther one is taken."""
    q, r = np.array([0, 200, 5_000, 6_000]), np.array([300, 100, 5_100, 6_100])
    cfg = Config(min_chain_anchors=2)
    best = chain.best_chains(q, r, np.arange(4), math.inf, cfg)
    assert best[0].tolist() == [0, 2, 3]


def test_spans_and_gaps(spark):
    c = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 5, 20), (1, 0, 30, 40), (2, 1, 0, 100), (2, 2, 0, 100), (2, 3, 0, 100)], "k int, contig int, start long, end long")
    assert {(r.k, r.bp) for r in intervals.covered(c, ["k", "contig"]).groupBy("k").agg(F.sum("covered_bp").alias("bp")).collect()} == {(1, 30), (2, 300)}
    e = spark.createDataFrame([(1000, 2000, 300, 5000), (100, 4900, 300, 5000), (20_000, 30_000, 50_000, 0)], "a long, b long, by long, n long")
    assert [tuple(r) for r in e.select(*intervals.extend_span(F.col("a"), F.col("b"), F.col("by"), F.col("n"))).collect()] == [(700, 2300), (0, 5000), (10_000, 40_000)]
    df = spark.createDataFrame([([100, 200, 400], [1000, 1100, 1300])], "q array<long>, r array<long>")
    out = df.select(*[intervals.interpolate(F.lit(x), F.col("q"), F.col("r")).alias(str(x)) for x in (50, 150, 500)], intervals.upper_median_gap(F.col("q")).alias("g")).first()
    assert (out["50"], out["150"], out["500"], out.g) == (1000, 1050, 1300, 200)
    p = spark.createDataFrame([(1, 0), (1, 900), (1, 2000), (2, 5)], "k int, at long")
    assert {(r.k, r.cluster, r.size) for r in intervals.gap_clusters(p, ["k"], "at").collect()} == {(1, 0, 2), (1, 1, 1), (2, 0, 1)}
    b = intervals.band_join(p, p.withColumnRenamed("at", "to"), ["k"], "at", "to", 1000).collect()
    assert {(r.k, r.at, r.to) for r in b} == {(1, 0, 0), (1, 0, 900), (1, 900, 0), (1, 900, 900), (1, 2000, 2000), (2, 5, 5)}


def table(spark, rows):
    return spark.createDataFrame([("q", "r", k, c[0], c[1], c[2], min(x for x, _ in c[3]), max(x for x, _ in c[3]), min(y for _, y in c[3]), max(y for _, y in c[3]), len(c[3]), [{"q_pos": x, "r_pos": y} for x, y in c[3]]) for k, c in enumerate(rows)], "query string, reference string, chain_id int, q_contig long, r_contig long, orient string, q_start long, q_end long, r_start long, r_end long, n_anchors long, anchors array<struct<q_pos:long,r_pos:long>>")


def test_variant_rules(spark):
    run = lambda a, b, n, s=1: [(a + 1000 * k, b + s * 1000 * k) for k in range(n)]
    calls = lambda *c: sv.detect(table(spark, c)).collect()
    inv = calls((0, 0, "+", run(0, 0, 10)), (0, 0, "-", run(10_000, 15_000, 6, -1)))
    assert [(c.sv_type, c.q_start, c.q_end, c.support_left, c.support_right) for c in inv] == [("inversion", 10_000, 15_000, 10, 0)]
    dele = calls((0, 0, "+", run(0, 0, 5) + run(5000, 45_000, 5)))
    assert [(c.sv_type, c.size, c.support_left, c.support_right) for c in dele] == [("deletion", 40_000, 5, 5)]
    assert calls((0, 0, "+", [(0, 0), (1400, 1000)])) == []
    gap = calls((0, 0, "+", run(0, 0, 5)), (0, 0, "+", run(30_000, 5000, 5)))
    assert [(c.sv_type, c.size) for c in gap] == [("insertion", 25_000)]
    moved = calls((0, 0, "+", run(0, 0, 5)), (0, 1, "+", run(6000, 0, 5)))
    assert [(c.sv_type, c.r_contig, c.size) for c in moved] == [("translocation", 1, 2000)]
    blocked = calls((0, 0, "+", run(0, 0, 5)), (0, 0, "+", run(6000, 50_000, 5)), (0, 0, "+", run(20_000, 20_000, 5)))
    assert not any(c.sv_type == "deletion" and c.q_start == 4000 for c in blocked)


def test_synteny(spark):
    c = table(spark, [(0, 0, "+", [(k, k) for k in range(10)]), (0, 0, "-", [(20 + k, 30 - k) for k in range(5)]), (0, 0, "+", [(40 + k, 40 + k) for k in range(5)])])
    a = spark.createDataFrame([("q", "r", 0, k) for k in range(25)], "query string, reference string, q_contig long, q_pos long")
    r = intervals.synteny(c, a).first()
    assert (r.synteny_blocks, r.breakpoint_count, r.unconserved, r.max_block_anchors) == (3, 2, 24 - 17, 10) and abs(r.synteny_score - 17 / 19) < 1e-9


def test_calibration_checks():
    with pytest.raises(ValueError):
        report.load_calibration('{"feature_names": ["a"], "means": [], "scales": [1], "coefficients": [1], "imputer_medians": [0], "intercept": 0}')


def test_plan_equals_the_programme_of_a_pair(spark):
    """Fragments on both strands, an inversion, a replaced block (second pass), repeats and a foreign genome: every number of every pair."""
    rng = np.random.default_rng(23)
    base = genome(rng, 120_000)
    text = "".join(base)
    other = "".join(mutate(rng, base, 0.03))
    cuts = np.sort(rng.choice(120_000, 45, replace=False)).tolist()
    frag = [other[a:b] if k % 3 else other[a:b][::-1].translate(FLIP) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 120_000]))]
    swapped = "".join(mutate(rng, base, 0.01))
    swapped = swapped[:50_000] + "".join(genome(rng, 25_000)) + swapped[75_000:100_000][::-1].translate(FLIP) + swapped[100_000:]
    far = "".join(mutate(rng, base, 0.12))
    parts = {"a": [text[:60_000], text[60_000:]], "frag": frag, "swap": [swapped], "far": [far[:30_000], far[30_000:90_000], far[90_000:]], "alien": ["".join(genome(rng, 30_000))], "twice": [text[:20_000] + text[:20_000]], "none": ["ACGT" * 10]}
    g = commands.Genomes.from_contigs(contigs(spark, parts))
    g.tags = g.tags.cache()
    names = list(parts)
    pairs = [("a", n) for n in names] + [("frag", n) for n in names] + [("far", "swap"), ("swap", "a"), ("swap", "frag"), ("twice", "a"), ("none", "a")]
    for cfg in (Config(), Config(rescue=False), Config(adaptive_gap=False)):
        found = commands.results(g, g, spark.createDataFrame(pairs, "query string, reference string"), cfg)
        got = {(r.query, r.reference): r for r in found.pairs.collect()}
        strata, chains = {}, {}
        for r in found.strata.collect():
            strata.setdefault((r.query, r.reference), []).append((r.enzyme, r.tag_len, list(r.hist), r.n_miss))
        for r in found.chains.collect():
            chains.setdefault((r.query, r.reference), []).append((r.chain_id, r.q_contig, r.r_contig, r.orient, r.q_start, r.q_end, r.r_start, r.r_end, [tuple(x) for x in r.anchors]))
        assert set(got) == set(pairs)
        for (a, b), want in programme(spark, g, pairs, cfg).items():
            row = got[a, b]
            assert sorted(strata.get((a, b), [])) == [(s["enzyme"], s["tag_len"], s["hist"], s["n_miss"]) for s in want.pop("strata")], (a, b)
            assert sorted(chains.get((a, b), [])) == [(c["chain_id"], c["q_contig"], c["r_contig"], c["orient"], c["q_start"], c["q_end"], c["r_start"], c["r_end"], [(x["q_pos"], x["r_pos"]) for x in c["anchors"]]) for c in want.pop("chains")], (a, b)
            fits = want.pop("per_enzyme")
            assert [(x.enzyme, x.n_tags) for x in row.per_enzyme] == [(x["enzyme"], x["n_tags"]) for x in fits]
            for name, value in want.items():
                x = row[name]
                assert x == value or (x != x and value != value) or (isinstance(value, float) and math.isclose(x, value, rel_tol=2e-3 if name in ("std_err", "enzyme_chi2") else 1e-5, abs_tol=1e-7)), (a, b, name, x, value)
    assert any(len(c) > 3 for c in chains.values())


def programme(spark, g, pairs, cfg):
    """The plain programme's result of each pair."""
    tags = dig.rank_tags(dig.with_occurrences(g.tags), g.panel).join(g.contigs.select("genome_id", "contig_id", F.col("length").alias("contig_len")), ["genome_id", "contig_id"]).toPandas().rename(columns={"contig_id": "contig", "tag_rank": "rank"})
    size = {r.genome_id: r.n for r in g.contigs.groupBy("genome_id").agg(F.sum("length").alias("n")).collect()}
    anchors = anc.find_anchors(g.tags, g.tags, spark.createDataFrame(pairs, "query string, reference string"), g.panel).toPandas()
    side = lambda n: tags[tags.genome_id == n].assign(genome_len=size[n]).sort_values(["contig", "rank"])
    out = {}
    for a, b in pairs:
        own = anchors[(anchors["query"] == a) & (anchors["reference"] == b)].sort_values(["q_contig", "q_pos", "r_contig", "r_pos", "orient"])
        pair = pair_program.Pair(side(a), side(b), own, g.panel, cfg)
        pair.q_total, pair.r_total = size[a], size[b]
        out[a, b] = pair.result()
    return out
