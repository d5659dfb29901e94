"""The first pass as a plan over all pairs, against the programme of one pair."""

import numpy as np
from pyspark.sql import functions as F

from tagloom.operators import anchors as anc
from tagloom.operators import chain, fill
from tagloom.operators import digest as dig
from tagloom.operators.enzymes import resolve
from tests import pair_program

ANCHORS = "query string, reference string, enzyme string, q_contig long, q_pos long, r_contig long, r_pos long, orient string, mm int, uniq boolean"
CFG = chain.Config(rescue=False)


def genome(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


def changed(rng, s, share):
    out = np.array(list(s))
    at = rng.random(len(s)) < share
    out[at] = rng.choice(list("ACGT"), at.sum())
    return "".join(out)


def test_runs_cut_at_wide_steps_change_no_chain(spark):
    rng = np.random.default_rng(5)
    rows = set()
    for orient in "+-":
        q = 0
        for _ in range(120):
            q += int(rng.choice([0, 300, 900, 5000, 49_000, 51_000, 90_000], p=[0.1, 0.4, 0.2, 0.1, 0.08, 0.06, 0.06]))
            r = q + int(rng.choice([0, 0, 0, 40, 20_000]))
            rows.add(("a", "b", "BcgI", 1, q, 2, 10_000_000 - r if orient == "-" else r, orient, 0, True))
    want = []
    for orient in "+-":
        g = sorted((x[4], -x[6] if orient == "-" else x[6]) for x in rows if x[7] == orient)
        q, s = (np.array(c) for c in zip(*g))
        want += [(orient, [(int(q[k]), int(abs(s[k]))) for k in p]) for p in chain.best_chains(q, s, np.zeros(len(q), np.int64), np.inf, CFG)]
    got = fill.collinear(spark.createDataFrame(sorted(rows), ANCHORS)).orderBy("chain_id").collect()
    assert len(want) > 4 and sorted((r.orient, [tuple(a) for a in r.anchors]) for r in got) == sorted(want)
    assert [r.chain_id for r in got] == list(range(len(got))) and [r.n_anchors for r in got] == sorted((len(r.anchors) for r in got), reverse=True)


def test_strata_equal_those_of_a_pair(spark):
    rng = np.random.default_rng(11)
    a = genome(rng, 60_000)
    flip = a[20_000:40_000][::-1].translate(str.maketrans("ACGT", "TGCA"))
    b = changed(rng, a[:20_000] + flip + a[40_000:], 0.02)
    rows = [("a", 1, a[:30_000]), ("a", 2, a[30_000:]), ("b", 7, b)]
    contigs = spark.createDataFrame([(g, c, s, len(s)) for g, c, s in rows], "genome_id string, contig_id long, seq string, length long")
    panel = resolve()
    tags = dig.digest(contigs, panel)
    pairs = spark.createDataFrame([("a", "b")], "query string, reference string")
    links = anc.find_anchors(tags, tags, pairs, panel)
    chains = fill.collinear(links)
    lengths = contigs.select("genome_id", "contig_id", "length")
    got = {r.enzyme: ([r.m0, r.m1, r.m2], r.n_miss) for r in fill.filled(fill.claimed(chains, tags), tags).collect()}

    def side(name):
        t = dig.rank_tags(dig.with_occurrences(tags), panel).where(F.col("genome_id") == name).toPandas().rename(columns={"contig_id": "contig", "tag_rank": "rank"})
        size = {(g, c): len(s) for g, c, s in rows}
        return t.assign(contig_len=[size[name, c] for c in t.contig], genome_len=60_000).sort_values(["contig", "rank"])

    pair = pair_program.Pair(side("a"), side("b"), links.toPandas(), panel, CFG)
    found = pair.chains(np.inf)
    strata, q_spans, r_spans = pair.fill(found, np.inf)
    assert len(found) >= 3 and {c.orient for c in found} == {"+", "-"}
    assert got == {s.enzyme: (list(s.hist), s.miss) for s in strata} and sum(h[1] for h, _ in got.values()) > 0
    spans = fill.spanned(chains, lengths, lengths).orderBy("chain_id").collect()
    assert [(s.q_contig, s.q_start, s.q_end) for s in spans] == q_spans and [(s.r_contig, s.r_start, s.r_end) for s in spans] == r_spans


def test_scaffold_of_blocks(spark):
    rows = [("a", 3, 5), ("a", 1, 2), ("a", 200_000, 7), ("b", 1, 4), (None, 1, 9), ("b", None, 9), ("a", 70_000, 0)]
    c = spark.createDataFrame(rows, "genome_id string, contig_id long, length long")
    got = {(r.genome_id, r.contig_id): r.offset for r in fill.scaffold(c).collect()}
    assert got == {("a", 1): 0, ("a", 3): 2, ("a", 70_000): 7, ("a", 200_000): 7, ("b", 1): 0}


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], ANCHORS)
    chains = fill.collinear(none)
    tags = spark.createDataFrame([], "genome_id string, contig_id long, enzyme string, position long, tag string")
    lengths = spark.createDataFrame([], "genome_id string, contig_id long, length long")
    assert fill.spanned(chains, lengths, lengths).count() == 0
    assert fill.filled(fill.claimed(chains, tags), tags).count() == 0
    few = spark.createDataFrame([("a", "b", "BcgI", 1, k, 1, k, "+", 0, True) for k in range(3)], ANCHORS)
    assert fill.collinear(few).count() == 0


def test_chains_of_many_runs_take_no_object_an_anchor(monkeypatch):
    """A task's chains leave as they come, and a batch of runs costs some bytes an anchor beside its columns."""
    import tracemalloc

    import pyarrow as pa

    n, runs = 50, 400
    at = np.tile(np.arange(n) * 100, runs)
    a = pa.ListArray.from_arrays(pa.array(np.arange(0, n * runs + 1, n), pa.int32()), pa.StructArray.from_arrays([pa.array(at), pa.array(at - 10_000), pa.array(at // 100 * 2)], ["q_pos", "s", "rank"]))
    text = lambda x: pa.array([x] * runs)
    batch = pa.RecordBatch.from_arrays([text("a"), text("b"), pa.array(range(runs), pa.int64()), pa.array(range(runs), pa.int64()), text("-"), pa.array([np.inf] * runs), a], [*fill.GROUP, "max_skip", "a"])
    monkeypatch.setattr(fill, "HELD", 5000)
    got, most = [], 0
    tracemalloc.start()
    for out in fill.chained(iter([batch]), CFG):
        got += [(out.column(2)[0].as_py(), out.num_rows)]
        assert out.column(5).to_pylist() == [1] * out.num_rows
        assert [len(x) for x in out.column(6)] == [n] * out.num_rows and out.column(6)[0].as_py()[1] == {"q_pos": 100, "r_pos": 9900}
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert len(got) == 4 and sum(k for _, k in got) == runs and [i for i, _ in got] == [0, 101, 202, 303]
    assert most < 100 * n * runs
