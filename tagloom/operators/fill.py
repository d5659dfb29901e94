"""Chains of anchors and the tags within their spans, as plans over all pairs at once.

The steps of a comparison: ``compare`` takes them twice, with limits and rescue.
Only the chain programme of a run of anchors is Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import sequence as seq
from tagloom.operators import intervals
from tagloom.operators.chain import Config, best_chains

_BIN = 4096


def scaffold(contigs: DataFrame, block: int = 1 << 16) -> DataFrame:
    """genome_id, contig_id, offset: each genome's contigs end to end by their (integer) id.

    Prefix sums in two steps, blocks of ids first, so that no task holds a large genome's contigs.
    Rows without a genome or an id are left out.
    """
    c = contigs.where("genome_id is not null and contig_id is not null").select("genome_id", "contig_id", F.floor(F.col("contig_id") / block).alias("_block"), "length")
    blocks = c.groupBy("genome_id", "_block").agg(F.sum("length").alias("_bp"))
    blocks = blocks.select("genome_id", "_block", (F.sum("_bp").over(Window.partitionBy("genome_id").orderBy("_block")) - F.col("_bp")).alias("_before"))
    inside = F.sum("length").over(Window.partitionBy("genome_id", "_block").orderBy("contig_id")) - F.col("length")
    return c.withColumn("_inside", inside).join(blocks, ["genome_id", "_block"]).select("genome_id", "contig_id", (F.col("_before") + F.col("_inside")).alias("offset"))


def placed(rows: DataFrame, offsets: DataFrame, genome: str, contig: str, at: str) -> DataFrame:
    """``rows`` with places of the scaffold in ``at``, and 0 for its only contig."""
    o = offsets.select(F.col("genome_id").alias(genome), F.col("contig_id").alias(contig), "offset")
    return rows.join(o, [genome, contig]).withColumn(at, F.col(at) + F.col("offset")).withColumn(contig, F.lit(0).cast("long")).drop("offset")


_FOUND = "query string, reference string, q_contig long, r_contig long, orient string, widest long, anchors array<struct<q_pos:long,r_pos:long>>"
GROUP = ["query", "reference", "q_contig", "r_contig", "orient"]


def numbered(chains: DataFrame) -> DataFrame:
    """The chains of each pair, numbered from the largest; equal ones by their first places."""
    first = F.col("anchors")[0]
    order = Window.partitionBy("query", "reference").orderBy(F.desc("n_anchors"), "q_contig", first["q_pos"], "r_contig", first["r_pos"], "orient")
    return chains.withColumn("chain_id", (F.row_number().over(order) - 1).cast("long")).select("query", "reference", "chain_id", "q_contig", "r_contig", "orient", "n_anchors", "widest", "anchors")


#: Anchors of chains that a task holds before it hands them on.
HELD = 1 << 16


def _found(batch: pa.RecordBatch, chains: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Chains (row of ``batch``, widest, q_pos, r_pos) as rows of ``_FOUND``."""
    of, widest, q, r = zip(*chains)
    rows, ends = pa.array(of, pa.int64()), np.cumsum([0, *map(len, q)]).astype(np.int32)
    steps = pa.StructArray.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(r))], ["q_pos", "r_pos"])
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(5)), pa.array(widest, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), steps)], [*GROUP, "widest", "anchors"])


def chained(batches: Iterator[pa.RecordBatch], cfg: Config = Config()) -> Iterator[pa.RecordBatch]:
    """The chains of runs of anchors (GROUP, max_skip, anchors as q_pos, s, rank), as ``_FOUND``: arrays all through, no object an anchor."""
    for batch in batches:
        skip, runs = batch.column(5).to_numpy(), batch.column(6)
        ends = runs.offsets.to_numpy()
        places = [runs.values.field(k).to_numpy() for k in range(3)]
        found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        held = 0
        for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
            q, s, rank = (x[lo:hi] for x in places)
            for path in best_chains(q, s, rank, skip[i], cfg):
                found.append((i, max(int(np.diff(rank[path]).max(initial=1)) - 1, 0), q[path], np.abs(s[path])))
                held += len(path)
            if held > HELD:
                yield _found(batch, found)
                found, held = [], 0
        if found:
            yield _found(batch, found)


def collinear(anchors: DataFrame, cfg: Config = Config(), limits: DataFrame | None = None) -> DataFrame:
    """The numbered chains of each pair, with the most query tags that a step of a chain skips (``widest``).

    Anchors of one contig pair and strand are cut where a step on the query is wider than
    ``max_gap``: no chain goes across, so each run is a group of its own. A run of too few
    anchors never reaches Python. limits (query, reference, max_skip): the most tags that a step
    may skip, by the anchors' ``q_rank``; pairs without a limit have none.
    """
    w = Window.partitionBy(*GROUP).orderBy("q_pos")
    rank = F.col("q_rank") if "q_rank" in anchors.columns else F.lit(0).cast("long")
    a = anchors.select(*GROUP, "q_pos", "r_pos", rank.alias("rank")).withColumn("_new", (F.col("q_pos") - F.lag("q_pos").over(w) > cfg.max_gap).cast("int"))
    a = a.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    runs = a.groupBy(*GROUP, "_run").agg(F.sort_array(F.collect_list(F.struct("q_pos", F.when(F.col("orient") == "-", -F.col("r_pos")).otherwise(F.col("r_pos")).alias("s"), "rank"))).alias("a"))
    runs = runs.where(F.size("a") >= cfg.min_chain_anchors)
    runs = runs.withColumn("max_skip", F.lit(float("inf"))) if limits is None else runs.join(limits.select("query", "reference", "max_skip"), ["query", "reference"], "left").fillna(float("inf"), ["max_skip"])

    found = runs.select(F.col("query").cast("string"), F.col("reference").cast("string"), F.col("q_contig").cast("long"), F.col("r_contig").cast("long"), "orient", "max_skip", "a").mapInArrow(lambda batches: chained(batches, cfg), _FOUND)
    return numbered(found.withColumn("n_anchors", F.size("anchors").cast("long")))


def spanned(chains: DataFrame, q_lengths: DataFrame, r_lengths: DataFrame) -> DataFrame:
    """Chains with q_start, q_end, r_start, r_end: from first to last anchor, wider by half their median step. lengths: genome_id, contig_id, length."""
    q = q_lengths.select(F.col("genome_id").alias("query"), F.col("contig_id").alias("q_contig"), F.col("length").alias("_q"))
    r = r_lengths.select(F.col("genome_id").alias("reference"), F.col("contig_id").alias("r_contig"), F.col("length").alias("_r"))
    out = chains.join(q, ["query", "q_contig"], "left").join(r, ["reference", "r_contig"], "left").fillna(0, ["_q", "_r"])
    for side in ("q", "r"):
        at = F.col(f"anchors.{side}_pos")
        lo, hi = intervals.extend_span(F.array_min(at), F.array_max(at), F.floor(intervals.upper_median_gap(at) / 2), F.col(f"_{side}"))
        out = out.withColumn(f"{side}_start", lo).withColumn(f"{side}_end", hi)
    return out.select("query", "reference", "chain_id", "q_contig", "r_contig", "orient", "n_anchors", "anchors", "q_start", "q_end", "r_start", "r_end")


def claimed(chains: DataFrame, tags: DataFrame) -> DataFrame:
    """Query tags between the first and last anchor of a chain, each by its pair's largest such chain, with the reference place they map to.

    Steps of a chain are at most ``max_gap`` wide, so the range join is an equi-join
    on the few bins that a step covers. tags: genome_id, contig_id, enzyme, position,
    and what else is to be carried along.
    """
    step = chains.select("query", "reference", "chain_id", "q_contig", "r_contig", "orient", F.explode(F.arrays_zip(F.slice("anchors", 1, F.size("anchors") - 1).alias("a"), F.slice("anchors", 2, F.size("anchors") - 1).alias("b"))).alias("s"))
    step = step.select("query", "reference", "chain_id", "q_contig", "r_contig", "orient", F.col("s.a.q_pos").alias("q0"), F.col("s.b.q_pos").alias("q1"), F.col("s.a.r_pos").alias("r0"), F.col("s.b.r_pos").alias("r1"))
    step = step.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("q0") / _BIN), F.floor(F.col("q1") / _BIN))))
    more = [c for c in tags.columns if c not in ("genome_id", "contig_id", "enzyme", "position")]
    t = tags.select(F.col("genome_id").alias("query"), F.col("contig_id").alias("q_contig"), "enzyme", "position", *more, F.floor(F.col("position") / _BIN).alias("_bin"))
    j = step.join(t, ["query", "q_contig", "_bin"]).where("position >= q0 and position <= q1")
    at = F.floor(F.col("r0") + (F.col("r1") - F.col("r0")) * (F.col("position") - F.col("q0")) / (F.col("q1") - F.col("q0")))
    first = F.min(F.struct("chain_id", "q0", "r_contig", "orient", at.alias("at"), *more)).alias("c")
    return j.groupBy("query", "reference", "q_contig", "enzyme", "position").agg(first).select("query", "reference", "q_contig", "enzyme", "position", *[f"c.{c}" for c in more], "c.chain_id", "c.r_contig", "c.orient", "c.at")


def filled(claims: DataFrame, tags: DataFrame, cfg: Config = Config()) -> DataFrame:
    """query, reference, enzyme, m0, m1, m2, n_miss: claimed tags by their fewest mismatches with a reference tag near their place."""
    own = seq.pack(F.col("tag"))
    c = claims.withColumn("_tag", F.when(F.col("orient") == "-", seq.pack(seq.revcomp(F.col("tag")))).otherwise(own)).drop("tag")
    r = tags.select(F.col("genome_id").alias("reference"), F.col("contig_id").alias("r_contig"), "enzyme", F.col("position").alias("r_pos"), own.alias("_other"))
    key = ["query", "reference", "q_contig", "enzyme", "position"]
    near = intervals.band_join(c, r, ["reference", "r_contig", "enzyme"], "at", "r_pos", cfg.local_window)
    near = near.groupBy(*key).agg(F.min(seq.packed_mismatches(F.col("_tag"), F.col("_other"))).alias("mm"))
    m = c.select(*key).join(near, key, "left").withColumn("mm", F.coalesce("mm", F.lit(99)))
    counts = [F.count(F.when(F.col("mm") == k, 1)).alias(f"m{k}") for k in range(cfg.tolerance + 1)]
    return m.groupBy("query", "reference", "enzyme").agg(*counts, F.count(F.when(F.col("mm") > cfg.tolerance, 1)).alias("n_miss"))
