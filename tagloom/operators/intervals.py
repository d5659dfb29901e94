"""Interval and order operators: unions, band joins, nearest neighbours, gap clusters, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covered(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Base pairs in the union of spans by key, and the number of islands; touching spans are one (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    return s.groupBy(*keys, "_island").agg((F.max(end) - F.min(start)).alias("_bp")).groupBy(*keys).agg(F.sum("_bp").alias("covered_bp"), F.count(F.lit(1)).alias("islands"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """Rows of equal keys whose places differ by at most ``width``.

    Places are cut into bins of that width and every left row asks its bin and
    both neighbours, so the band becomes an equi-join; a range predicate alone
    would be a nested loop within each key.
    """
    l = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(left_at) / width) + k for k in (-1, 0, 1)])))
    r = right.withColumn("_bin", F.floor(F.col(right_at) / width))
    return l.join(r, [*keys, "_bin"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("_bin")


def nearest(points: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Distance to the strictly next and strictly previous place of the key (null at the ends)."""
    w = Window.partitionBy(*keys).orderBy(at)
    d = points.select(*keys, at).distinct()
    return d.select(*keys, at, (F.lead(at).over(w) - F.col(at)).alias("next_distance"), (F.col(at) - F.lag(at).over(w)).alias("previous_distance"))


def gap_clusters(points: DataFrame, keys: list[str], at: str, gap: int = 1000) -> DataFrame:
    """Runs of places with steps of at most ``gap``: cluster from 0, size, first, last."""
    w = Window.partitionBy(*keys).orderBy(at)
    p = points.withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(w))
    return p.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("size"), F.min(at).alias("first"), F.max(at).alias("last"))


def upper_median_gap(places: Column) -> Column:
    """The upper median of the steps between the sorted places of an array; 0 for fewer than two."""
    s = F.array_sort(places)
    steps = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) - F.get(s, i - 1)))
    return F.when(F.size(places) < 2, F.lit(0).cast("long")).otherwise(F.get(steps, F.floor((F.size(places) - 1) / 2).cast("int")))


def extend_span(start: Column, end: Column, by: Column, length: Column) -> tuple[Column, Column]:
    """A span wider by ``by`` (10 000 at most) on both sides, within [0, length]; a length of 0 is unknown."""
    e = F.least(by, F.lit(10_000))
    return F.greatest(start - e, F.lit(0)), F.when(length > 0, F.least(end + e, length)).otherwise(end + e)


def interpolate(x: Column, qs: Column, rs: Column) -> Column:
    """Piecewise linear value of rs at x over ascending qs, clamped at the ends."""
    n = F.size(qs)
    k = F.size(F.filter(qs, lambda q: q <= x))
    q0, q1, r0, r1 = F.get(qs, k - 1), F.get(qs, k), F.get(rs, k - 1), F.get(rs, k)
    return F.when(k == 0, F.get(rs, F.lit(0))).when(k >= n, F.get(rs, n - 1)).otherwise(r0 + (r1 - r0) * (x - q0) / (q1 - q0)).cast("double")


def gap_penalty(d: Column) -> Column:
    return 0.0005 * d + 0.05 * F.log2(d + 1)


def synteny(chains: DataFrame, anchors: DataFrame) -> DataFrame:
    """Blocks, score, breakpoints, unconserved adjacencies and block sizes of each pair, by aggregates over chains and anchors."""
    c = chains.groupBy("query", "reference").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_anchors").alias("in_chains"), F.countDistinct("q_contig").alias("contigs"), F.max("n_anchors").alias("max_block_anchors"), F.avg("n_anchors").alias("mean_block_anchors"))
    a = anchors.groupBy("query", "reference").agg(F.count(F.lit(1)).alias("n_anchors"), F.countDistinct("q_contig").alias("anchored"))
    j = c.join(a, ["query", "reference"]).where("n_anchors >= 2")
    kept, possible = F.col("in_chains") - F.col("blocks"), F.col("in_chains") - F.col("contigs")
    return j.select("query", "reference", F.col("blocks").alias("synteny_blocks"), F.when(possible > 0, kept / possible).otherwise(0.0).alias("synteny_score"), (F.col("blocks") - F.col("contigs")).alias("breakpoint_count"), (F.col("n_anchors") - F.col("anchored") - kept).alias("unconserved"), "max_block_anchors", "mean_block_anchors")
