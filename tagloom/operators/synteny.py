"""The older path's synteny: chains of matches as blocks, and variants from blocks and unmatched tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.enzymes import Enzyme, resolve

GROUP = ("query", "reference", "q_contig", "r_contig", "orient")
VARIANTS = ("query", "reference", "sv_type", "q_start", "q_end", "r_start", "r_end", "size", "confidence")


def tag_length(enzyme: Column, panel: list[Enzyme] | None = None) -> Column:
    return F.create_map(*[x for e in (resolve() if panel is None else panel) for x in (F.lit(e.name), F.lit(e.tag_len))])[enzyme]


def match_length(matches: DataFrame, panel: list[Enzyme] | None = None) -> Column:
    """The longer tag of a match; matches without ``r_enzyme`` are of one enzyme."""
    own = tag_length(F.col("enzyme"), panel)
    return F.greatest(own, tag_length(F.col("r_enzyme"), panel)) if "r_enzyme" in matches.columns else own


def mean_length(matches: DataFrame, panel: list[Enzyme] | None = None) -> Column:
    """The mean length of a match's two tags."""
    own = tag_length(F.col("enzyme"), panel)
    return (own + tag_length(F.col("r_enzyme"), panel)) / 2 if "r_enzyme" in matches.columns else own


def signed_gaps(matches: DataFrame) -> DataFrame:
    """gap_diff anew: the step on the query since the match before less the step on the reference, steps back counting as 0; 0 for the first."""
    w = Window.partitionBy("query", "reference").orderBy("q_contig", "q_pos", "r_contig", "r_pos")
    step = lambda c: F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0))
    return matches.withColumn("gap_diff", F.coalesce(step("q_pos") - step("r_pos"), F.lit(0)).cast("long"))


def chain_ranges(q: np.ndarray, diagonal: np.ndarray, tolerance: int) -> list[tuple[int, int]]:
    """(first, last) of the chains of matches sorted by q.

    A match follows any earlier one whose diagonal is at most ``tolerance`` away,
    and takes the one that ends the longest chain (of equal ones the first).
    Chains are taken from the longest on, each up to the first match that a chain
    before has; matches in no chain stand alone. Only the diagonals in reach are
    looked at for each match.
    """
    n = len(q)
    order = np.argsort(diagonal, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lo = np.searchsorted(diagonal[order], diagonal - tolerance, "left")
    hi = np.searchsorted(diagonal[order], diagonal + tolerance, "right")
    seen = np.full(n, -1, np.int64)  # by diagonal: length * (n + 1) + n - index, so that the longest and then the first is greatest
    length, before, passed = np.ones(n, np.int64), np.full(n, -1, np.int64), 0
    for i in range(n):
        while q[passed] < q[i]:
            seen[rank[passed]] = length[passed] * (n + 1) + n - passed
            passed += 1
        top = seen[lo[i] : hi[i]].max()
        if top >= 0:
            length[i], before[i] = top // (n + 1) + 1, n - top % (n + 1)
    used, out = np.zeros(n, bool), []
    for last in np.lexsort((np.arange(n), -length)):
        path, k = [], last
        while k >= 0 and not used[k]:
            path.append(k)
            k = before[k]
        if len(path) > 1:
            used[path] = True
            out.append((int(path[-1]), int(path[0])))
    return sorted(out + [(int(k), int(k)) for k in np.flatnonzero(~used)])


def _stranded(matches: DataFrame) -> DataFrame:
    return matches if "orient" in matches.columns else matches.withColumn("orient", F.lit("+"))


def _lists(matches: DataFrame, more: list[str]) -> DataFrame:
    """A row for each pair of contigs and strand: its matches as lists in the order of q_pos, r_pos, then ``more``."""
    m = F.sort_array(F.collect_list(F.struct("q_pos", "r_pos", *more)))
    return matches.groupBy(*GROUP).agg(m.alias("m")).select(*GROUP, F.col("m.q_pos").alias("q"), F.col("m.r_pos").alias("r"), "m")


def _ranges(batch: pa.RecordBatch, tolerance: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(q, r, chain ranges) of each row of ``_lists``."""
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column("q")).to_numpy())))
    q, r = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("q", "r"))
    for a, b, orient in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("orient").to_pylist()):
        x, y = q[a:b], r[a:b]
        yield x, y, [(0, 0)] if b - a == 1 else chain_ranges(x, x + y if orient == "-" else x - y, tolerance)


def chained_blocks(matches: DataFrame, tolerance: int = 5000, panel: list[Enzyme] | None = None) -> DataFrame:
    """Blocks of the matches of a pair of contigs and a strand, each from a chain's first match to its last.

    query, reference, q_contig, r_contig, orient, block (number in its group),
    n_tags, q_start, q_end, r_start, r_end, block_ani (mean identity of its
    matches). A block has all matches between its ends, those of other chains
    too, so that blocks may share matches. Matches without ``orient`` are
    forward. No matches give no blocks.
    """
    m = _stranded(matches)
    m = _lists(m.select(*GROUP, "q_pos", "r_pos", (1 - F.col("mm") / match_length(m, panel)).alias("ani")), ["ani"])
    names = ["block", "n_tags", "q_start", "q_end", "r_start", "r_end", "block_ani"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            ani = batch.column("ani").flatten().to_numpy()
            first = 0
            for g, (q, r, ranges) in enumerate(_ranges(batch, tolerance)):
                own = ani[first : first + len(q)]
                first += len(q)
                of += [g] * len(ranges)
                rows += [(k, b - a + 1, q[a], q[b], r[a : b + 1].min(), r[a : b + 1].max(), own[a : b + 1].mean()) for k, (a, b) in enumerate(ranges)]
            columns = list(zip(*rows)) or [()] * len(names)
            taken = [batch.column(c).take(pa.array(of, pa.int64())) for c in GROUP]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(np.array(x, float if n == "block_ani" else np.int64)) for n, x in zip(names, columns)]], [*GROUP, *names])

    # the JVM takes the lists apart, so that a pair of contigs is a row and no call of its own
    return m.select(*GROUP, "q", "r", F.col("m.ani").alias("ani")).mapInArrow(run, "query string, reference string, q_contig long, r_contig long, orient string, block long, n_tags long, q_start long, q_end long, r_start long, r_end long, block_ani double")


def block_sizes(matches: DataFrame, tolerance: int = 5000) -> DataFrame:
    """matches with n_tags, the size of the last block that has them."""
    m = _stranded(matches).drop("n_tags")
    rest = [c for c in m.columns if c not in (*GROUP, "q_pos", "r_pos")]
    lists = _lists(m, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, _, ranges in _ranges(batch, tolerance):
                size = np.ones(len(q), np.int64)
                for a, b in ranges:
                    size[a : b + 1] = b - a + 1
                out.append(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "n_tags"])

    sized = lists.mapInArrow(run, T.StructType([*lists.schema.fields, T.StructField("n_tags", T.ArrayType(T.LongType()))]))
    one = sized.select(*GROUP, F.inline(F.arrays_zip("m", "n_tags"))).select(*GROUP, "m.*", "n_tags")
    return one.select(*m.columns, "n_tags")


def rearrangements(blocks: DataFrame, jump: int = 100_000) -> DataFrame:
    """Inversions where the strand changes from a block to the next on the query, translocations where the reference jumps ahead by more than ``jump``."""
    w = Window.partitionBy("query", "reference").orderBy("q_contig", "q_start", "q_end", "r_contig", "r_start", "orient")
    fields = ("q_start", "q_end", "r_end", "orient")
    b = blocks.withColumn("p", F.lag(F.struct(*fields)).over(w)).where("p is not null")
    ends = ["query", "reference"]
    at = [F.col("p.q_end").alias("q_start"), F.col("q_start").alias("q_end"), F.col("p.r_end").alias("r_start"), F.col("r_start").alias("r_end")]
    turned = b.where("orient <> p.orient").select(*ends, F.lit("inversion").alias("sv_type"), *at, F.greatest(F.col("q_end") - F.col("p.q_start"), F.lit(0)).alias("size"), F.lit(0.85).alias("confidence"))
    moved = b.where(F.col("r_start") > F.col("p.r_end") + jump).select(*ends, F.lit("translocation").alias("sv_type"), *at, (F.col("r_start") - F.col("p.r_end")).alias("size"), F.lit(0.7).alias("confidence"))
    return turned.unionByName(moved)


def unmatched_of_pairs(tags: DataFrame, pairs: DataFrame, matches: DataFrame, role: str = "query") -> DataFrame:
    """query, reference, enzyme, contig_id, position: each pair's tags on the side ``role`` that no match of the pair has."""
    side = role[0]
    t = pairs.select("query", "reference").join(tags.select(F.col("genome_id").alias(role), "enzyme", "contig_id", "position"), role)
    enzyme = F.col("r_enzyme" if side == "r" and "r_enzyme" in matches.columns else "enzyme").alias("enzyme")
    m = matches.select("query", "reference", enzyme, F.col(f"{side}_contig").alias("contig_id"), F.col(f"{side}_pos").alias("position"))
    return t.join(m, ["query", "reference", "enzyme", "contig_id", "position"], "left_anti").select("query", "reference", "enzyme", "contig_id", "position")


def unmatched_clusters(unmatched: DataFrame, role: str = "query", max_gap: int = 1000, tag_len: int = 32) -> DataFrame:
    """Insertions from clusters of unmatched query tags, deletions from those of the reference.

    A cluster's tags are at most ``max_gap`` apart in the order of places, all
    contigs together; its size is its number of tags times ``tag_len``, and the
    other side's places are 0.
    """
    w = Window.partitionBy("query", "reference").orderBy("position", "contig_id", "enzyme")
    new = F.when(F.col("position") - F.lag("position").over(w) <= max_gap, 0).otherwise(1)
    c = unmatched.withColumn("new", new).withColumn("cluster", F.sum("new").over(w)).groupBy("query", "reference", "cluster").agg(F.min("position").alias("a"), F.max("position").alias("b"), (F.count(F.lit(1)) * tag_len).alias("size"))
    none = F.lit(0).cast("long")
    q, r = ((F.col("a"), F.col("b")), (none, none)) if role == "query" else ((none, none), (F.col("a"), F.col("b")))
    return c.select("query", "reference", F.lit("insertion" if role == "query" else "deletion").alias("sv_type"), q[0].alias("q_start"), q[1].alias("q_end"), r[0].alias("r_start"), r[1].alias("r_end"), "size", F.lit(0.6).alias("confidence"))


def variants(tags: DataFrame, pairs: DataFrame, matches: DataFrame, blocks: DataFrame) -> DataFrame:
    """All four kinds: ``rearrangements`` of blocks, ``unmatched_clusters`` of both sides."""
    out = rearrangements(blocks)
    for role in ("query", "reference"):
        out = out.unionByName(unmatched_clusters(unmatched_of_pairs(tags, pairs, matches, role), role))
    return out.select(*VARIANTS)
