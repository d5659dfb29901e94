"""Anchors: a Hamming similarity join of tags as equi-joins on parts (pigeonhole)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.sequence import pack, packed_mismatches, revcomp
from tagloom.operators.digest import with_occurrences
from tagloom.operators.enzymes import Enzyme

TOLERANCE, MAX_OCCURRENCE, MAX_BUCKET = 2, 5, 256
#: For paths that know no limit of occurrences or buckets.
NO_LIMIT = 1 << 62


def parts(packed: Column, length: Column, tolerance: int = TOLERANCE) -> Column:
    """Array of (part, bits): the tolerance + 1 pieces of a packed tag, near equal, the longer ones first."""
    n = tolerance + 1
    size, extra = F.floor(length / n).cast("int"), length % n
    pieces = []
    for k in range(n):
        start = size * k + F.least(F.lit(k), extra)
        width = size + (extra > k).cast("int")
        bits = F.call_function("shiftrightunsigned", packed, 2 * start).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 2 * width) - 1)
        pieces.append(F.struct(F.lit(k).alias("part"), bits.alias("bits")))
    return F.array(*pieces)


def rare_tags(tags: DataFrame, max_occurrence: int = MAX_OCCURRENCE) -> DataFrame:
    """Tags whose canonical form occurs at most so often in their genome, with n (counted unless it is there)."""
    return (tags if "n" in tags.columns else with_occurrences(tags)).where(F.col("n") <= max_occurrence)


def _pieces(tags: DataFrame, names: list[str], tolerance: int) -> DataFrame:
    """``tags`` (packed as x, length len) with a row for each part."""
    return tags.select("*", F.explode(parts(F.col("x"), F.col("len"), tolerance)).alias("p")).select(*names, "x", "p.part", "p.bits")


def find_anchors(query_tags: DataFrame, reference_tags: DataFrame, pairs: DataFrame | None = None, panel: list[Enzyme] | None = None, tolerance: int = TOLERANCE, max_occurrence: int = MAX_OCCURRENCE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """query, reference, enzyme, q_contig, q_pos, r_contig, r_pos, orient, mm, uniq.

    Tags of one enzyme within ``tolerance`` mismatches on either strand; of the
    enzymes of ``panel`` only, if one is given. Two tags within d mismatches
    agree on one of d + 1 parts, so the join is on (enzyme, part, bits) of tags
    packed once; the mismatches are a residual of it, so a hit that fails leaves
    no row. Buckets of more than ``max_bucket`` rows of a reference are skipped,
    as the measure defines it. pairs (query, reference; no pair twice) is
    met after that, by genome names alone. Anchors at the same places and strand
    are one: the fewest mismatches, then the first enzyme by name.
    """
    own = lambda tags: tags if panel is None else tags.where(F.col("enzyme").isin([e.name for e in panel]))
    q = rare_tags(own(query_tags), max_occurrence).select(F.col("genome_id").alias("query"), "enzyme", F.col("contig_id").alias("q_contig"), F.col("position").alias("q_pos"), (F.col("n") == 1).alias("q_one"), F.length("tag").alias("len"), pack(F.col("tag")).alias("x"))
    q = _pieces(q, ["query", "enzyme", "q_contig", "q_pos", "q_one"], tolerance).withColumnRenamed("x", "q_x")
    strands = F.array(F.struct(F.lit("+").alias("orient"), pack(F.col("tag")).alias("x")), F.struct(F.lit("-").alias("orient"), pack(revcomp(F.col("tag"))).alias("x")))
    r = rare_tags(own(reference_tags), max_occurrence).select(F.col("genome_id").alias("reference"), "enzyme", F.col("contig_id").alias("r_contig"), F.col("position").alias("r_pos"), (F.col("n") == 1).alias("r_one"), F.length("tag").alias("len"), F.inline(strands))
    r = _pieces(r, ["reference", "enzyme", "r_contig", "r_pos", "r_one", "orient"], tolerance).withColumnRenamed("x", "r_x")
    if max_bucket < NO_LIMIT:
        held = F.count(F.lit(1)).over(Window.partitionBy("reference", "enzyme", "part", "bits"))
        r = r.withColumn("held", held).where(F.col("held") <= max_bucket).drop("held")
    q, r = q.alias("q"), r.alias("r")
    mm = packed_mismatches(F.col("q_x"), F.col("r_x"))
    hits = q.join(r, (F.col("q.enzyme") == F.col("r.enzyme")) & (F.col("q.part") == F.col("r.part")) & (F.col("q.bits") == F.col("r.bits")) & (mm <= tolerance))
    hits = hits.select("query", "reference", F.col("q.enzyme").alias("enzyme"), "q_contig", "q_pos", "r_contig", "r_pos", "orient", mm.alias("mm"), (F.col("q_one") & F.col("r_one")).alias("uniq"))
    if pairs is not None:
        hits = hits.join(pairs.select("query", "reference"), ["query", "reference"])
    best = hits.groupBy("query", "reference", "q_contig", "q_pos", "r_contig", "r_pos", "orient").agg(F.min(F.struct("mm", "enzyme", "uniq")).alias("b"))
    return best.select("query", "reference", "b.enzyme", "q_contig", "q_pos", "r_contig", "r_pos", "orient", F.col("b.mm").alias("mm"), F.col("b.uniq").alias("uniq"))


def whole_genome_strata(query_tags: DataFrame, anchors: DataFrame, max_occurrence: int = MAX_OCCURRENCE) -> DataFrame:
    """query, reference, enzyme, found, total: the query's rare tags, and those with an anchor, for pairs with anchors."""
    total = rare_tags(query_tags, max_occurrence).groupBy(F.col("genome_id").alias("query"), "enzyme").agg(F.count(F.lit(1)).alias("total"))
    found = anchors.groupBy("query", "reference", "enzyme").agg(F.countDistinct("q_contig", "q_pos").alias("found"))
    pairs = anchors.select("query", "reference").distinct()
    return pairs.join(total, "query").join(found, ["query", "reference", "enzyme"], "left").select("query", "reference", "enzyme", F.coalesce("found", F.lit(0)).alias("found"), "total")
