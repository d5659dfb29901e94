"""Structural variants from chains, by windows over chain order and within chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLS = ("query", "reference", "sv_type", "q_contig", "q_start", "q_end", "r_contig", "r_start", "r_end", "size", "support_left", "support_right")


def within_chain(chains: DataFrame, indel_min: int = 1000) -> DataFrame:
    """Neighbouring anchors whose steps on query and reference differ by more than ``indel_min``."""
    a = chains.select("query", "reference", "chain_id", "q_contig", "r_contig", "orient", "n_anchors", F.posexplode("anchors").alias("i", "a"))
    w = Window.partitionBy("query", "reference", "chain_id").orderBy("i")
    a = a.withColumn("b", F.lead("a").over(w)).where("b is not null")
    step = F.col("b.r_pos") - F.col("a.r_pos")
    diff = (F.col("b.q_pos") - F.col("a.q_pos")) - F.when(F.col("orient") == "-", -step).otherwise(step)
    a = a.withColumn("diff", diff).where(F.abs("diff") > indel_min)
    return a.select(
        "query", "reference", F.when(F.col("diff") > 0, "insertion").otherwise("deletion").alias("sv_type"), "q_contig", F.col("a.q_pos").alias("q_start"), F.col("b.q_pos").alias("q_end"), "r_contig",
        F.least("a.r_pos", "b.r_pos").alias("r_start"), F.greatest("a.r_pos", "b.r_pos").alias("r_end"), F.abs("diff").alias("size"), (F.col("i") + 1).cast("long").alias("support_left"), (F.col("n_anchors") - F.col("i") - 1).cast("long").alias("support_right"),
    )


def inversions(chains: DataFrame) -> DataFrame:
    """Chains on the reverse strand, supported by their neighbours on the query contig."""
    w = Window.partitionBy("query", "reference", "q_contig").orderBy("q_start", "q_end", "chain_id")
    c = chains.withColumn("left", F.coalesce(F.lag("n_anchors").over(w), F.lit(0))).withColumn("right", F.coalesce(F.lead("n_anchors").over(w), F.lit(0))).where("orient = '-'")
    return c.select("query", "reference", F.lit("inversion").alias("sv_type"), "q_contig", "q_start", "q_end", "r_contig", "r_start", "r_end", (F.col("q_end") - F.col("q_start")).alias("size"), F.col("left").cast("long").alias("support_left"), F.col("right").cast("long").alias("support_right"))


def junctions(chains: DataFrame, indel_min: int = 1000) -> DataFrame:
    """Neighbouring chains of a query contig: translocations, and indels unless another chain has an anchor between."""
    w = Window.partitionBy("query", "reference", "q_contig").orderBy("q_start", "q_end", "chain_id")
    last, first = F.element_at("anchors", -1), F.element_at("anchors", 1)
    fields = lambda p: F.struct(F.col("chain_id").alias("id"), F.col("r_contig").alias("rc"), F.col("orient").alias("o"), F.col("n_anchors").alias("n"), p["q_pos"].alias("q"), p["r_pos"].alias("r"))
    j = chains.select("query", "reference", "q_contig", fields(last).alias("a"), F.lead(fields(first)).over(w).alias("b")).where("b is not null")
    step = F.col("b.r") - F.col("a.r")
    j = j.withColumn("q_gap", F.col("b.q") - F.col("a.q")).withColumn("r_gap", F.when(F.col("a.o") == "-", -step).otherwise(step))
    support = [F.col("a.n").cast("long").alias("support_left"), F.col("b.n").cast("long").alias("support_right")]
    moved = j.where("a.rc <> b.rc or (a.o = b.o and r_gap < 0)")
    moved = moved.select("query", "reference", F.lit("translocation").alias("sv_type"), "q_contig", F.col("a.q").alias("q_start"), F.greatest("a.q", "b.q").alias("q_end"), F.col("b.rc").alias("r_contig"), F.when(F.col("a.rc") == F.col("b.rc"), F.least("a.r", "b.r")).otherwise(F.col("b.r")).alias("r_start"), F.when(F.col("a.rc") == F.col("b.rc"), F.greatest("a.r", "b.r")).otherwise(F.col("b.r")).alias("r_end"), F.when(F.col("a.rc") == F.col("b.rc"), F.abs(F.col("r_gap"))).otherwise(F.greatest(F.lit(0), F.col("q_gap"))).alias("size"), *support)
    near = j.where("a.rc = b.rc and a.o = b.o and r_gap >= 0").withColumn("diff", F.col("q_gap") - F.col("r_gap")).where(F.abs("diff") > indel_min).withColumn("lo", F.least("a.r", "b.r")).withColumn("hi", F.greatest("a.r", "b.r"))
    # both ends are anchors, and their own chains lie outside: so the anchors within are those of other chains, counted from places up to either end
    c = chains.select("query", "reference", F.col("r_contig").alias("rc"), F.explode("anchors.r_pos").alias("place")).groupBy("query", "reference", "rc", "place").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("upto", F.sum("n").over(Window.partitionBy("query", "reference", "rc").orderBy("place")))
    keys = ["query", "reference", "rc"]
    near = near.withColumn("rc", F.col("a.rc"))
    near = near.join(c.select(*keys, F.col("place").alias("lo"), F.col("upto").alias("_lo")), [*keys, "lo"]).join(c.select(*keys, F.col("place").alias("hi"), (F.col("upto") - F.col("n")).alias("_hi")), [*keys, "hi"])
    free = near.where("_hi <= _lo")
    free = free.select("query", "reference", F.when(F.col("diff") > 0, "insertion").otherwise("deletion").alias("sv_type"), "q_contig", F.col("a.q").alias("q_start"), F.col("b.q").alias("q_end"), F.col("a.rc").alias("r_contig"), F.col("lo").alias("r_start"), F.col("hi").alias("r_end"), F.abs("diff").alias("size"), *support)
    return moved.unionByName(free)


def detect(chains: DataFrame, indel_min: int = 1000, rearrangement: bool = False, indel: bool = False) -> DataFrame:
    """All calls of ``chains``; with one of the two filters only those kinds, with neither all."""
    calls = within_chain(chains, indel_min).unionByName(inversions(chains)).unionByName(junctions(chains, indel_min)).select(*CALLS)
    kinds = (["inversion", "translocation"] if rearrangement else []) + (["insertion", "deletion"] if indel else [])
    return calls.where(F.col("sv_type").isin(kinds)) if kinds else calls


def ordered(calls: DataFrame) -> DataFrame:
    """The calls of each pair in the order of their query places; equal places by the rest of the row."""
    first = ["query", "reference", "q_contig", "q_start", "q_end"]
    return calls.orderBy(*first, *[c for c in CALLS if c not in first])


def paf(chains: DataFrame, q_lengths: DataFrame, r_lengths: DataFrame, mean_tag_len: int = 29) -> DataFrame:
    """The 12 PAF columns of each chain. lengths: genome_id, contig_id, length."""
    q = q_lengths.select(F.col("genome_id").alias("query"), F.col("contig_id").alias("q_contig"), F.col("length").alias("q_len"))
    r = r_lengths.select(F.col("genome_id").alias("reference"), F.col("contig_id").alias("r_contig"), F.col("length").alias("r_len"))
    span: Column = F.greatest(F.col("q_end") - F.col("q_start"), F.col("r_end") - F.col("r_start"))
    per_kb = F.col("n_anchors") / (F.greatest(F.col("q_end") - F.col("q_start"), F.lit(1)) / 1000)
    return chains.join(q, ["query", "q_contig"]).join(r, ["reference", "r_contig"]).select(
        F.concat_ws(":", "query", "q_contig").alias("q_name"), "q_len", "q_start", "q_end", F.col("orient").alias("strand"), F.concat_ws(":", "reference", "r_contig").alias("r_name"), "r_len", "r_start", "r_end",
        F.least(F.col("n_anchors") * mean_tag_len, span).alias("n_match"), span.alias("aln_len"), F.least(F.lit(60), F.floor(10 * per_kb)).cast("int").alias("mapq"),
    )
