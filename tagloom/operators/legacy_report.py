"""The older path's results: aligned fractions, identities, confidence, and their text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.enzymes import Enzyme
from tagloom.operators.legacy import block_kmer_identity, confidence
from tagloom.operators.report import debias
from tagloom.operators.synteny import GROUP, block_sizes, chained_blocks, match_length, mean_length

#: The header lines of the formats.
TSV = ("query_file", "ref_file", "ani", "af_q", "af_r", "query_name", "ref_name", "shared_tags", "sv_count")
EXTENDED_TSV = (*TSV, "rearrangements", "indels", "synteny_blocks")
PAF = ("qname", "qlen", "qstart", "qend", "strand", "rname", "rlen", "rstart", "rend", "nmatch", "alen", "mapq")
VARIANT_PAF = (*PAF, "sv_type", "sv_size")


def contig_mash_ani(matches: DataFrame, tags: DataFrame, panel: list[Enzyme] | None = None) -> DataFrame:
    """query, reference, q_contig, r_contig, n, mash_ani: for each query contig the reference contig with the most matches (then the smaller number).

    mash_ani is 1 + ln(c) / mean tag length, from 0 to 1, where c is the geometric
    mean of the matched shares of both contigs' tags.
    """
    total = tags.groupBy("genome_id", "contig_id").agg(F.count(F.lit(1)).alias("total"))
    n = matches.groupBy("query", "reference", "q_contig", "r_contig").agg(F.count(F.lit(1)).alias("n"), F.avg(mean_length(matches, panel)).alias("len"))
    w = Window.partitionBy("query", "reference", "q_contig").orderBy(F.desc("n"), "r_contig")
    best = n.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    side = lambda role, contig, name: total.select(F.col("genome_id").alias(role), F.col("contig_id").alias(contig), F.col("total").alias(name))
    best = best.join(side("query", "q_contig", "q_total"), ["query", "q_contig"]).join(side("reference", "r_contig", "r_total"), ["reference", "r_contig"])
    shared = F.col("n") / F.sqrt(F.col("q_total") * F.col("r_total"))
    return best.select("query", "reference", "q_contig", "r_contig", "n", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.log(shared) / F.col("len"))).alias("mash_ani"))


def summary(matches: DataFrame, tags: DataFrame, pairs: DataFrame, min_shared: int = 10, min_af: float = 0.1, weights: str = "synteny", tolerance: int = 5000, mash: bool = True, panel: list[Enzyme] | None = None, contigs: DataFrame | None = None, k: int = 15) -> DataFrame:
    """One row a pair: ani, raw_ani, weighted_ani, mash_ani, kmer_ani (fractions), af_query, af_reference, confidence, shared_tags, below_detection.

    Aligned fractions are the matched shares of either genome's tags. With fewer
    than ``min_shared`` matches or a fraction below ``min_af`` all but these two
    are 0 and the pair is below detection; so it is with an ani under 0.83. ani
    is kmer_ani, the k-mer identity of the matches' blocks, which takes ``contigs``
    (genome_id, contig_id, seq, length) and is the contigs' mash identity weighted
    by their matches where there are none; or, without ``mash``, the raw one with
    the simple correction. weights: uniform, synteny,
    position or gap (of the matches' own gap_diff). A pair without matches has a
    row, too.
    """
    sizes = tags.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n"))
    per = block_sizes(matches, tolerance) if weights == "synteny" else matches
    weight = {"uniform": F.lit(1.0), "synteny": F.sqrt(F.col("n_tags") if weights == "synteny" else F.lit(1)), "position": 1 + F.sin(F.col("q_pos") / (F.greatest("q_pos", F.lit(1)) + 1)), "gap": 1 - F.least(F.abs("gap_diff"), F.lit(10)) / 20}[weights]
    per = per.select("query", "reference", (1 - F.col("mm") / match_length(per, panel)).alias("local"), weight.alias("w"))
    per = per.groupBy("query", "reference").agg(F.count(F.lit(1)).alias("shared"), F.avg("local").alias("raw"), (F.sum(F.col("local") * F.col("w")) / F.sum("w")).alias("weighted"))
    mashed = contig_mash_ani(matches, tags, panel).groupBy("query", "reference").agg((F.sum(F.col("mash_ani") * F.col("n")) / F.sum("n")).alias("mash"))
    d = pairs.select("query", "reference").join(per, ["query", "reference"], "left").join(mashed, ["query", "reference"], "left")
    if contigs is None:
        d = d.withColumn("kmer_ani", F.lit(None).cast("double"))
    else:
        d = d.join(block_kmer_identity(chained_blocks(matches, tolerance, panel), contigs, [*GROUP, "block"], "n_tags", k), ["query", "reference"], "left")
    for role, name in (("query", "q_tags"), ("reference", "r_tags")):
        d = d.join(sizes.select(F.col("genome_id").alias(role), F.col("n").alias(name)), role, "left")
    share = lambda total: F.when(F.coalesce(F.col(total), F.lit(0)) > 0, F.coalesce(F.col("shared"), F.lit(0)) / F.col(total)).otherwise(0.0)
    d = d.withColumn("shared", F.coalesce("shared", F.lit(0))).withColumn("af_query", share("q_tags")).withColumn("af_reference", share("r_tags"))
    low = F.least("af_query", "af_reference")
    ok = (F.col("shared") >= min_shared) & (low >= min_af)
    kept = lambda c: F.when(ok, c).otherwise(0.0)
    kmer = F.coalesce("kmer_ani", "mash")
    ani = kmer if mash else debias(100 * F.col("raw"), low) / 100
    d = d.select("query", "reference", kept(ani).alias("ani"), kept(F.col("raw")).alias("raw_ani"), kept(F.col("weighted")).alias("weighted_ani"), kept(F.col("mash")).alias("mash_ani"), kept(kmer).alias("kmer_ani"), "af_query", "af_reference", kept(confidence(F.col("shared"), low)).alias("confidence"), F.when(ok, F.col("shared")).otherwise(0).alias("shared_tags"))
    return d.withColumn("below_detection", F.col("ani") < 0.83)


def tsv_rows(summary_: DataFrame, variants: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """The 9 columns of ``TSV``, or with ``blocks`` the 12 of ``EXTENDED_TSV``; numbers have four decimals. ``query_file`` and ``ref_file`` are the genomes' names where summary_ has no such columns."""
    kind = F.col("sv_type").isin("inversion", "translocation")
    v = variants.groupBy("query", "reference").agg(F.count(F.lit(1)).alias("sv_count"), F.count_if(kind).alias("rearrangements"), F.count_if(~kind).alias("indels"))
    d = summary_.join(v, ["query", "reference"], "left")
    if blocks is not None:
        d = d.join(blocks.groupBy("query", "reference").agg(F.count(F.lit(1)).alias("synteny_blocks")), ["query", "reference"], "left")
    file = lambda name, role: F.col(name if name in summary_.columns else role).alias(name)
    four = lambda c: F.format_string("%.4f", F.col(c))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    cols = [file("query_file", "query"), file("ref_file", "reference"), four("ani").alias("ani"), four("af_query").alias("af_q"), four("af_reference").alias("af_r"), F.col("query").alias("query_name"), F.col("reference").alias("ref_name"), "shared_tags", count("sv_count")]
    return d.select(*cols, *([count(c) for c in EXTENDED_TSV[9:]] if blocks is not None else []))


def nested_json(summary_: DataFrame, blocks: DataFrame, variants: DataFrame, pretty: bool = True) -> DataFrame:
    """query, reference, json: a pair's result with its blocks and variants as lists in the order of their places."""
    ends = [F.col(f"{a}_{b}").alias(f"{c}_{b}") for a, c in (("q", "query"), ("r", "ref")) for b in ("start", "end")]
    listed = lambda df, name, *more: df.groupBy("query", "reference").agg(F.sort_array(F.collect_list(F.struct(*ends, *more))).alias(name))
    b = listed(blocks, "synteny_blocks", F.col("n_tags").alias("matched_tags"), F.col("orient").alias("orientation"), "block_ani")
    v = listed(variants, "structural_variations", F.initcap("sv_type").alias("sv_type"), "size", "confidence")
    d = summary_.join(b, ["query", "reference"], "left").join(v, ["query", "reference"], "left")
    none = lambda name, df: F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)).alias(name)
    fields = ["query", "reference", "ani", "af_query", "af_reference", "weighted_ani", "confidence", "shared_tags", none("synteny_blocks", b), none("structural_variations", v)]
    return d.select("query", "reference", F.to_json(F.struct(*fields), {"pretty": str(pretty).lower()}).alias("json"))


def _line(*cols: Column) -> Column:
    return F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("line")


def paf_lines(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """query, reference, line: the 12 columns of ``PAF`` of each block, mapping quality 60. lengths: genome_id, length (0 where a genome has none)."""
    d = blocks
    for role in ("query", "reference"):
        d = d.join(lengths.groupBy(F.col("genome_id").alias(role)).agg(F.sum("length").alias(f"{role[0]}len")), role, "left")
    c = F.col
    size = lambda x: F.coalesce(c(x), F.lit(0))
    return d.select("query", "reference", _line(c("query"), size("qlen"), c("q_start"), c("q_end"), c("orient"), c("reference"), size("rlen"), c("r_start"), c("r_end"), c("n_tags"), F.greatest(c("q_end") - c("q_start"), F.lit(0)), F.lit(60)))


def variant_paf_lines(variants: DataFrame) -> DataFrame:
    """query, reference, line: the 14 columns of ``VARIANT_PAF`` of each variant; names and lengths are the fixed words query, ref and 0."""
    c, zero = F.col, F.lit(0)
    strand = F.when(c("sv_type") == "inversion", "-").otherwise("+")
    return variants.select("query", "reference", _line(F.lit("query"), zero, c("q_start"), c("q_end"), strand, F.lit("ref"), zero, c("r_start"), c("r_end"), zero, F.abs("size"), zero, F.initcap("sv_type"), c("size")))


def write_lines(lines: DataFrame, header: tuple[str, ...], path: str) -> None:
    """The lines as text files, each under the header."""
    lines.select(F.col("line").alias("\t".join(header))).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
