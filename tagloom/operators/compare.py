"""The whole comparison of genome pairs, as one plan over all pairs at once.

Anchors of the screened pairs are chained; the tags in a chain's span are tested
against the reference tags near their place; a fit of these counts says how many
tags in a row may go without an anchor, and chains with a wider step are made
again under that limit. Short contigs that two unique anchors place are tested
without a chain. The counts that result are fitted by folds (``fits``). Pairs are
keys of joins and groups all through, never groups of Python; what is Python is
the chain programme of one run of anchors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import sequence as seq
from tagloom.operators import fill, fits, intervals
from tagloom.operators.anchors import find_anchors, rare_tags
from tagloom.operators.chain import Config
from tagloom.operators.digest import rank_in_contig, with_occurrences
from tagloom.operators.enzymes import Enzyme
from tagloom.operators.fits import NAN
from tagloom.operators.report import gated_estimate
from tagloom.sources.scratch import spread, stored

MIN_RETENTION = 0.20
#: A contig of fewer tags than this many times ``min_chain_anchors`` may be rescued.
SHORT = 8
LEAST_SKIP = 5
PAIR = ["query", "reference"]
PLACE = [*PAIR, "q_contig", "enzyme", "position"]


@dataclass
class Comparison:
    """pairs: a row of estimates each; strata: the counts of each enzyme; chains: with their spans and anchors."""

    pairs: DataFrame
    strata: DataFrame
    chains: DataFrame


def rescue_bases(anchors: DataFrame, tags: DataFrame, cfg: Config = Config()) -> DataFrame:
    """query, reference, q_contig, r_contig, orient, q, r, left, right: where the tags of a short contig belong.

    Of the groups of a contig's unique anchors (two at least, one of them with at
    most one mismatch) the largest counts, then that with fewer mismatches; it
    must rise strictly, its shift within ``max_gap`` from step to step, else the
    contig is left alone. left and right: how far beyond either end the next anchor of
    the reference contig lies (null: none), as of the outer anchors themselves.
    """
    short = tags.groupBy(F.col("genome_id").alias("query"), F.col("contig_id").alias("q_contig")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < SHORT * cfg.min_chain_anchors)
    u = anchors.where("uniq").join(short.select("query", "q_contig"), ["query", "q_contig"], "left_semi")
    s = F.when(F.col("orient") == "-", -F.col("r_pos")).otherwise(F.col("r_pos"))
    g = u.groupBy(*fill.GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum("mm").alias("mm"), F.min("mm").alias("least"), F.sort_array(F.collect_list(F.struct("q_pos", s.alias("s")))).alias("a")).where("n >= 2 and least <= 1")
    b = g.groupBy(*PAIR, "q_contig").agg(F.min(F.struct((-F.col("n")).alias("n"), "mm", "r_contig", "orient", "a")).alias("b")).select(*PAIR, "q_contig", "b.r_contig", "b.orient", "b.a")
    x, y = (lambda i: F.get("a", i)), (lambda i: F.get("a", i - 1))
    fits_ = F.forall(F.sequence(F.lit(1), F.size("a") - 1), lambda i: (x(i)["s"] > y(i)["s"]) & (F.abs((x(i)["q_pos"] - x(i)["s"]) - (y(i)["q_pos"] - y(i)["s"])) <= cfg.max_gap))
    b = b.where(fits_).select(*PAIR, "q_contig", "r_contig", "orient", F.col("a.q_pos").alias("q"), F.transform("a", lambda v: F.abs(v["s"])).alias("r"))
    # the outer anchors are places of the contig themselves, so the next ones beyond are their neighbours
    near = intervals.nearest(anchors, [*PAIR, "r_contig"], "r_pos")
    for side, at in (("left", F.element_at("r", 1)), ("right", F.element_at("r", -1))):
        n = near.select(*PAIR, "r_contig", F.col("r_pos").alias("_at"), "next_distance", "previous_distance")
        up = F.col("orient") == ("-" if side == "left" else "+")
        b = b.withColumn("_at", at).join(n, [*PAIR, "r_contig", "_at"], "left").withColumn(side, F.when(up, F.col("next_distance")).otherwise(F.col("previous_distance"))).drop("_at", "next_distance", "previous_distance")
    return b


def rescued(bases: DataFrame, tags: DataFrame, claims: DataFrame, tails: DataFrame) -> DataFrame:
    """The tags of the bases' contigs that no chain claimed, with the reference place they map to.

    Between the outer anchors all of them, by interpolation. Beyond, with the slope of 1, only where another
    anchor of the reference contig follows within ``tail`` base pairs, and up to it. tails: query, reference, tail.
    """
    t = tags.select(F.col("genome_id").alias("query"), F.col("contig_id").alias("q_contig"), "enzyme", "position", "x", "rx")
    j = bases.join(t, ["query", "q_contig"]).join(claims.select(*PLACE), PLACE, "left_anti").join(tails, PAIR)
    p, lo, hi = F.col("position"), F.element_at("q", 1), F.element_at("q", -1)
    j = j.withColumn("side", F.when(p < lo, -1).when(p > hi, 1).otherwise(0)).withColumn("out", F.when(p < lo, lo - p).when(p > hi, p - hi).otherwise(F.lit(0).cast("long")))
    limit = F.when(F.col("side") < 0, F.col("left")).otherwise(F.col("right"))
    j = j.where((F.col("side") == 0) | ((limit <= F.col("tail")) & (F.col("out") <= limit)))
    sign = F.when(F.col("orient") == "-", -1).otherwise(1)
    edge = F.when(F.col("side") < 0, F.element_at("r", 1)).otherwise(F.element_at("r", -1))
    at = F.when(F.col("side") == 0, F.floor(intervals.interpolate(p, F.col("q"), F.col("r")))).otherwise(F.greatest(edge + F.col("side") * sign * F.col("out"), F.lit(0)))
    return j.select(*PLACE, "x", "rx", "r_contig", "orient", at.cast("long").alias("at"), "side", "out", "q", "r")


def histograms(places: DataFrame, tags: DataFrame, cfg: Config = Config()) -> DataFrame:
    """query, reference, enzyme, hist, n_miss: the claimed tags by their fewest mismatches with a reference tag near their place."""
    c = places.withColumn("_tag", F.when(F.col("orient") == "-", F.col("rx")).otherwise(F.col("x")))
    r = tags.select(F.col("genome_id").alias("reference"), F.col("contig_id").alias("r_contig"), "enzyme", F.col("position").alias("r_pos"), F.col("x").alias("_other"))
    near = intervals.band_join(c.select(*PLACE, "r_contig", "at", "_tag"), r, ["reference", "r_contig", "enzyme"], "at", "r_pos", cfg.local_window)
    best = near.select(*PLACE, seq.packed_mismatches(F.col("_tag"), F.col("_other")).alias("mm")).unionByName(c.select(*PLACE, F.lit(99).alias("mm"))).groupBy(*PLACE).agg(F.min("mm").alias("mm"))
    counts = [F.count(F.when(F.col("mm") == k, 1)) for k in range(cfg.tolerance + 1)]
    return best.groupBy(*PAIR, "enzyme").agg(F.array(*counts).alias("hist"), F.count(F.when(F.col("mm") > cfg.tolerance, 1)).alias("n_miss"))


def rescue_spans(rescued_: DataFrame, q_lengths: DataFrame, r_lengths: DataFrame) -> DataFrame:
    """query, reference, q_contig, r_contig, q_start, q_end, r_start, r_end of each rescued contig: its anchors and the tails that counted, wider by half the median step."""
    reach = lambda side: F.max(F.when(F.col("side") == side, F.col("out")).otherwise(0))
    g = rescued_.groupBy(*PAIR, "q_contig", "r_contig", "orient", "q", "r").agg(reach(-1).alias("left"), reach(1).alias("right"))
    g = g.join(q_lengths.select(F.col("genome_id").alias("query"), F.col("contig_id").alias("q_contig"), F.col("length").alias("_q")), ["query", "q_contig"], "left")
    g = g.join(r_lengths.select(F.col("genome_id").alias("reference"), F.col("contig_id").alias("r_contig"), F.col("length").alias("_r")), ["reference", "r_contig"], "left").fillna(0, ["_q", "_r"])
    half = lambda at: F.floor(intervals.upper_median_gap(at) / 2)
    back = F.col("orient") == "-"
    lo, hi = F.when(back, F.col("right")).otherwise(F.col("left")), F.when(back, F.col("left")).otherwise(F.col("right"))
    q0, q1 = intervals.extend_span(F.element_at("q", 1) - F.col("left"), F.element_at("q", -1) + F.col("right"), half(F.col("q")), F.col("_q"))
    r0, r1 = intervals.extend_span(F.greatest(F.array_min("r") - lo, F.lit(0)), F.array_max("r") + hi, half(F.col("r")), F.col("_r"))
    return g.select(*PAIR, "q_contig", "r_contig", q0.alias("q_start"), q1.alias("q_end"), r0.alias("r_start"), r1.alias("r_end"))


def raw_strata(tags: DataFrame, anchors: DataFrame, pairs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """query, reference, enzyme, hist, n_miss: the query's rare tags, found (first bin) if they have an anchor."""
    total = rare_tags(tags, cfg.max_occurrence).groupBy(F.col("genome_id").alias("query"), "enzyme").agg(F.count(F.lit(1)).alias("total"))
    found = anchors.groupBy(*PAIR, "enzyme").agg(F.countDistinct("q_contig", "q_pos").alias("found"))
    j = pairs.join(total, "query").join(found, [*PAIR, "enzyme"], "left").fillna(0, ["found"])
    return j.select(*PAIR, "enzyme", F.array(F.col("found"), *[F.lit(0).cast("long")] * cfg.tolerance).alias("hist"), (F.col("total") - F.col("found")).alias("n_miss"))


def skip_limits(strata: DataFrame, cfg: Config = Config(), panel: list[Enzyme] | None = None) -> DataFrame:
    """query, reference, max_skip: a longer row of tags without an anchor has a chance under ``gap_alpha`` at the fitted identity; pairs that keep none or all of their tags have no limit."""
    f = fits.Fits(F.col("s"), cfg.tolerance)
    p = fits.dealt(fits.gathered(strata, PAIR, cfg.tolerance, panel)).select(*PAIR, fits.once(F.struct(fits.let(f.uniform(), f.retention).alias("p")))).where("p > 0 and p < 1")
    return p.select(*PAIR, F.greatest(F.lit(float(LEAST_SKIP)), F.ceil(math.log(cfg.gap_alpha) / F.log1p(-F.col("p"))).cast("double")).alias("max_skip"))


def again(chains: DataFrame, anchors: DataFrame, limits: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The chains under the limits, where any is left of a pair; else those without.

    A chain none of whose steps is too wide stays what it is, and so do the others
    of its contigs and strand; only the rest is chained again.
    """
    wide = stored(chains.join(limits, PAIR).groupBy(*fill.GROUP).agg(F.max((F.col("widest") > F.col("max_skip")).cast("int")).alias("wide")).where("wide = 1").drop("wide"), "wide")
    if wide.isEmpty():
        return chains
    new = fill.collinear(anchors.join(wide, fill.GROUP, "left_semi"), cfg, limits)
    left = stored(chains.join(wide, fill.GROUP, "left_anti").unionByName(new), "chains")
    pairs = left.select(*PAIR).distinct()
    return stored(fill.numbered(left.unionByName(chains.join(pairs, PAIR, "left_anti"))), "chains")


def _sides(tags: DataFrame, panel: list[Enzyme] | None) -> DataFrame:
    own = tags if panel is None else tags.where(F.col("enzyme").isin([e.name for e in panel]))
    t = rank_in_contig(with_occurrences(own), panel)
    return stored(t.select("genome_id", "contig_id", "enzyme", "position", "tag", "n", "tag_rank", seq.pack(F.col("tag")).alias("x"), seq.pack(seq.revcomp(F.col("tag"))).alias("rx")), "sides")


def _fraction(spans: DataFrame, side: str, totals: DataFrame) -> DataFrame:
    """query, reference, af_<side>: the union of the spans over the genome's length."""
    genome, name = ("query", "af_query") if side == "q" else ("reference", "af_reference")
    c = intervals.covered(spans, [*PAIR, f"{side}_contig"], f"{side}_start", f"{side}_end").groupBy(*PAIR).agg(F.sum("covered_bp").alias("_bp"))
    return c.join(totals.withColumnRenamed("genome_id", genome), genome).select(*PAIR, (F.col("_bp") / F.greatest("total", F.lit(1))).alias(name))


def compare(query_tags: DataFrame, reference_tags: DataFrame, contigs: DataFrame, pairs: DataFrame, panel: list[Enzyme] | None = None, cfg: Config = Config()) -> Comparison:
    """The comparison of each of ``pairs`` (query, reference; no pair twice).

    contigs: genome_id, contig_id, length of all genomes. Only tags of the panel's
    enzymes count; without a panel all do, those of unregistered enzymes with a site
    of 6 in 32 bases. Pairs without anchors or chains have NaN estimates, are
    below detection and carry the bound only; a pair whose genomes have no tags
    has a row like that, with no bound.
    """
    same = query_tags is reference_tags
    pairs = pairs.select(*PAIR)
    q = _sides(query_tags, panel)
    r = q if same else _sides(reference_tags, panel)
    # lengths are all that is needed of the sequences from here on
    lengths = stored(spread(contigs).select("genome_id", "contig_id", "length"), "lengths")
    totals = lengths.groupBy("genome_id").agg(F.sum("length").alias("total"))
    ranks = q.select(F.col("genome_id").alias("query"), F.col("contig_id").alias("q_contig"), "enzyme", F.col("position").alias("q_pos"), F.col("tag_rank").alias("q_rank"))
    anchors = stored(find_anchors(q, r, pairs, None, cfg.tolerance, cfg.max_occurrence).join(ranks, ["query", "q_contig", "enzyme", "q_pos"]), "anchors")
    bases = stored(rescue_bases(anchors, q, cfg), "bases") if cfg.rescue else None
    chains = stored(fill.collinear(anchors, cfg), "chains")
    chained = chains.select(*PAIR).distinct()
    claim = lambda c: stored(fill.claimed(c, q).select(*PLACE, "x", "rx", "r_contig", "orient", "at"), "claims")

    def places(claims: DataFrame, tails: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        if bases is None:
            return claims, None
        more = stored(rescued(bases, q, claims, tails), "rescued")
        return claims.unionByName(more.select(claims.columns)), more

    endless = chained.withColumn("tail", F.lit(math.inf))
    tested, more = places(claim(chains), endless)
    strata = histograms(tested, r, cfg)
    if cfg.adaptive_gap:
        limits = stored(skip_limits(strata, cfg, panel), "limits")
        chains = again(chains, anchors, limits, cfg)
        spacing = totals.withColumnRenamed("genome_id", "query").join(q.groupBy(F.col("genome_id").alias("query")).agg(F.count(F.lit(1)).alias("n")), "query").select("query", (F.col("total") / F.greatest("n", F.lit(1))).alias("spacing"))
        # pairs that lost all chains under their limit keep those of the first pass, and its endless tails
        bound = chains.join(limits, PAIR).groupBy(*PAIR).agg(F.max("widest").alias("widest"), F.first("max_skip").alias("max_skip")).where("widest <= max_skip")
        tails = endless.drop("tail").join(bound, PAIR, "left").join(spacing, "query", "left").select(*PAIR, F.coalesce((F.col("max_skip") + 1) * F.col("spacing"), F.lit(math.inf)).alias("tail"))
        tested, more = places(claim(chains), tails)
        strata = histograms(tested, r, cfg)
    strata = stored(strata, "strata")

    spans = stored(fill.spanned(chains, lengths, lengths), "spans")
    columns = [*PAIR, "q_contig", "r_contig", "q_start", "q_end", "r_start", "r_end"]
    covering = spans.select(columns) if more is None else spans.select(columns).unionByName(rescue_spans(more, lengths, lengths).select(columns))

    arrays = stored(fits.gathered(strata, PAIR, cfg.tolerance, panel), "arrays")
    fit = fits.fitted(arrays, PAIR, cfg.tolerance)
    raw = fits.gathered(raw_strata(q, anchors, pairs.join(chained, PAIR, "left_anti"), cfg), PAIR, cfg.tolerance, panel)
    raw = fits.dealt(raw).select(*PAIR, fits.once(F.struct(fits.Fits(F.col("s"), cfg.tolerance).upper_bound().alias("raw_upper"))))
    n = anchors.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_anchors"))
    out = pairs.join(n, PAIR, "left").join(intervals.synteny(chains, anchors), PAIR, "left").join(fit, PAIR, "left").join(raw, PAIR, "left")
    out = out.join(fits.agreement(fits.by_enzyme(arrays, PAIR, cfg.tolerance), PAIR), PAIR, "left")
    for side in ("q", "r"):
        out = out.join(_fraction(covering, side, totals), PAIR, "left")
    return Comparison(_rows(out), _with_sites(arrays), spans)


def _with_sites(arrays: DataFrame) -> DataFrame:
    t = arrays.select(*PAIR, F.explode("s").alias("t"))
    return t.select(*PAIR, "t.enzyme", "t.tag_len", "t.body_len", "t.exact_site", "t.d2", "t.d3", F.col("t.h").cast("array<bigint>").alias("hist"), F.col("t.miss").cast("long").alias("n_miss"))


def _rows(j: DataFrame) -> DataFrame:
    """The columns of a result; what a pair lacks is NaN, 0 or an empty array."""
    num = lambda c: F.coalesce(F.col(c), F.lit(NAN))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    loss, hist = num("from_loss"), num("from_hist")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < math.inf)
    fallback: Column = finite(loss) & finite(hist) & (F.abs(loss - hist) > 0.05 + 1e-12)
    kept, se = num("retention"), num("std_err")
    slack = F.when(F.isnan(se), F.lit(0.01)).otherwise(F.greatest(5 * se, F.lit(0.01)))
    inconsistent = F.when(F.isnan(num("ani_uniform")), F.lit(True)).otherwise(finite(loss) & finite(hist) & (kept >= 0.2) & (F.abs(loss - hist) > slack))
    unreliable = (count("synteny_blocks") == 0) | fallback | (count("unconserved") / F.greatest(count("n_anchors"), F.lit(1)) > 0.5)
    return j.select(
        *PAIR, num("het").alias("ani_het"), num("ani_uniform").alias("ani_uniform"), gated_estimate(num("het"), num("ani_uniform"), loss, hist).alias("ani_gated"), fallback.alias("gate_fallback"),
        F.coalesce("upper", "raw_upper", F.lit(NAN)).alias("ani_upper95"), se.alias("std_err"), num("shape").alias("het_shape"), kept.alias("retention"), loss.alias("ani_from_loss"), hist.alias("ani_from_hist"),
        inconsistent.alias("inconsistent"), (F.isnan(kept) | (kept < MIN_RETENTION)).alias("below_detection"), unreliable.alias("unreliable"),
        F.coalesce("af_query", F.lit(0.0)).alias("af_query"), F.coalesce("af_reference", F.lit(0.0)).alias("af_reference"), count("n_anchors").alias("n_anchors"), count("synteny_blocks").alias("n_chains"), count("n_tags").alias("n_tags"),
        num("enzyme_mean").alias("enzyme_mean"), F.coalesce("enzyme_spread", F.lit(0.0)).alias("enzyme_spread"), num("enzyme_chi2").alias("enzyme_chi2"), count("synteny_blocks").alias("synteny_blocks"), F.coalesce("synteny_score", F.lit(0.0)).alias("synteny_score"),
        count("breakpoint_count").alias("breakpoint_count"), count("unconserved").alias("unconserved"), count("max_block_anchors").alias("max_block_anchors"), F.coalesce("mean_block_anchors", F.lit(0.0)).alias("mean_block_anchors"),
        F.coalesce("per_enzyme", F.array().cast("array<struct<enzyme:string,ani:double,std_err:double,n_tags:bigint>>")).alias("per_enzyme"),
    )
