"""Result rows, flags, gates, matrices, and calibration."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A linear calibration published with its training set's means and scales.
CALIBRATION = {
    "feature_names": ["ani_gated", "ani_uniform", "af_query", "af_reference", "std_err", "retention", "n_anchors", "n_chains", "n_tags"],
    "means": [92.36771496031746, 93.33044123015873, 0.4909665079365079, 0.4937230555555556, 0.19215074603174603, 0.5339014285714285, 1743.5146825396826, 64.89722222222223, 2739.10873015873],
    "scales": [3.3935360501361718, 3.056290289014556, 0.2577990649752074, 0.26003306101650986, 0.22456690380667504, 0.21211672695735723, 2038.4502527944499, 71.7604933440564, 2865.8854245676293],
    "coefficients": [0.5364348097011009, -0.03440872286576867, 0.5906686154711908, 0.6586466940523814, -0.401155750185357, 2.6277840432830546, 0.18810486394183304, 0.08527586485753277, -0.45951365778095105],
    "intercept": 90.52562011904762,
    "imputer_medians": [92.46465, 93.2929, 0.48015, 0.4737, 0.14035, 0.5125, 1020.0, 42.0, 1745.5],
}


def load_calibration(text: str) -> dict:
    """A calibration from JSON; all its vectors must have the length of its feature names."""
    m = json.loads(text)
    if len({len(m[k]) for k in ("feature_names", "means", "scales", "coefficients", "imputer_medians")}) != 1:
        raise ValueError("the vectors of the calibration differ in length")
    return m


def calibrated(features: Sequence[Column], model: dict | None = None) -> Column:
    """intercept + sum of coefficient * (x - mean) / scale; what is not finite counts as the median, a scale of 0 drops out."""
    m = model or CALIBRATION
    total = F.lit(m["intercept"])
    for x, mean, scale, c, median in zip(features, m["means"], m["scales"], m["coefficients"], m["imputer_medians"], strict=True):
        x = x.cast("double")
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        if scale:
            total = total + c * (F.when(finite, x).otherwise(median) - mean) / scale
    return total


def calibrated_result(model: dict | None = None) -> Column:
    """Calibrated percentage of a result row; NaN where the estimate is not usable."""
    usable = ~F.isnan("ani_uniform") & ~F.col("below_detection") & (F.col("n_chains") > 0) & (F.col("n_anchors") > 0)
    x = [F.col("ani_gated") * 100, F.col("ani_uniform") * 100, F.col("af_query"), F.col("af_reference"), F.col("std_err") * 100, F.col("retention"), F.col("n_anchors"), F.col("n_chains"), F.col("n_tags")]
    return F.when(usable, calibrated(x, model)).otherwise(float("nan"))


def flag(below_detection: Column, unreliable: Column) -> Column:
    return F.when(below_detection, "BELOW_DETECTION").when(unreliable, "INCONSISTENT").otherwise("ok")


def gate_name(ani_gated: Column, fallback: Column, shape: Column) -> Column:
    """none / uniform_fallback / gamma (a finite shape) / uniform."""
    return F.when(ani_gated.isNull() | F.isnan(ani_gated), "none").when(fallback, "uniform_fallback").when(~F.isnan(shape) & (shape < float("inf")), "gamma").otherwise("uniform")


def gated_estimate(het: Column, uniform: Column, loss: Column, hist: Column) -> Column:
    """het, or uniform where loss and histogram (both finite) are more than 0.05 apart."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite(loss) & finite(hist) & (F.abs(loss - hist) > 0.05 + 1e-12), uniform).otherwise(het)


def ani_rows(results: DataFrame, calibrate: bool = False, verbose: bool = False, model: dict | None = None) -> DataFrame:
    """The output columns, identities in percent."""
    pct = lambda c, n=4: F.round(F.col(c) * 100, n)
    cols = [F.col("query"), F.col("reference"), pct("ani_het").alias("ani"), pct("ani_uniform").alias("ani_uniform"), F.round("af_query", 4).alias("af_query"), F.round("af_reference", 4).alias("af_reference"), pct("std_err").alias("std_err")]
    if calibrate:
        cols.append(F.round(calibrated_result(model), 4).alias("ani_cal"))
    cols += [F.col("synteny_blocks"), F.round("synteny_score", 4).alias("synteny_score"), F.col("breakpoint_count")]
    if verbose:
        cols += [F.round("het_shape", 4).alias("het_shape"), F.round("retention", 4).alias("retention"), pct("ani_from_loss").alias("ani_from_loss"), pct("ani_from_hist").alias("ani_from_hist"), pct("enzyme_spread").alias("enzyme_spread"), F.round("enzyme_chi2", 3).alias("enzyme_chi2"), F.col("n_anchors"), F.col("n_chains"), F.col("n_tags"), F.col("max_block_anchors"), F.round("mean_block_anchors", 2).alias("mean_block_anchors")]
    cols += [pct("ani_gated").alias("ani_gated"), gate_name(F.col("ani_gated"), F.col("gate_fallback"), F.col("het_shape")).alias("gate"), pct("ani_upper95").alias("ani_upper95"), flag(F.col("below_detection"), F.col("unreliable")).alias("flag")]
    return results.select(*cols)


def edges(rows: DataFrame, value: str = "ani_gated") -> DataFrame:
    """Pairs whose value is finite."""
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select("query", "reference", value)


def matrix(rows: DataFrame, genomes: list[str], value: str = "ani_gated", diagonal: float = 100.0) -> DataFrame:
    """The symmetric matrix, one row and one column a genome; NaN where no pair was refined."""
    half = edges(rows, value).select(F.col("query").alias("a"), F.col("reference").alias("b"), F.col(value).alias("v"))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    known = rows.sparkSession.createDataFrame([(g, g, diagonal) for g in genomes], "a string, b string, v double")
    rows_ = both.where(F.col("a") != F.col("b")).unionByName(known)
    return rows_.groupBy(F.col("a").alias("genome")).agg(*[F.coalesce(F.max(F.when(F.col("b") == F.lit(g), F.col("v"))), F.lit(float("nan"))).alias(g) for g in genomes])



def best_first(rows: DataFrame, min_ani: float = 0.8) -> DataFrame:
    """Search hits: finite and at least ``min_ani`` (a fraction), with their rank by query."""
    hits = rows.where(~F.isnan("ani_gated") & (F.col("ani_gated") >= 100 * min_ani))
    return hits.withColumn("hit", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ani_gated"), "reference")))


def strata_rows(strata: DataFrame) -> DataFrame:
    """query, reference, enzyme, tag_len, body_len, n_miss, hist (comma list)."""
    return strata.select("query", "reference", "enzyme", "tag_len", "body_len", "n_miss", F.array_join(F.transform("hist", lambda x: x.cast("string")), ",").alias("hist"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def predict_trees(df: DataFrame, features: list[str], trees: list[list[dict]], init: float, rate: float, bias: float = 0.0, clamp: bool = True) -> DataFrame:
    """Gradient-boosted trees over a user's node tables: nodes are {feature, threshold, left, right} or {value}; x <= threshold goes left."""

    def walk(nodes: list[dict], k: int) -> Column:
        n = nodes[k]
        if "value" in n:
            return F.lit(float(n["value"]))
        return F.when(F.col(features[n["feature"]]) <= n["threshold"], walk(nodes, n["left"])).otherwise(walk(nodes, n["right"]))

    total = F.lit(init)
    for t in trees:
        total = total + rate * walk(t, 0)
    total = total + bias
    return df.withColumn("prediction", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)) if clamp else total)


def read_trees(spark: SparkSession, path: str) -> dict:
    """A tree ensemble from JSON: {meta: {init_value, learning_rate, feature_names, ..}, trees: [{nodes: [{type: split, feature, threshold, left, right} or {type: leaf, value}]}]}.

    One model is one small file, read whole; fields missing or nodes of another type are an error.
    """
    model = json.loads(spark.read.text(path, wholetext=True).first()[0])
    for key in ("init_value", "learning_rate", "feature_names"):
        if key not in model["meta"]:
            raise ValueError(f"the model has no {key}")
    for node in (n for t in model["trees"] for n in t["nodes"]):
        if node["type"] not in ("leaf", "split"):
            raise ValueError(f"unknown node type: {node['type']}")
    return model


def predict_model(df: DataFrame, model: dict, features: list[str] | None = None) -> DataFrame:
    """``prediction``, unclamped, from the columns ``features`` (the model's own names by default) in the model's order."""
    meta = model["meta"]
    return predict_trees(df, features or meta["feature_names"], [t["nodes"] for t in model["trees"]], meta["init_value"], meta["learning_rate"], clamp=False)


#: The features that each version of a runtime model takes, in order; all but v2 predict what the raw identity lacks.
RUNTIME = {
    "v2": ["raw_ani", "af_query", "af_reference", "shared_tags", "containment", "1 - raw_ani", "0.5"],
    "v3_6": ["raw_ani", "af_query", "af_reference", "0.0"],
    "v4": ["raw_ani", "ln(1 + shared_tags)", "af_query", "af_reference"],
    "v7": ["raw_ani", "mash_ani", "chained_kmer_ani", "ln(1 + shared_tags)", "af_query", "af_reference"],
}


def predict_runtime(df: DataFrame, model: dict, version: str) -> DataFrame:
    """``prediction`` of a runtime model over the columns that ``RUNTIME`` names; v2 as it comes, the others added to raw_ani and kept within 0 and 1."""
    names = [f"_feature{k}" for k in range(len(RUNTIME[version]))]
    d = df.select("*", *[F.expr(f"cast({x} AS double)").alias(n) for x, n in zip(RUNTIME[version], names)])
    d = predict_model(d, model, names).drop(*names)
    return d if version == "v2" else d.withColumn("prediction", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw_ani") + F.col("prediction"))))


def debias(raw: Column, af_min: Column, quadratic: bool = False) -> Column:
    """raw (percent) raised by 2 % of what it lacks, more so where little aligns; with a quadratic term on request."""
    gap = 100 - raw
    out = raw + 0.02 * gap * (1 - af_min)
    return out + 1e-4 * gap * gap * (1 - af_min) if quadratic else out

