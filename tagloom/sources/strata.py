"""Strata and truth tables (TSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.enzymes import registry


def read_strata(spark: SparkSession, path: str) -> DataFrame:
    """query, reference, enzyme, tag_len, body_len, n_miss, hist (array), d2, d3 and exact_site by the registry."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    s = raw.select("query", "reference", "enzyme", F.col("tag_len").cast("int").alias("tag_len"), F.col("body_len").cast("int").alias("body_len"), F.col("n_miss").cast("long").alias("n_miss"), F.transform(F.split("hist", ","), lambda x: x.cast("long")).alias("hist"))
    geometry = registry(spark).select("enzyme", "exact_site", "d2", "d3")
    # 16 rows; an unknown enzyme has a site of what its body leaves
    return s.join(F.broadcast(geometry), "enzyme", "left").select("query", "reference", "enzyme", "tag_len", "body_len", "n_miss", "hist", F.coalesce("exact_site", F.col("tag_len") - F.col("body_len")).alias("exact_site"), F.coalesce("d2", F.lit(0)).alias("d2"), F.coalesce("d3", F.lit(0)).alias("d3"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """query, reference, truth (percent); rows whose third column is no number (a header) are skipped."""
    raw = spark.read.option("sep", "\t").csv(path)
    return raw.select(F.col("_c0").alias("query"), F.col("_c1").alias("reference"), F.expr("try_cast(_c2 as double)").alias("truth")).where("truth is not null")
