"""The screen: an inverted index of centred tag windows, shared counts and a containment gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.sequence import screen_key
from tagloom.operators.postings import shared_counts
from tagloom.sources.scratch import stored

WINDOW, MIN_SHARED, MIN_CONTAINMENT = 18, 3, 0.001
#: Lists that the members of a class of equal key sets are dealt into.
LISTS = 128


def screen_keys(tags: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct genome_id, enzyme, key."""
    return tags.select("genome_id", "enzyme", screen_key(F.col("tag"), window).alias("key")).distinct()


def approx_ani(shared: Column, total: Column, window: int = WINDOW) -> Column:
    return F.when(total > 0, F.pow(shared / total, F.lit(1.0 / window))).otherwise(0.0)


def screen_pairs(keys: DataFrame, other: DataFrame | None = None, window: int = WINDOW, min_shared: int = MIN_SHARED, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """query, reference, shared, min_total, containment, approx_ani, verdict of all pairs that share a key.

    Only pairs with a common key arise (the gate needs three), never the cross
    product, and a key that many genomes hold makes no row for each pair of them
    (``postings``). min_total sums the smaller key count of each enzyme both
    genomes have. Without ``other``, all unordered pairs of ``keys``. Both are
    read several times, so they should be stored tables.
    """
    ref = keys if other is None else other
    shared = stored(shared_counts(keys, "genome_id", ["enzyme", "key"], other), "shared")
    size = lambda k, name: k.groupBy(F.col("genome_id").alias(name), "enzyme").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    total = shared.select("query", "reference").join(size(keys, "query"), "query").join(size(ref, "reference"), ["reference", "enzyme"]).groupBy("query", "reference").agg(F.sum(F.least("n_query", "n_reference")).alias("min_total"))
    out = shared.join(total, ["query", "reference"]).withColumn("containment", F.col("shared") / F.col("min_total")).withColumn("approx_ani", approx_ani(F.col("shared"), F.col("min_total"), window))
    return out.withColumn("verdict", gate(F.col("shared"), F.col("min_total"), min_shared, min_containment))


def passing_pairs(keys: DataFrame, min_shared: int = MIN_SHARED, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """query, reference, shared, min_total of the pairs of ``screen_pairs`` that pass, for many small genomes.

    Genomes of equal key sets are one class, and pairs are found between classes. Two sets that
    share ``min_shared`` keys also share one after each has lost its ``min_shared`` - 1 most
    frequent ones, so a key that many genomes hold makes pairs only of those that hold more
    frequent ones beside it; what a pair shares is counted over its whole sets. Members of passing
    classes are paired last, list by list, so that a large class is no task of its own. ``keys`` is
    read twice and should be a stored table; null genomes are in no pair.
    """
    spark = keys.sparkSession
    needed = max(min_shared, 1)
    kinds = stored(keys.groupBy("enzyme", "key").agg(F.count(F.lit(1)).alias("held")).withColumn("id", F.monotonically_increasing_id()), "kinds")
    own = keys.where("genome_id is not null").join(kinds, ["enzyme", "key"]).groupBy("genome_id", "enzyme").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("held", "id")).alias("ids"))
    own = own.groupBy("genome_id").agg(F.map_from_entries(F.collect_list(F.struct("enzyme", "n"))).alias("sizes"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    own = own.where(F.size("ids") >= needed).select("genome_id", "sizes", F.col("ids.id").alias("ids")).withColumn("class", F.sha2(F.array_join("ids", ","), 256))
    own = stored(own, "sets")
    classes = stored(own.groupBy("class").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("members")), "classes")

    rarest = classes.select("class", F.explode(F.slice("ids", F.lit(1), F.size("ids") - (needed - 1))).alias("id"))
    side = lambda x: classes.select(F.col("class").alias(x), F.col("ids").alias(f"{x}_ids"), F.col("sizes").alias(f"{x}_sizes"))
    met = shared_counts(rarest, "class", ["id"]).select(F.col("query").alias("a"), F.col("reference").alias("b")).join(side("a"), "a").join(side("b"), "b")
    least = F.transform(F.map_entries("a_sizes"), lambda e: F.least(e.value, F.coalesce(F.try_element_at("b_sizes", e.key), F.lit(0))))
    met = met.select("a", "b", F.size(F.array_intersect("a_ids", "b_ids")).cast("long").alias("shared"), F.aggregate(least, F.lit(0).cast("long"), lambda x, y: x + y).alias("min_total"))
    n = F.size("ids").cast("long")
    alike = classes.where("members > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), n.alias("shared"), n.alias("min_total"))
    passing = met.unionByName(alike).where(gate(F.col("shared"), F.col("min_total"), min_shared, min_containment) == "pass")

    lists = stored(own.groupBy("class", F.pmod(F.xxhash64("genome_id"), F.lit(LISTS)).alias("nth")).agg(F.collect_list("genome_id").alias("l")), "members")
    of = lambda x: lists.withColumnsRenamed({"class": x, "nth": f"{x}_nth", "l": f"{x}_l"})
    cells = passing.join(of("a"), "a").join(of("b"), "b").where("a <> b or a_nth <= b_nth")
    cells = cells.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "a", "a_nth", "b", "b_nth")
    pairs = cells.select("*", F.explode("a_l").alias("x")).select("*", F.explode("b_l").alias("y")).where("a <> b or a_nth < b_nth or x < y")
    return pairs.select(F.least("x", "y").alias("query"), F.greatest("x", "y").alias("reference"), "shared", "min_total")


def gate(shared: Column, total: Column, min_shared: int = MIN_SHARED, min_containment: float = MIN_CONTAINMENT) -> Column:
    return F.when((shared >= min_shared) & (total > 0) & (shared >= min_containment * total), "pass").otherwise("fail")
