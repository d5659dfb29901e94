"""Quality rules (op2): hashed n-gram log-likelihood ratio of target and raw multinomials.

Words and word pairs of every text are hashed into ``buckets`` cells. Counting
them over all documents gives the raw multinomial, over the trusted documents
the target multinomial. A text's score is the mean, over its n-grams, of the
log ratio of the two; it is kept from a fixed threshold on. DataFrame functions
only: counting is an explode with map-side partial aggregation (at most
``buckets`` rows leave a task), scoring needs no shuffle, and what is sent to
all tasks is one array of ``buckets`` doubles, of six decimals each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 16
#: Mean log ratio from which a text is kept.
THRESHOLD = -0.15
#: At most so many labelled documents make the target (those with the smallest hash of the id).
TARGET_DOCS = 50_000
SMOOTHING = 1.0


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable holds it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none of a null one."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return let(F.trim(plain), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def repeat_words(h: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more in the text; h: the words' hashes."""

    def covered(x: Column) -> Column:
        pairs = F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda v, k: ((k > 0) & (F.get(s, k - 1)["h"] == v["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == v["h"]))))
        at = F.array_sort(F.transform(twice, lambda v: v["i"]))
        return F.aggregate(at, F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum")), lambda a, v: F.struct(v.alias("last"), (a["sum"] + F.least(F.lit(n), v - a["last"])).alias("sum")), lambda a: a["sum"])

    windows = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n)))
    return F.when(F.size(h) < n + 1, F.lit(0)).otherwise(let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x))))


def features(h: Column, buckets: int = BUCKETS) -> Column:
    """Cells (0 and up; ``buckets`` is a power of two) of all words and all pairs of neighbours; h: the words' hashes."""
    mask = F.lit(buckets - 1).cast("long")
    pairs = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b).bitwiseAND(mask).cast("int"))
    return F.concat(F.transform(h, lambda x: x.bitwiseAND(mask).cast("int")), F.when(F.size(h) > 1, pairs).otherwise(F.array().cast("array<int>")))


def base_columns(text: Column, w: Column, h: Column) -> dict[str, Column]:
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(full) - F.length(F.regexp_replace(full, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(h).cast("long"),
    }


def log_ratios(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS) -> list[float]:
    """The log ratio of each cell, target over raw, both with add-one smoothing. No target at all: all 0."""
    # at most ``target_docs`` ids
    ids = target_ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).withColumn("good", F.lit(1))
    h = docs.join(F.broadcast(ids), "doc_id", "left").select("good", F.explode(F.array(hashes(words(F.col("text"))))).alias("h"))
    cells = h.select("good", F.explode(features(F.col("h"), buckets)).alias("cell"))
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")).collect()  # at most ``buckets`` rows
    raw, good = {r.cell: r.raw for r in counts}, {r.cell: r.good for r in counts}
    n_raw, n_good = sum(raw.values()) + SMOOTHING * buckets, sum(good.values()) + SMOOTHING * buckets
    if not any(good.values()):
        return [0.0] * buckets
    return [math.log((good.get(c, 0) + SMOOTHING) / n_good) - math.log((raw.get(c, 0) + SMOOTHING) / n_raw) for c in range(buckets)]


def score_documents(docs: DataFrame, target_ids: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS, id_col: str = "doc_id", text_col: str = "text", row: list[str] | None = None) -> DataFrame:
    """doc_id, the base columns, base_failed, score (mean log ratio; 0 without words), kept, and ``row`` (a struct of named columns of docs).

    A null or empty text has no words and fails the base rules. Repeated rows
    are scored each on its own, and count as often in the raw corpus; target
    ids that no document has are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[docs[c] for c in row]).alias("row")] if row else []))
    ratios = log_ratios(base.select("doc_id", "text"), target_ids, buckets, target_docs)
    # folded to one literal array when the plan is made
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    # explode and inline keep the optimizer from copying what stands below them into filters and projections above
    d = base.select("*", F.explode(F.array(words(F.col("text")))).alias("w")).select("*", F.explode(F.array(hashes(F.col("w")))).alias("h"))
    mean = let(features(F.col("h"), buckets), lambda c: F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(weights, x)) / F.size(c)))
    columns = base_columns(F.col("text"), F.col("w"), F.col("h")) | {"score": mean}
    d = d.select("doc_id", *(["row"] if row else []), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", *(["row"] if row else []))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids labelled as good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id"))


def op2_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels")))
