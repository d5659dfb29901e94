"""The corpus pipeline: filter, dedupe, decontaminate and pack ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns
the columns of documents, but for the last one, which returns the packed pieces.
Whoever runs the stages writes each one's rows and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import lines, neardup, packing, phrases, quality
from tagloom.llm.common import DOC_COLUMNS, drop_path, scratch, table, written

COLUMNS = list(DOC_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: documents that fail the base rules or score below the threshold go; a null id is judged like any other."""
    scored = quality.score_documents(docs, quality.trusted(table(spark, sf_dir, "labels")), row=COLUMNS)
    return scored.where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 1: repeated line chunks go, and n_chars follows; a document goes only if it loses all its words to that."""
    out = lines.dedup_lines(docs, row=[c for c in COLUMNS if c != "text"])  # the text comes anyway
    text = F.col("text")
    rest = out.where((F.col("n_removed") == 0) | F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return rest.select("row.doc_id", text, "row.lang", "row.source", F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9: of each component one document stays, that with the smallest id; documents without shingles all stay.

    Rows that repeat an id are told apart by their shingle sets, so that texts
    that are not near stay both. Rows without an id stay only where their
    component has no id at all, one row a set. An empty table gives no rows.
    """
    found = written(neardup.jaccard_components(docs), "components")
    # ids that several rows have are looked up by id and set, all others by id
    several = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several-ids")
    gone = found.where("n_shingles > 0 and component_id <> doc_id").select("doc_id").distinct().unionByName(several).distinct()
    rest = docs.select(COLUMNS).where("doc_id is not null").join(gone, "doc_id", "left_anti").select(COLUMNS)
    named = found.where("doc_id is not null").join(several, "doc_id").unionByName(found.where("doc_id is null"))
    stays = named.where("n_shingles > 0 and doc_id <=> component_id").groupBy("root").agg(F.min("fp").alias("fp"), F.first("doc_id", True).alias("id")).select("fp", "id")
    odd = docs.where("doc_id is null").unionByName(docs.join(several, "doc_id", "left_semi").select(docs.columns))
    odd = neardup.fingerprints(odd, row=COLUMNS)
    some = odd.join(stays, (odd.fp == stays.fp) & odd.doc_id.eqNullSafe(stays.id)).groupBy(odd.fp, odd.doc_id).agg(F.min("row").alias("row"))
    return rest.unionByName(some.select("row.*")).unionByName(odd.where("fp = 0").select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: documents that hold a window of a benchmark item go; null and empty texts and rows that repeat an id are judged like any other."""
    found = phrases.ask_index(phrases.build_index(docs), table(spark, sf_dir, "benchmark"))
    return phrases.carried(docs, found.where("n_hit > 0"), COLUMNS, "left_anti").select("row.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: the pieces of all documents, packed; a null text is an empty document, and rows that repeat an id are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sequence_packing", sequence_packing),
]

#: The rolling hashes, the log ratios and the packing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
