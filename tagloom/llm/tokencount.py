"""Token counts (op12) by a digest cache.

A text's key is the SHA-256 of its normalised content; the cache is a Parquet
folder of (version, digest, n_tokens), where the version is a digest of the
tokenizer's file, its library's release and the rule of normalising. One scan
gives every row its digest; digests are joined to the stored counts; distinct
misses are encoded once and appended; the counts come from the cache.

Texts are not shuffled where that can be helped. Two filters of a fixed size
say of a row whether its digest may be a miss, and whether it may be a hit or
stand in another row as well. What the first has and the second has not is a
miss that stands alone, and is encoded where it is read. Only the rest (copies,
and what the filters confuse) is dealt out by digest, each task sending a
digest once, and there an exact join decides.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, drop_path, id_text, in_bitmap, scratch, slices, table, text_buffer, written
from .packing import WordTokenizer, tokenizer_path

OVER_LIMIT = 2048
#: Of a table's rows, a digest that holds this share is joined by broadcast: there are 1 / HOT of them at most.
HOT = 0.001
CACHE_SCHEMA = "version string, digest binary, n_tokens long"
_SPECIAL = b"<|"


def drops_space_and_case(path: str) -> bool:
    """Whether a tokenizer lower-cases, turns white space into one blank and then drops it, so that texts which differ in these alone have one count."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = (said.get("normalizer") or {}).get("normalizers", [])
    blank = any(s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    return blank and any(s["type"] == "Lowercase" for s in steps) and bool(said["model"].get("end_of_word_suffix"))


def normalised(text: bytes, fold: bool) -> bytes:
    """What the digest is taken of: with ``fold``, ASCII white space as one blank and A-Z lower-cased (but where special tokens may stand, whose case counts)."""
    if not fold:
        return text
    text = b" ".join(text.split())
    return text if _SPECIAL in text else text.lower()


def version(path: str) -> str:
    """The digest of a tokenizer's file, its library's release and the rule of normalising."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        own = hashlib.sha256(f.read())
    own.update(f"{library} {importlib.metadata.version(library)} {drops_space_and_case(path)}".encode())
    return own.hexdigest()


def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """The counts of a column of texts, as the library gives them; none of null or empty ones."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(pieces.encode(t or "", num_threads=1)) for t in texts.to_pylist()], np.int64)
    if drops_space_and_case(path):
        words = WordTokenizer(path)  # word by word: a long text takes no more memory than its words

        def count(texts: pa.Array) -> np.ndarray:
            parts = [np.diff(starts) - 1 for _, starts, _ in words(texts)]  # without the end id
            return np.concatenate(parts) if parts else np.zeros(0, np.int64)

        return count
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: np.array([len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()], np.int64)


def _digests(batch: pa.RecordBatch, fold: bool) -> tuple[np.ndarray, list[bytes]]:
    """(UTF-8 bytes, digest) of the texts in column 1; null counts as empty."""
    offsets, raw = text_buffer(batch.column(1))
    raw, at = raw.tobytes(), offsets.tolist()
    return np.diff(offsets), [hashlib.sha256(normalised(raw[a:b], fold)).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def _heads(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)


def stored_counts(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """digest, n_tokens of one version, a row a digest even where two runs appended the same at once; none if the cache is new."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("version") == of).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of docs; ``cache`` is a folder that all executors see, made if it is not there.

    No begin, end or added special tokens, no truncation or padding; special
    strings inside texts as the library takes them by default. A null text
    counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows keep each
    their row; equal texts are encoded once, in this call or an earlier one;
    an empty table gives no rows and leaves the cache alone; other columns are
    not read. The tokenizer's file must lie at ``path`` on every machine.
    """
    path = path or tokenizer_path()
    spark, own, fold = docs.sparkSession, version(path), drops_space_and_case(path)
    base = id_text(docs, id_col, text_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, found = _digests(batch, fold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(_heads(found))], ["doc_id", "n_bytes", "digest", "head"])

    keyed = written(base.mapInArrow(digest, "doc_id long, n_bytes long, digest binary, head long"), "digests")
    distinct = keyed.groupBy("digest").agg(F.first("head").alias("head"), F.count(F.lit(1)).alias("n"))
    distinct = written(distinct.join(stored_counts(spark, cache, own), "digest", "left").select("digest", "head", "n", F.col("n_tokens").isNotNull().alias("hit")), "distinct")
    if not distinct.where("not hit").isEmpty():
        _append(base, distinct, cache, path, own, fold)
    rows = distinct.agg(F.sum("n")).first()[0] or 0
    known = stored_counts(spark, cache, own)
    # digests of many rows: at most 1 / HOT of them
    hot = F.broadcast(distinct.where(F.col("n") >= max(HOT * rows, 2)).select("digest").join(known, "digest"))
    wide = keyed.select("doc_id", "n_bytes", "digest")
    out = wide.join(hot, "digest").unionByName(wide.join(hot.drop("n_tokens"), "digest", "left_anti").join(known, "digest"))
    return out.select("doc_id", "n_bytes", "n_tokens")


def _append(base: DataFrame, distinct: DataFrame, cache: str, path: str, own: str, fold: bool) -> None:
    """Encode the missing digests' texts once each and append their counts to the cache."""
    spark = base.sparkSession
    misses = distinct.where("not hit")
    missing = bitmap(misses, "head")
    unsure = bitmap(distinct.where("hit or n > 1"), "head")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sent = counter(path), set()
        for batch in slices(batches):
            _, found = _digests(batch, fold)
            heads = _heads(found)
            may = in_bitmap(missing, heads)
            alone = np.flatnonzero(may & ~in_bitmap(unsure, heads))
            counts = count(batch.column(1).take(pa.array(alone)))
            yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in alone.tolist()], pa.binary()), pa.array(counts, pa.int64()), pa.nulls(len(alone), pa.string())], ["digest", "n_tokens", "text"])
            rest = []
            for i in np.setdiff1d(np.flatnonzero(may), alone).tolist():
                if found[i] not in sent:  # a digest leaves a task once
                    sent.add(found[i])
                    rest.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in rest], pa.binary()), pa.nulls(len(rest), pa.int64()), batch.column(1).take(pa.array(rest, pa.int64())).cast(pa.string())], ["digest", "n_tokens", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1)), pa.int64())], ["digest", "n_tokens"])

    read = scratch(spark, "scanned")
    base.mapInArrow(scan, "digest binary, n_tokens long, text string").write.parquet(read)
    scanned = spark.read.schema("digest binary, n_tokens long, text string").parquet(read)
    # what the first filter let through by chance is a hit, which the second has and the join drops
    alone = scanned.where("n_tokens is not null").select("digest", "n_tokens")
    several = scanned.where("n_tokens is null").select("digest", F.coalesce("text", F.lit("")).alias("text"))
    several = several.join(misses.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    counted = alone.unionByName(several.mapInArrow(encode, "digest binary, n_tokens long"))
    counted.select(F.lit(own).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    drop_path(spark, read)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that a call never leans on an earlier one."""
    out = count_tokens(table(spark, sf_dir, "documents"), scratch(spark, "token-counts"))
    return out.select("*", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit"))
