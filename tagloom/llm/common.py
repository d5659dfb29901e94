"""Helpers that the training-data operators share.

Nothing here decides results; it is reading tables, cutting lineage in the
shared folder, and turning Arrow string columns into words and hashes.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = tempfile.mkdtemp(prefix="tagloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    group_rows: rows of a row group, for rows of megabytes. The writer first looks at
    the size of a group after 100 rows, and readers take whole groups at once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (string): other columns cannot clash with what operators add."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


# --- Arrow and numpy -------------------------------------------------------------------------

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64[n+1], bytes uint8) of a string column; null counts as empty."""
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def lut(keep_ws_only: bool) -> np.ndarray:
    """Byte table: A-Z to a-z; separators to a blank. keep_ws_only: only white space separates, else all ASCII but letters and digits."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("A") : ord("Z") + 1] += 32
    for b in range(128):
        ws = b == 0x20 or 0x09 <= b <= 0x0D
        alnum = 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122
        if ws or (not keep_ws_only and not alnum):
            t[b] = 0x20
    return t


LUT_WS, LUT_ALNUM = lut(True), lut(False)


def split_words(texts: pa.Array, table_: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word offsets by text int64[n+1], word ids int32, distinct words): blank-separated words after the byte table."""
    offsets, raw = text_buffer(texts)
    if table_ is not None:
        raw = table_[raw]
    arr = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(raw)))
    lists = pc.ascii_split_whitespace(arr)
    flat = lists.flatten().dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False)
    words = flat.dictionary
    starts = np.asarray(lists.offsets, dtype=np.int64)
    starts = starts - starts[0]
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if blank.any():
        keep = ~blank[ids]
        seen = np.concatenate(([0], np.cumsum(keep)))
        starts, ids = seen[starts], ids[keep]
    return starts, ids, words


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial in its bytes, then mixed with its length."""
    offsets, raw = text_buffer(words)
    if not len(raw):
        return mix(np.zeros(len(words), np.uint64))
    base = np.uint64(0x5851F42D4C957F2D)
    inv = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(raw) - 1, base, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)))
    inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), inv, np.uint64))))
    s, e = offsets[:-1], offsets[1:]
    return mix((sums[e] - sums[s]) * inverse[s] ^ mix((e - s).astype(np.uint64)))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def bitmap(keys: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """A one-hash Bloom filter of a long column: 2**bits bits, whatever the input (8 MB at 26).

    It only thins out what a scan emits; exact joins follow, so a full filter
    costs speed, never results. The driver gets at most 2**(bits - 6) rows.
    """
    at = f"shiftrightunsigned({column}, {64 - bits})"
    rows = keys.select(F.expr(f"cast(shiftrightunsigned({at}, 6) as int)").alias("word"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    got = rows.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return out


def in_bitmap(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which uint64 hashes have their bit set."""
    bits = int(len(filled)).bit_length() - 1 + 6
    h = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return ((filled[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
