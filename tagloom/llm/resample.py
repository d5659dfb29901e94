"""Target-distribution importance resampling (op13) with a streaming CRC ring.

The features of a text are its runs of one to ``n`` consecutive words; each
falls into the bucket that its CRC-32 says. One scan of a text carries a ring of
zlib states, those of the last n starts: every word extends each of them by a
blank and itself, and what comes out are the buckets, without any feature being
put together. Tasks count buckets (as many rows leave a task as there are
buckets), the counts of target and corpus give every bucket's gain, and a second
scan sums the gains of each text. A text's weight and a Gumbel variate from its
id make its score, so that the highest scores are a sample without replacement
in proportion to exp(weight). The scores are sorted by range, and ranks are row
numbers within the parts after the counts of the parts before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LUT_ALNUM, id_text, slices, table, text_buffer, written
from .sharding import CRC_SQL

BUCKETS, N = 10_000, 3
#: Texts of fewer words are not drawn; of the others so many of a hundred are.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Words that one turn of the ring takes: what bounds its memory, and nothing else.
BLOCK = 1 << 16


def ring_buckets(text: bytes, n: int = N, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to n words of a text that is lower-cased and blank-separated, block by block of words."""
    own = text.split()
    ring: list[list[int]] = [[] for _ in range(n - 1)]  # the last state of each length, from the block before
    for at in range(0, len(own), BLOCK):
        words = own[at : at + BLOCK]
        wider = [b" " + w for w in words]
        states = list(map(crc32, words))
        yield np.array(states, np.uint32) % np.uint32(buckets)
        for k in range(n - 1):
            # the states of length k + 1 one word back, each extended by this word
            before = ring[k] + states[:-1]
            ring[k] = states[-1:]
            states = list(map(crc32, wider[len(wider) - len(before) :], before))
            yield np.array(states, np.uint32) % np.uint32(buckets)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    offsets, raw = text_buffer(batch.column(column))
    raw, at = LUT_ALNUM[raw].tobytes(), offsets.tolist()
    return (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in _texts(batch, 0):
                for found in ring_buckets(text, n, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "count"])

    one = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = one.mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("count").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / raw share)) of each bucket, both with add-one smoothing."""
    b, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the sum of its features' gains, target over corpus.

    A null text has no features and weight 0; null ids and repeated rows count
    each; an empty table gives no rows, an empty target the shares of smoothing.
    """
    base = id_text(docs, id_col, text_col)
    gain = gains(bucket_counts(base, "text", n, buckets), bucket_counts(target, target_col, n, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_features, weight = [], [], []
            for text in _texts(batch, 1):
                sizes, sums = [0], 0
                for found in ring_buckets(text, n, buckets):
                    sizes.append(len(found))
                    sums += int(gain[found].sum())
                n_words.append(sum(sizes[1::n]))
                n_features.append(sum(sizes))
                weight.append(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return base.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n: int = N, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row; the drawn ones have ranks from 1, the rest null.

    Of the rows with ``least_words`` words or more, floor(percent / 100) of
    their number are drawn, those of the highest scores; ties go to the smaller
    id, null last. A null id has the empty text as its decimal. Rows that
    repeat an id have the same noise; where they are equal in all columns,
    which of them has which rank is open. A null text has no features, an empty
    table gives no rows; other columns are not read.
    """
    scored = weigh(docs, target, n, buckets, id_col, text_col, target_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    # copies of one row are told apart, so that a hot id does not make one part
    scored = written(scored.select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("copy")), "scored")
    may = F.col("n_words") >= least_words
    drawn = percent * scored.where(may).count() // 100
    ordered = scored.where(may).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "copy")
    # the number of a row after the sort: its part, and its place there
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    base = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    # a row for each part of the sort
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.withColumn("part", part).join(F.broadcast(base), "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(columns).unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")).select(columns))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TABLE = CRC_SQL.split("crc_b AS")[0].rstrip().rstrip(",")


def _step(state: str, hex_: str) -> str:
    """The state (as zlib gives it) after the bytes of a list of hex pairs."""
    return f"xor(list_reduce([xor({state}, 4294967295)::BIGINT] || list_transform({hex_}, lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b)::BIGINT + 1])), 4294967295)::BIGINT"


#: The ring in SQL: states of distinct words, then of distinct (state, word).
SQL = {
    "op13_importance_resampling": f"""
WITH {_TABLE},
own AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents),
w AS (
  SELECT src, row_id, pos, word FROM (
    SELECT src, row_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (
      SELECT src, row_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
      FROM (SELECT 'd' AS src, row_id, text FROM own UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark)))),
hexes AS MATERIALIZED (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: substr(hex(encode(word)), (2 * i + 1)::INT, 2)) AS h FROM (SELECT DISTINCT word FROM w)),
one AS MATERIALIZED (SELECT word, h, {_step('0', 'h')} AS s FROM hexes, crc_t),
f1 AS MATERIALIZED (SELECT src, row_id, pos, word, s FROM w JOIN one USING (word)),
p2 AS (SELECT b.src, b.row_id, b.pos, b.word, a.s AS s0 FROM f1 a JOIN f1 b ON a.src = b.src AND a.row_id = b.row_id AND a.pos + 1 = b.pos),
two AS MATERIALIZED (SELECT s0, word, {_step('s0', "['20'] || h")} AS s FROM (SELECT DISTINCT s0, word FROM p2) JOIN hexes USING (word), crc_t),
f2 AS MATERIALIZED (SELECT src, row_id, pos, s FROM p2 JOIN two USING (s0, word)),
p3 AS (SELECT b.src, b.row_id, b.pos, b.word, a.s AS s0 FROM f2 a JOIN f1 b ON a.src = b.src AND a.row_id = b.row_id AND a.pos + 1 = b.pos),
three AS MATERIALIZED (SELECT s0, word, {_step('s0', "['20'] || h")} AS s FROM (SELECT DISTINCT s0, word FROM p3) JOIN hexes USING (word), crc_t),
f AS MATERIALIZED (
  SELECT src, row_id, s % 10000 AS bucket FROM f1 UNION ALL SELECT src, row_id, s % 10000 FROM f2
  UNION ALL SELECT p3.src, p3.row_id, three.s % 10000 FROM p3 JOIN three USING (s0, word)),
counts AS (SELECT r.i AS bucket, count(*) FILTER (src = 'd') AS s, count(*) FILTER (src = 'b') AS t FROM range(10000) r(i) LEFT JOIN f ON f.bucket = r.i GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counts),
weights AS (SELECT row_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE src = 'd' GROUP BY 1),
sizes AS (SELECT row_id, count(*) AS n_words FROM w WHERE src = 'd' GROUP BY 1),
d AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM own LEFT JOIN weights USING (row_id) LEFT JOIN sizes USING (row_id)),
scored AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= {PERCENT} * n // 100 THEN r END AS rank, n_words::BIGINT AS n_words
FROM ranked
"""
}
