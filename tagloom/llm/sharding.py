"""Sharding (op3): contiguous shards of near-equal bytes from global prefix sums.

Equal rows are counted first (map-side), and the counted rows are ordered by id.
Splitters (ids at approximate quantiles, and more of them inside every range
where the table is large) cut that order into ranges; each range is summed, the
totals are prefix-summed in one small window, and a window inside every range
adds the rest. A row's global byte prefix, cut at equal targets, gives its
shard. Only ids, sizes and checksums are shuffled, never texts. An id that many
rows have is a range of its own, split by size and checksum; rows that are equal
in all three are one counted row until the end, when they are dealt out in
chunks. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, table, written

OVERHEAD = 16
KEYS = ("doc_id", "size", "text_crc32")
#: Equal rows that are dealt out together.
CHUNK = 65_536


def assign_shards(docs: DataFrame, shards: int = 40, ranges: int = 256, rows_a_range: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    Size is the text's UTF-8 bytes plus 16; a null text has none and checksum 0.
    A row whose prefix (bytes of the rows before it) is p of T goes to shard
    floor(p * shards / T), so shard sizes differ by less than the largest rows
    at their two ends. Order: id (null first), then size, then checksum; equal
    rows are interchangeable. An empty table gives no rows. There are up to
    ``ranges`` squared ranges, as many as give each about ``rows_a_range`` rows;
    their number changes no result.
    """
    d = id_text(docs, id_col, text_col)
    sized = d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    sized = written(sized.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), "sizes")
    found = sized.agg(F.percentile_approx("doc_id", _shares(ranges), 20 * ranges), F.count(F.lit(1))).first()
    cuts = sorted(set(found[0] or []))
    inner = min(ranges, found[1] // (ranges * rows_a_range) + 1)
    # the splitters are few (``ranges``): a row's range is even between two of them, odd for the id of one, -1 for none
    sized = sized.withColumn("rng", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(2 * _bisect(cuts) + (F.col("doc_id").isin(cuts)).cast("int")))
    one_id = F.col("rng") % 2 != 0
    sized = sized.withColumn("within", F.when(one_id, F.shiftleft("size", 32).bitwiseOR(F.col("text_crc32"))).otherwise(F.col("doc_id")))
    if inner > 1:
        # at most 2 * ``ranges`` + 2 rows of fewer than ``ranges`` numbers
        finer = F.broadcast(sized.groupBy("rng").agg(F.percentile_approx("within", _shares(inner), 4 * inner).alias("finer")))
        sized = sized.join(finer, "rng").withColumn("sub", F.size(F.filter("finer", lambda x: x < F.col("within")))).drop("finer")
    else:
        sized = sized.withColumn("sub", F.lit(0))
    bytes_ = F.col("n") * F.col("size")
    totals = sized.groupBy("rng", "sub").agg(F.sum(bytes_).alias("total"))
    before = totals.select("rng", "sub", (F.sum("total").over(Window.orderBy("rng", "sub")) - F.col("total")).alias("base"), F.sum("total").over(Window.partitionBy()).alias("whole"))
    inside = Window.partitionBy("rng", "sub").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("prefix", F.sum(bytes_).over(inside) - bytes_).withColumn("nth", F.sum("n").over(inside) - F.col("n"))
    # equal rows: chunks of them are dealt out, then each is a row again
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).repartition(*KEYS, "chunk")
    placed = placed.withColumn("i", F.explode(F.sequence(F.col("chunk"), F.least(F.col("chunk") + CHUNK, F.col("n")) - 1)))
    placed = placed.withColumn("nth", F.col("nth") + F.col("i"))
    # a row for each range
    placed = placed.join(F.broadcast(before), ["rng", "sub"]).withColumn("prefix", F.col("base") + F.col("prefix") + F.col("i") * F.col("size"))
    cut = F.expr(f"cast(least({shards - 1}, (prefix * {shards}) div whole) as int)")
    placed = placed.withColumn("shard", cut)
    # slots: rows of a shard in earlier ranges, from counts by (range, shard), plus the position in this range
    counts = placed.groupBy("rng", "sub", "shard").agg(F.count(F.lit(1)).alias("rows"), F.min("nth").alias("first"))
    starts = counts.select("rng", "sub", "shard", "first", (F.sum("rows").over(Window.partitionBy("shard").orderBy("rng", "sub")) - F.col("rows")).alias("earlier"))
    # at most a row for each range and each shard
    return placed.join(F.broadcast(starts), ["rng", "sub", "shard"]).select(*KEYS, "shard", (F.col("earlier") + F.col("nth") - F.col("first")).alias("slot"))


def _shares(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)]


def _bisect(cuts: list[int]):
    """How many of the sorted cuts lie below doc_id, by nested halving (log2 comparisons a row)."""

    def go(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") > F.lit(cuts[mid]), go(mid + 1, hi)).otherwise(go(lo, mid))

    return go(0, len(cuts))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by its polynomial, byte by byte; the table comes from the rule.
CRC_SQL = """
crc_t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: k), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
crc_b AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ',') AS h FROM documents),
crc AS (
  SELECT doc_id, size, xor(list_reduce([4294967295::BIGINT] || list_transform(h[1:len(h) - 1], lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b)::BIGINT + 1])), 4294967295)::BIGINT AS text_crc32
  FROM crc_b, crc_t)
"""

SQL = {
    "op3_sharding": f"""
WITH {CRC_SQL},
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS prefix, sum(size) OVER () AS whole FROM crc),
cut AS (SELECT *, least(39, prefix * 40 // whole)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""
}
