"""Shared keys of set pairs from posting lists in cells, counted by block products.

The sets are numbered in blocks of about ``BLOCK``; a key's posting list is cut
into one list of numbers a block, so a key that all of G sets hold is G / BLOCK
short rows. Rows of two blocks that hold a key make a cell row, of which a key has
at most (G / BLOCK)^2 / 2: never a row for each pair of sets. A task takes the cell
rows of its cells, turns the lists of some thousand keys into two 0-1 matrices and
adds their product to the cell's counts, which leave the task once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.sources.scratch import stored

BLOCK = 512
#: Parts of the keys that a cell is spread over, keys of one product, and cells that a task holds before it hands counts on.
SLICES, KEYS, CELLS = 8, 2048, 32
#: Pairs of one key in a cell that leave as they are, without a matrix.
FEW = 64


def numbered(names: DataFrame, block: int = BLOCK) -> DataFrame:
    """name, blk, idx of distinct names: blocks by hash, numbers from 0 within a block."""
    blocks = max(1, -(-names.count() // block))
    b = names.withColumn("blk", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    return b.withColumn("idx", (F.row_number().over(Window.partitionBy("blk").orderBy("name")) - 1).cast("int"))


def lists(rows: DataFrame, name: str, keys: list[str], ids: DataFrame) -> DataFrame:
    """keys, blk, l: the numbers of a block's sets that hold a key. rows (name, keys): no row twice."""
    n = rows.join(ids.withColumnRenamed("name", name), name)
    return n.groupBy(*keys, "blk").agg(F.collect_list("idx").alias("l"))


def cells(left: DataFrame, right: DataFrame | None, keys: list[str], blocks: int | None = None) -> DataFrame:
    """a, b, x, y and the keys' slice: two blocks' lists of one key. Without ``right`` each two blocks of ``left`` once, a block with itself where it holds two sets of the key; of a single block (``blocks``) no two meet."""
    l = left.withColumnsRenamed({"blk": "a", "l": "x"})
    if right is None:
        j = l.where(F.size("x") > 1).select(*keys, "a", "x", F.col("a").alias("b"), F.col("x").alias("y"))
        if blocks != 1:
            j = j.unionByName(l.join(left.withColumnsRenamed({"blk": "b", "l": "y"}), keys).where("a < b").select(*keys, "a", "x", "b", "y"))
    else:
        j = l.join(right.withColumnsRenamed({"blk": "b", "l": "y"}), keys)
    return j.select("a", "b", F.pmod(F.xxhash64(*keys), F.lit(SLICES)).alias("slice"), "x", "y")


def _matrix(values: pa.ListArray, width: int) -> np.ndarray:
    starts = np.asarray(values.offsets, np.int64)
    out = np.zeros((len(values), width), np.float32)
    out[np.repeat(np.arange(len(values)), np.diff(starts)), values.values.to_numpy()[starts[0] : starts[-1]]] = 1
    return out


def counted(cell_rows: DataFrame) -> DataFrame:
    """a, i, b, j, n: how many keys set i of block a shares with set j of block b."""

    names = ["a", "i", "b", "j", "n"]

    def flush(counts: dict) -> Iterator[pa.RecordBatch]:
        for (a, b), c in counts.items():
            i, j = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (np.full(len(i), a), i, np.full(len(i), b), j, c[i, j])], names)
        counts.clear()

    def few(batch: pa.RecordBatch, sizes: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        """The pairs of short lists as they are, of all cells at once."""
        some = batch.take(pa.array(rows))
        n, wide = np.prod(sizes[:, rows], axis=0), sizes[1, rows]
        of = np.repeat(np.arange(len(rows)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        first = [np.cumsum(sizes[k, rows]) - sizes[k, rows] for k in (0, 1)]
        x, y = (some.column(k).flatten().to_numpy() for k in (2, 3))
        a, b = (some.column(k).to_numpy()[of] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (a, x[first[0][of] + nth // wide[of]], b, y[first[1][of] + nth % wide[of]], np.ones(len(of)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            sizes = np.stack([pc.list_value_length(batch.column(k)).to_numpy().astype(np.int64) for k in (2, 3)])
            short = np.prod(sizes, axis=0) <= FEW
            if short.any():
                yield few(batch, sizes, np.flatnonzero(short))
            long = np.flatnonzero(~short)
            for at in np.unique(np.stack((a[long], b[long])), axis=1).T.tolist():
                rows = long[(a[long] == at[0]) & (b[long] == at[1])]
                for k in range(0, len(rows), KEYS):
                    x, y = (batch.column(c).take(pa.array(rows[k : k + KEYS])) for c in (2, 3))
                    x, y = (v.cast(pa.list_(pa.int32())) for v in (x, y))
                    wide = [int(v.flatten().to_numpy().max(initial=-1)) + 1 for v in (x, y)]
                    old = counts.get(tuple(at), np.zeros((0, 0), np.int64))
                    size = tuple(max(w, o) for w, o in zip(wide, old.shape))
                    new = np.zeros(size, np.int64)
                    new[: old.shape[0], : old.shape[1]] = old
                    new += np.rint(_matrix(x, size[0]).T @ _matrix(y, size[1])).astype(np.int64)
                    counts[tuple(at)] = new
                # a batch may hold thousands of cells
                if len(counts) > CELLS:
                    yield from flush(counts)
        yield from flush(counts)

    return cell_rows.select("a", "b", "x", "y").mapInArrow(run, "a long, i long, b long, j long, n long")


def shared_places(bins: DataFrame, sets: int, size: int) -> DataFrame:
    """i, j, n: the places that sets i and j share (i < j), and those of each set (i = j).

    bins (bin, number, low, high): some distinct places of set ``number``, 0 to ``sets`` - 1, in a bin
    of ``size`` places, as ``kmer_bins`` has them; rows may repeat each other's. A task takes its bins in order, marks the
    sets of one bin's places in bits, and adds the products of some thousand places to its counts,
    which leave it once. For up to ``BLOCK`` sets.
    """
    spark = bins.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((sets, sets), np.int64)
        marks, now = np.zeros((-(-sets // 64), size), "<u8"), None

        def close() -> None:
            hit = np.flatnonzero(marks.any(axis=0))
            for k in range(0, len(hit), 8 * KEYS):
                held = np.ascontiguousarray(marks[:, hit[k : k + 8 * KEYS]].T).view(np.uint8)
                held = np.unpackbits(held, axis=1, count=sets, bitorder="little").astype(np.float32)
                counts[:] += np.rint(held.T @ held).astype(np.int64)
            marks[:] = 0

        for batch in batches:
            at, number = (batch.column(c).to_pylist() for c in (0, 1))
            high = batch.column(3).cast(pa.large_binary())
            ends = np.frombuffer(high.buffers()[1], np.int64)[high.offset : high.offset + len(high) + 1]
            low, high = (b"".join(batch.column(c).to_pylist()) for c in (2, 3))
            places = np.frombuffer(low, "<u2") | np.frombuffer(high, np.uint8).astype(np.int32) << 16
            ends = (ends - ends[0]).tolist()
            for r, (b, n) in enumerate(zip(at, number)):
                if b != now:
                    close()
                    now = b
                marks[n >> 6, places[ends[r] : ends[r + 1]]] |= np.uint64(1 << (n & 63))
        close()
        i, j = np.nonzero(np.triu(counts))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (i, j, counts[i, j])], ["i", "j", "n"])

    dealt = bins.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "bin").sortWithinPartitions("bin")
    return dealt.mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def shared_counts(rows: DataFrame, name: str, keys: list[str], other: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """query, reference, shared: keys that two sets share, of all pairs that share one.

    rows and other: name, keys, no row twice. Without ``other`` unordered pairs, query < reference;
    with it every set of rows against every set of other. Null keys are shared with nothing;
    rows without a name are left out; without rows there are no pairs.
    """
    spark = rows.sparkSession
    whole = lambda df: df.select(name, *keys).na.drop()
    mine = whole(rows)
    names = mine.select(F.col(name).alias("name"))
    if other is not None:
        other = whole(other)
        names = names.unionByName(other.select(F.col(name).alias("name")))
    ids = stored(numbered(stored(names.distinct(), "names"), block), "ids")
    left = stored(lists(mine, name, keys, ids), "lists")
    found = cells(left, None if other is None else lists(other, name, keys, ids), keys, (ids.agg(F.max("blk")).first()[0] or 0) + 1)
    found = found.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "a", "b", "slice").sortWithinPartitions("a", "b")
    total = counted(found).groupBy("a", "i", "b", "j").agg(F.sum("n").alias("shared"))
    if other is None:
        total = total.where("a <> b or i < j")
    of = lambda blk, idx, as_: ids.select(F.col("blk").cast("long").alias(blk), F.col("idx").cast("long").alias(idx), F.col("name").alias(as_))
    named = total.join(of("a", "i", "query"), ["a", "i"]).join(of("b", "j", "reference"), ["b", "j"])
    if other is None:
        return named.select(F.least("query", "reference").alias("query"), F.greatest("query", "reference").alias("reference"), "shared")
    return named.select("query", "reference", "shared")
