"""Benchmark decontamination (op10): a distributed positional inverted index.

``build_index`` stores the postings of all training tokens: a row a slice of
documents, with its terms and each term's sorted word positions, so that the index
is partitioned by document and no posting is shuffled. It can be kept and asked
again with other test sets.

The test windows are the stated query set; they come in blocks of a bounded number
of words, one broadcast a block, and each block reads the stored index only. In a
slice all windows whose terms are there start from the postings of their rarest
term (the shortest list of that slice), shifted by the term's place in the window,
and keep the starts at which the next rarer term stands in its place, and so on:
the intersection of offset-adjusted lists, for all windows at once. What remains
after all terms are exact occurrences. With ``slop`` > 0 a term may lie up to that
many words from its place, which gives proximity matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LUT_ALNUM, slices, split_words, table, written

WINDOW = 10
#: Words by which a term of a proximity match may be off its place.
SLOP = 1
#: Words of test items in one block, hence in one broadcast.
BLOCK_WORDS = 2_000_000
#: Rows of the index (some megabytes each) that a writer or reader holds at once.
GROUP_ROWS = 4
#: Starts that are looked at at once.
STARTS = 1_000_000

INDEX = "doc_ids array<long>, hashes array<long>, starts array<long>, terms array<string>, ends array<int>, places array<int>"
_INDEX = [x.split()[0] for x in INDEX.split(", ")]
_FOUND = "doc_id long, hash long, n_words long, n_hit long, items array<string>, near array<string>, hit binary"


class Windows:
    """A block of test items: distinct windows by their length, as rows of term numbers, and which items have each."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        starts, ids, words = split_words(pa.array([t for _, t in items], pa.string()), LUT_ALNUM)
        self.terms = words.cast(pa.string())
        self.items = [i for i, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for k in range(len(items)):
            own = ids[starts[k] : starts[k + 1]].tolist()
            for s in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[s : s + window]), set()).add(k)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in found:
            by_length.setdefault(len(w), []).append(w)
        self.groups = [(np.array(w, np.int64), [sorted(found[x]) for x in w]) for w in by_length.values()]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, hash, text): the postings of each slice."""
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    for batch in slices(batches, most=4 << 20):
        starts, ids, words = split_words(batch.column(2), LUT_ALNUM)
        places = np.argsort(ids, kind="stable").astype(np.int32)
        ends = np.cumsum(np.bincount(ids, minlength=len(words))).astype(np.int32)
        ids_, hashes = (pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (batch.column(0), batch.column(1)))
        terms = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([ids_, hashes, one(starts, pa.int64()), terms, one(ends, pa.int32()), one(places, pa.int32())], _INDEX)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of docs, stored: see ``INDEX``; a text that is null or empty has no words, and any id may repeat or be null."""
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return written(d.mapInArrow(_index, INDEX), "postings", GROUP_ROWS)


class _Slice:
    """One row of the index, with the postings of the terms that a block of windows has."""

    def __init__(self, row: dict[str, pa.Scalar], block: Windows) -> None:
        values = lambda c: row[c].values
        self.doc_ids, self.hashes, self.starts = values("doc_ids"), values("hashes"), values("starts").to_numpy(zero_copy_only=False)
        self.places, self.ends = values("places").to_numpy(zero_copy_only=False).astype(np.int64), values("ends").to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = len(self.places)
        sizes = np.diff(np.concatenate(([0], self.ends)))
        #: the list of each of the block's terms, -1 where it has none
        self.list = pc.fill_null(pc.index_in(block.terms, value_set=values("terms")), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = np.where(self.list >= 0, sizes[self.list] if len(sizes) else 0, 0)
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.list_at = np.empty(self.n, np.int64)
        self.list_at[self.places] = self.of
        self.doc_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def match(self, windows: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the window, document, start) of each occurrence; exact ones with slop 0."""
        length = windows.shape[1]
        size = self.size[windows]
        here = np.flatnonzero((size > 0).all(axis=1))
        if not len(here):
            return
        lists, order = self.list[windows[here]], np.argsort(size[here], axis=1, kind="stable")
        first = lists[np.arange(len(here)), order[:, 0]]
        count = size[here, order[:, 0]]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(count) // STARTS)) + 1, [len(here)]))
        keys = self.of * (self.n + 1) + self.places if slop else None
        for a, b in zip(cuts[:-1], cuts[1:]):
            w = np.repeat(np.arange(a, b), count[a:b])
            if not len(w):
                continue
            nth = np.arange(len(w)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
            place = self.places[self.ends[first[w]] - count[w] + nth]
            doc, at = self.doc_of[place], place - order[w, 0]
            if slop:
                shift = np.arange(-slop, slop + 1)
                w, doc, at = np.repeat(w, len(shift)), np.repeat(doc, len(shift)), (at[:, None] + shift).ravel()
            lo, hi = self.starts[doc], self.starts[doc + 1]
            if not slop:
                fit = (at >= lo) & (at + length <= hi)
                w, doc, at = w[fit], doc[fit], at[fit]
            for k in range(1, length):
                o = order[w, k]
                t = lists[w, o]
                if not slop:
                    good = self.list_at[at + o] == t
                else:
                    lo, hi = self.starts[doc], self.starts[doc + 1]
                    least, most = np.maximum(at + o - slop, lo), np.minimum(at + o + slop, hi - 1)
                    i = np.searchsorted(keys, t * (self.n + 1) + least)
                    good = (i < len(keys)) & (least <= most)
                    good[good] = keys[i[good]] <= t[good] * (self.n + 1) + most[good]
                w, doc, at = w[good], doc[good], at[good]
                if not len(w):
                    break
            yield here[w], doc, at


def _ask(block: Windows, slop: int):
    """For mapInArrow over the index: what each document has of a block's windows."""

    def owned(found: dict[int, set[int]], groups: list, w: np.ndarray, doc: np.ndarray) -> None:
        pairs = np.unique(np.stack([doc, w]), axis=1)
        for d, k in pairs.T.tolist():
            found.setdefault(d, set()).update(groups[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s = _Slice({c: batch.column(k)[r] for k, c in enumerate(_INDEX)}, block)
                edge = np.zeros(s.n + 1, np.int64)
                items: dict[int, set[int]] = {}
                near: dict[int, set[int]] = {}
                for windows, owners in block.groups:
                    for w, doc, at in s.match(windows, 0):
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + windows.shape[1], -1)
                        owned(items, owners, w, doc)
                    if slop:
                        for w, doc, _ in s.match(windows, slop):
                            owned(near, owners, w, doc)
                on = np.cumsum(edge[:-1]) > 0
                n = np.diff(s.starts)
                before = np.concatenate(([0], np.cumsum(on)))
                hits = before[s.starts[1:]] - before[s.starts[:-1]]
                bits = [np.packbits(on[a:b]).tobytes() if h else None for a, b, h in zip(s.starts[:-1], s.starts[1:], hits)]
                names = lambda of, d, but=(): [block.items[k] for k in sorted(of.get(d, set()).difference(but))]
                own = pa.array([names(items, d) for d in range(len(n))], pa.list_(pa.string()))
                beside = pa.array([names(near, d, items.get(d, ())) for d in range(len(n))], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([s.doc_ids, s.hashes, pa.array(n, pa.int64()), pa.array(hits, pa.int64()), own, beside, pa.array(bits, pa.binary())], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def _blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[Windows]:
    """The test items in blocks of about BLOCK_WORDS words: split by a hash of the item, one collect each."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + int(total) // (BLOCK_WORDS * 5)
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p).collect() if parts > 1 else items.collect()
        yield Windows(sorted((r.item, r.text or "") for r in rows), window)


def _hit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (..., n_hit, hits): n_hit becomes the number of words that any block hit."""
    for batch in batches:
        counts = []
        for hits in batch.column(batch.num_columns - 1).to_pylist():
            size = max(len(h) for h in hits)
            counts.append(int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(h.ljust(size, b"\0"), np.uint8) for h in hits])).sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(counts, pa.int64())], batch.schema.names[:-1])


def ask_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, hash (of the text), n_words, n_hit, items and near, a row for each indexed row; see ``find_phrases``."""
    found = [index.mapInArrow(_ask(block, slop), _FOUND) for block in _blocks(benchmark, window, item_col, item_text_col)]
    if len(found) == 1:
        return found[0].drop("hit")
    # rows of one id and text are alike in every block; how many there are is counted within one block
    every = None
    for k, one in enumerate(found):
        own = written(one.withColumn("block", F.lit(k)), "phrases")
        every = own if every is None else every.unionByName(own)
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    both = every.groupBy("doc_id", "hash", "n_words").agg(F.max("n_hit").alias("n_hit"), union("items").alias("items"), union("near").alias("near"), F.collect_set("hit").alias("hits"), F.sum((F.col("block") == 0).cast("long")).alias("copies"))
    names = ["doc_id", "hash", "n_words", "items", "near", "copies", "n_hit"]
    several = both.where("size(hits) > 1").select(*names, "hits")
    schema = T.StructType([f for f in several.schema.fields if f.name != "hits"])
    all_ = both.where("size(hits) < 2").select(names).unionByName(several.mapInArrow(_hit_words, schema)).withColumn("near", F.array_except("near", "items"))
    return all_.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "hash", "n_words", "n_hit", "items", "near")


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", row: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (ids, sorted as strings), near (items with proximity matches and no exact one there), and ``row`` (a struct of the named columns, if any are named).

    Null or empty texts have no words; items without words match nothing; items
    without an id are left out; equal item ids count once; repeated documents are
    judged each on its own; an empty table on either side gives rows without hits,
    or none. Texts are read whole, and a text or row of any length stays in one task.
    """
    found = ask_index(build_index(docs, id_col, text_col), benchmark, window, slop, item_col, item_text_col)
    found = found.select("doc_id", "hash", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near")).alias("near"))
    if not row:
        return found.drop("hash")
    return carried(docs, found.dropDuplicates(["doc_id", "hash"]), row, "inner", id_col, text_col).select("doc_id", "n_words", "n_hit", "items", "near", "row")


def carried(docs: DataFrame, found: DataFrame, row: list[str], how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (a struct of named columns of docs) joined with found by id and text."""
    d = docs.select(F.col(id_col).cast("long").alias("d_id"), F.xxhash64(F.col(text_col).cast("string")).alias("d_hash"), F.struct(*[docs[c] for c in row]).alias("row"))
    return d.join(found, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_hash") == F.col("hash")), how)


def op10_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


SQL = {
    "op10_phrase_index": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
wn AS MATERIALIZED (SELECT g, n, row_number() OVER () AS wid FROM (SELECT DISTINCT g, n FROM bw)),
wt AS (SELECT wid, n, unnest(string_split(g, ' ')) AS term, unnest(range(n)) AS o FROM wn),
dt AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
-- one bit for each place of the window at which its term stands, at most one word off
close AS (SELECT doc_id, wid FROM (SELECT doc_id, wid, n, o, pos - o + off AS s FROM dt JOIN wt USING (term), (SELECT unnest([-1, 0, 1]) AS off)) GROUP BY doc_id, wid, s HAVING bit_or(1 << o) = (1 << max(n)) - 1),
near AS (SELECT doc_id, count(*) AS n_near FROM (
  SELECT DISTINCT doc_id, item_id FROM close JOIN wn USING (wid) JOIN bw USING (g)
  EXCEPT SELECT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id)
""",
}
