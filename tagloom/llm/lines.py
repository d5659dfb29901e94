"""Line dedup (op1): content-defined chunks of lines, removed where they repeat.

A text is a row of lines. A rolling hash over the hashes of two neighbouring
lines is taken at every line; a chunk begins where it is a local minimum, so
that boundaries follow the content and resynchronise after an insertion, and
every chunk inside has two lines at least. A line of ``LONG`` words or more is
first wrapped into sentence lines and stands in a run of its own, so that a
passage on one line is cut into chunks of its own too.

Pass 1 finds the chunk hashes that occur more than once, pass 2 sends the bytes
of those chunks to an aggregation on the bytes themselves (the byte comparison;
equal chunks meet pre-aggregated), pass 3 takes every occurrence but the first
one out of the texts that have one. After the comparison a hash of one body stands
for its bytes; only where bodies of one hash differ do the bytes go along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, drop_path, hash_words, in_bitmap, mix, release, scratch, slices, table, written

LONG, MIN_WORDS = 50, 8
#: A sentence of at most 25 blank-separated pieces; else 25 pieces; else the rest.
_WRAP = r"(?:[^ ]* ){0,24}?[^ ]*[.!?] |(?:[^ ]* ){25}|.+"
_wrap = re.compile(_WRAP).findall
_LAST = (1 << 63) - 1


def _bounds(units: list[str]) -> list[int]:
    """Where chunks begin in a run of lines, and its end."""
    n = len(units)
    if n < 4:
        return [0, n]
    h = [int(md5(u.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) for u in units]
    r = [0] + [(h[i - 1] * 1000003 + h[i]) & 0xFFFFFFFF for i in range(1, n)]
    return [0] + [i for i in range(2, n - 1) if r[i] < r[i - 1] and r[i] <= r[i + 1]] + [n]


def cut(text: str) -> list[tuple[list[int], list[str], bool]]:
    """Chunks of a text in order: numbers of the physical lines, the (wrapped) lines, and whether they are pieces of one long line."""
    runs: list[tuple[list[int], list[str], bool]] = []
    fresh = True
    for k, line in enumerate(text.split("\n")):
        if line.count(" ") >= LONG - 1:
            units = _wrap(line)
            runs.append(([k] * len(units), units, True))
            fresh = True
        elif fresh:
            runs.append(([k], [line], False))
            fresh = False
        else:
            runs[-1][0].append(k)
            runs[-1][1].append(line)
    out = []
    for numbers, units, wrapped in runs:
        at = _bounds(units)
        out += [(numbers[a:b], units[a:b], wrapped) for a, b in zip(at, at[1:])]
    return out


def _body(chunk: tuple[list[int], list[str], bool]) -> str | None:
    """The chunk's text if it may be removed: two lines and ``MIN_WORDS`` words at least."""
    _, units, wrapped = chunk
    if len(units) < 2:
        return None
    body = ("" if wrapped else "\n").join(units)
    return body if len(body.split()) >= MIN_WORDS else None


def _hash(body: str) -> int:
    return int.from_bytes(md5(body.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def _without(chunks: list, gone: set[int]) -> str:
    """The text of the chunks that stay; a physical line of which something stays keeps its line end."""
    lines: dict[int, list[str]] = {}
    for k, (numbers, units, _) in enumerate(chunks):
        if k not in gone:
            for n, u in zip(numbers, units):
                lines.setdefault(n, []).append(u)
    return "\n".join("".join(x) for x in lines.values())


def _emit(wanted: tuple[np.ndarray, np.ndarray] | None):
    """For mapInArrow over (did, text, dh): removable chunks (did, h), or, with filters of documents and of hashes, those that may repeat (did, h, k, nth, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if wanted is not None:
                batch = batch.filter(pa.array(in_bitmap(wanted[0], batch.column(2).to_numpy())))
            docs, numbers, hashes, nth, bodies = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: dict[int, int] = {}
                for k, chunk in enumerate(cut(text or "")):
                    body = _body(chunk)
                    if body is not None:
                        h = _hash(body)
                        seen[h] = seen.get(h, 0) + 1
                        docs.append(doc)
                        numbers.append(k)
                        hashes.append(h)
                        nth.append(seen[h])
                        bodies.append(body)
            h = pa.array(hashes, pa.int64())
            if wanted is None:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), h], ["did", "h"])
            else:
                keep = pa.array(in_bitmap(wanted[1], h.to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), h, pa.array(numbers, pa.int32()), pa.array(nth, pa.int32()), pa.array(bodies, pa.string())], ["did", "h", "k", "nth", "body"]).filter(keep)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the chunks in ``gone`` (array of struct k, h) out of ``text`` and count them in n_removed; other columns stay."""
    for batch in slices(batches):
        cols = dict(zip(batch.schema.names, batch.columns))
        texts, removed = [], []
        for text, gone in zip(cols["text"].to_pylist(), cols["gone"].to_pylist()):
            listed, out = {(g["k"], g["h"]) for g in gone or []}, set()
            if listed:
                chunks = cut(text or "")
                out = {k for k, chunk in enumerate(chunks) if (body := _body(chunk)) is not None and (k, _hash(body)) in listed}
                text = _without(chunks, out)
            texts.append(text)
            removed.append(len(out))
        cols |= {"text": pa.array(texts, pa.string()), "n_removed": pa.array(removed, pa.int64())}
        yield pa.RecordBatch.from_arrays([cols[c] for c in batch.schema.names], batch.schema.names)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: list[str] | None = None) -> DataFrame:
    """doc_id, text (without its repeated chunks), n_lines (before), n_removed (chunks), and ``row`` (a struct of named columns of docs).

    Of each chunk that occurs again, in the same or another document, the first
    occurrence by doc_id stays, a null id coming last. Rows that share an id
    count as one document: both keep what it keeps. A null text stays null, an
    empty one has one chunk that is never removed, and a text that loses all its
    chunks is empty. Chunks of one line or under ``MIN_WORDS`` words are never
    removed. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), *([F.struct(*[docs[c] for c in row]).alias("row")] if row else []))
    plain = base.select("did", "text", F.xxhash64("did").alias("dh"))
    seen = written(plain.mapInArrow(_emit(None), "did long, h long"), "chunk-hashes")
    repeated = bitmap(seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h")

    def may_repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(repeated, batch.column(1).to_numpy())))

    holders = bitmap(seen.mapInArrow(may_repeat, "did long, h long").select(F.xxhash64("did").alias("dh")), "dh")
    found = written(plain.mapInArrow(_emit((holders, repeated)), "did long, h long, k int, nth int, body string"), "chunks")
    # the bytes meet in an aggregation; a hash of one body stands for its bytes after it, others take the bytes along
    first = written(found.groupBy("h", "body").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")), "first-chunks")
    one = written(first.groupBy("h").agg(F.count(F.lit(1)).alias("bodies"), F.min("first").alias("first"), F.max("n").alias("n")).where("n > 1"), "chunk-firsts")
    plainly = found.drop("body").join(one.where("bodies = 1").select("h", "first"), "h")
    clash = one.where("bodies > 1").select("h")
    clashing = found.join(clash, "h", "left_semi").join(first.where("n > 1").drop("n"), ["h", "body"]).select("h", "did", "k", "nth", "first")
    gone = plainly.select("h", "did", "k", "nth", "first").unionByName(clashing).where("did > first or nth > 1").groupBy("did").agg(F.collect_list(F.struct("k", "h")).alias("gone"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines")
    both = base.join(gone, "did", "left").select("doc_id", "text", "gone", n_lines, F.lit(0).cast("long").alias("n_removed"), *(["row"] if row else []))
    return both.mapInArrow(_remove, both.schema).drop("gone")


def op1_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


# --- whole shared runs -----------------------------------------------------------------------

_INNER = {"": np.uint64(1), " ": np.uint64(2), "\n": np.uint64(3)}
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def units(text: str) -> tuple[list[str], list[str]]:
    """A text's lines, those of ``LONG`` words or more as sentence pieces, each without what ends it, and what ends them (a line end, a blank or nothing)."""
    own, tails = [], []
    for line in text.split("\n"):
        if line.count(" ") >= LONG - 1:
            for piece in _wrap(line):
                blank = piece.endswith(" ")
                own.append(piece[:-1] if blank else piece)
                tails.append(" " if blank else "")
            if tails[-1]:
                own[-1] += " "
        else:
            own.append(line)
            tails.append("")
        tails[-1] = "\n"
    tails[-1] = ""
    return own, tails


def _windows(texts: list[tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, hash) of the shortest runs of two units and ``MIN_WORDS`` words at least, from each start and to each end in each text.

    Every such run holds, around each of its units, one of these; so a unit lies in a
    repeated run if, and only if, it lies in a repeated one of these.
    """
    every = [u for own, _ in texts for u in own]
    sizes = np.array([len(own) for own, _ in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    of = np.repeat(np.arange(len(texts)), sizes)
    n = len(every)
    words = np.concatenate(([0], np.cumsum(np.fromiter((len(u.split()) for u in every), np.int64, n))))
    k = np.arange(n + 1)
    to = np.maximum(np.searchsorted(words, words + MIN_WORDS, side="left"), k + 2)[:-1]
    since = np.minimum(np.searchsorted(words, words - MIN_WORDS, side="right") - 1, k - 2)[1:]
    ahead = to <= begins[of + 1]
    behind = since >= begins[of]
    behind[behind] &= to[since[behind]] != k[1:][behind]
    a, b = np.concatenate((k[:-1][ahead], since[behind])), np.concatenate((to[ahead], k[1:][behind]))
    last = hash_words(pa.array(every, pa.string()))
    inner = mix(last + np.array([_INNER[t] for _, tails in texts for t in tails], np.uint64))
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))
    inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(inner * power[::-1][1:])))
    h = mix((sums[b - 1] - sums[a]) * inverse[n - b] ^ mix(last[b - 1]))
    at = of[a]
    return at, a - begins[at], b - begins[at], h.view(np.int64)


def _joined(own: list[str], tails: list[str], a: int, b: int) -> str:
    """The bytes of a run, without what ends its last unit."""
    return "".join(x for u, t in zip(own[a : b - 1], tails[a : b - 1]) for x in (u, t)) + own[b - 1]


def _later(own: list[str], tails: list[str], found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> set[int]:
    """Numbers of the windows that stand in the same text before, without overlap."""
    order = np.argsort(found[2], kind="stable")
    h = found[2][order]
    same = np.flatnonzero(h[1:] == h[:-1])
    first: dict[str, int] = {}
    out = set()
    for k in sorted({*order[same].tolist(), *order[same + 1].tolist()}):
        a, b = int(found[0][k]), int(found[1][k])
        if first.setdefault(_joined(own, tails, a, b), b) <= a:
            out.add(k)
    return out


def _emit_runs(wanted: tuple[np.ndarray, np.ndarray] | None):
    """For mapInArrow over (did, text, dh): hashes of windows (did, h), or, with filters of documents and of hashes, windows that may repeat (did, h, a, b, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            if wanted is not None:
                batch = batch.filter(pa.array(in_bitmap(wanted[0], batch.column(2).to_numpy())))
            texts = [units(t or "") for t in batch.column(1).to_pylist()]
            at, a, b, h = _windows(texts)
            did = batch.column(0).to_numpy()
            if wanted is None:
                yield pa.RecordBatch.from_arrays([pa.array(did[at]), pa.array(h)], ["did", "h"])
            else:
                keep = in_bitmap(wanted[1], h)
                at, a, b, h = at[keep], a[keep], b[keep], h[keep]
                bodies = [_joined(*texts[t], x, y) for t, x, y in zip(at.tolist(), a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(did[at]), pa.array(h), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(bodies, pa.string())], ["did", "h", "a", "b", "body"])

    return run


def _remove_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the units of the windows in ``gone`` (array of struct a, b, h; not null, perhaps empty, where windows of the text repeat) and of those that stand before in it out of ``text`` and count them in n_removed; other columns stay."""
    for batch in slices(batches, most=2 << 20):
        cols = dict(zip(batch.schema.names, batch.columns))
        texts, gone = cols["text"].to_pylist(), cols["gone"].to_pylist()
        removed = [0] * len(texts)
        listed = [k for k, g in enumerate(gone) if g is not None and texts[k] is not None]
        parts = [units(texts[k]) for k in listed]
        at, *found = _windows(parts)
        edges = np.searchsorted(at, np.arange(len(listed) + 1), sorter=(order := np.argsort(at, kind="stable")))
        for k, (own, tails), x, y in zip(listed, parts, edges[:-1], edges[1:]):
            mine = tuple(c[order[x:y]] for c in found)
            before, later, out = {(g["a"], g["b"], g["h"]) for g in gone[k]}, _later(own, tails, mine), np.zeros(len(own), bool)
            for w, (a, b, h) in enumerate(zip(*(c.tolist() for c in mine))):
                if w in later or (a, b, h) in before:
                    out[a:b] = True
            if out.any():
                texts[k], removed[k] = _rest(own, tails, out), int(out.sum())
        cols |= {"text": pa.array(texts, pa.string()), "n_removed": pa.array(removed, pa.int64())}
        yield pa.RecordBatch.from_arrays([cols[c] for c in batch.schema.names], batch.schema.names)


def _rest(own: list[str], tails: list[str], out: np.ndarray) -> str:
    """The text of the units that stay; a physical line of which something stays keeps its line end."""
    lines: list[str] = []
    line: list[str] = []
    for u, t, gone in zip(own, [*tails[:-1], "\n"], out):
        if not gone:
            line.append(u if t == "\n" else u + t)
        if t == "\n":
            lines += ["".join(line)] if line else []
            line = []
    return "\n".join(lines)


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: list[str] | None = None) -> DataFrame:
    """doc_id, text (without its repeated runs), n_lines (before), n_removed (units: lines, or pieces of long ones), and ``row`` (a struct of named columns of docs).

    A unit goes if it lies in a run of two units and ``MIN_WORDS`` words at least
    that stands, byte for byte and without overlap, in a document of a smaller id
    (a null id coming last) or before in its own, wherever in lines or paragraphs
    the run begins and ends. So of a passage that several documents share only the
    first stays. Rows that share an id count as one document, and each is compared
    with itself only. A null text stays null. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), *([F.struct(*[docs[c] for c in row]).alias("row")] if row else []))
    plain = base.select("did", "text", F.xxhash64("did").alias("dh"))
    spark = docs.sparkSession
    path = scratch(spark, "run-hashes")
    plain.mapInArrow(_emit_runs(None), "did long, h long").write.parquet(path)
    seen = spark.read.parquet(path)
    repeated = bitmap(seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h")

    def may_repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(repeated, batch.column(1).to_numpy())))

    holders = bitmap(seen.mapInArrow(may_repeat, "did long, h long").select(F.xxhash64("did").alias("dh")), "dh")
    drop_path(spark, path)
    release(spark)
    found = written(plain.mapInArrow(_emit_runs((holders, repeated)), "did long, h long, a int, b int, body string"), "runs")
    # the bytes meet in an aggregation; where all bytes of a hash are equal, the hash stands for them after it
    equal = written(found.groupBy("h", "body").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")), "equal-runs")
    one = equal.groupBy("h").agg(F.count(F.lit(1)).alias("bodies"), F.min("first").alias("first"), F.max("n").alias("n"))
    clash = one.where("bodies > 1").select("h")
    plainly = found.drop("body").join(one.where("bodies = 1 and n > 1"), "h").select("did", "a", "b", "h", "first")
    clashing = found.join(F.broadcast(clash), "h", "left_semi").join(equal.join(F.broadcast(clash), "h", "left_semi").where("n > 1").drop("n"), ["h", "body"]).select("did", "a", "b", "h", "first")
    before = F.col("did") > F.col("first")
    gone = plainly.unionByName(clashing).groupBy("did").agg(F.collect_list(F.when(before, F.struct("a", "b", "h"))).alias("gone"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines")
    both = base.join(gone, "did", "left").select("doc_id", "text", "gone", n_lines, F.lit(0).cast("long").alias("n_removed"), *(["row"] if row else []))
    return both.mapInArrow(_remove_runs, both.schema).drop("gone")


def op1_shared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_runs(table(spark, sf_dir, "documents"))


SQL = {
    "op1_line_chunks": f"""
WITH lines AS (
  SELECT doc_id, text, k, line, len(string_split(line, ' ')) >= {LONG} AS wrapped
  FROM (SELECT doc_id, text, unnest(l) AS line, unnest(range(len(l))) AS k FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
runs AS (SELECT *, sum(CASE WHEN wrapped THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - CASE WHEN wrapped THEN 1 ELSE 0 END AS run FROM lines),
units AS (
  SELECT doc_id, k, run, wrapped, unnest(u) AS unit, unnest(range(len(u))) AS j
  FROM (SELECT *, CASE WHEN wrapped THEN regexp_extract_all(line, '{_WRAP}') ELSE [line] END AS u FROM runs)),
hashed AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id, run) AS n, ('0x' || substr(md5(unit), 1, 8))::BIGINT AS h FROM units WINDOW w AS (PARTITION BY doc_id, run ORDER BY k, j)),
rolled AS (SELECT *, (lag(h) OVER w * 1000003 + h) % 4294967296 AS r FROM hashed WINDOW w AS (PARTITION BY doc_id, run ORDER BY i)),
marked AS (SELECT *, CASE WHEN i = 0 OR (i BETWEEN 2 AND n - 2 AND r < lag(r) OVER w AND r <= lead(r) OVER w) THEN 1 ELSE 0 END AS b FROM rolled WINDOW w AS (PARTITION BY doc_id, run ORDER BY i)),
chunked AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY k, j) AS c FROM marked),
bodies AS (SELECT doc_id, c, count(*) AS n, CASE WHEN wrapped THEN string_agg(unit, '' ORDER BY k, j) ELSE string_agg(unit, chr(10) ORDER BY k, j) END AS body FROM chunked GROUP BY doc_id, c, wrapped),
removable AS (SELECT doc_id, c, row_number() OVER (PARTITION BY body ORDER BY doc_id, c) > 1 AS gone FROM bodies WHERE n >= 2 AND len(list_filter(string_split_regex(body, '[ \\n\\t\\r\\x0b\\x0c]+'), lambda x: x <> '')) >= {MIN_WORDS}),
stay AS (SELECT doc_id, k, string_agg(unit, '' ORDER BY j) AS line FROM chunked LEFT JOIN removable USING (doc_id, c) WHERE NOT coalesce(gone, false) GROUP BY doc_id, k),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM stay GROUP BY doc_id),
counts AS (SELECT doc_id, count(DISTINCT k) AS n_lines, count(DISTINCT CASE WHEN gone THEN c END) AS n_removed FROM chunked LEFT JOIN removable USING (doc_id, c) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN texts t USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
}
