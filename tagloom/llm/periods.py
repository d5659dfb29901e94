"""Periodic run detection (op11): repeated k-gram masking, then Main-Lorentz on what is left.

A run of length L and period q, at least ``min_periods`` times as long as its
period, overlaps its own shift by L - q words, and by
``min_words - min_words // min_periods`` words at the least: that is k. Every
word of a run lies in a k-gram that the text holds again q words on or before.
So words outside repeated k-grams cannot join runs; they are masked, and most
texts end there. The divide-and-conquer of Main and Lorentz lists the maximal
repetitions of the segments that survive, from Z functions on either side of
each middle, in O(n log n). A text is one row's work; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, mix, slices, table, text_buffer
from .quality import let, words

MIN_WORDS, MIN_PERIODS = 24, 3
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def overlap(min_words: int, min_periods: int) -> int:
    """The least L - q of any run: what it shares with its own shift by a period."""
    return min_words - min_words // min_periods


def surviving(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of words that lie in k-grams found twice or more.

    k-grams are compared by 64-bit hashes: two that fall together only keep a
    stretch that Main-Lorentz then finds empty.
    """
    n = len(ids)
    if n < k + 1:
        return []
    grams, have = mix(ids.astype(np.uint64)), 1
    while have < k:
        step = min(have, k - have)
        grams = mix(grams[:-step] * np.uint64(0x5851F42D4C957F2D) ^ grams[step:])
        have += step
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(grams, twice))
    gap = np.flatnonzero(np.diff(at) > k)
    starts = at[np.concatenate(([0], gap + 1))]
    ends = at[np.concatenate((gap, [len(at) - 1]))] + k
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def z_function(s: list[int]) -> list[int]:
    """For each place the length of what the list from there shares with its beginning."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def maximal_runs(s: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a list, by Main-Lorentz, sorted by start and period.

    A run that crosses the middle of a part holds a whole period on one side of
    it at least; for each period the two Z functions of that side say how far it
    reaches both ways. A piece of a run that the part's borders cut is dropped:
    the part above it that holds the run finds it whole.
    """
    n = len(s)
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, length: int, q: int) -> None:
        end = start + length
        if length >= max(min_words, min_periods * q) and (start == 0 or s[start - 1] != s[start - 1 + q]) and (end == n or s[end] != s[end - q]):
            found[start, length] = min(q, found.get((start, length), q))

    parts = [(0, n)]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < min_words:
            continue
        mid, most = (lo + hi) // 2, (hi - lo) // min_periods
        parts += [(lo, mid), (mid, hi)]
        u, v = s[lo:mid], s[mid:hi]
        back_u, both = u[::-1], u + v
        # a period to the right of the middle: forward from (mid, mid + q), backward from the words before both
        ahead = z_function(v) + [0]
        behind = z_function([*back_u, -1, *both[::-1]])
        for q in range(1, min(most, len(v)) + 1):
            b = behind[len(u) + 1 + len(v) - q]
            keep(mid - b, b + q + ahead[q], q)
        # a period to the left of it
        ahead = z_function([*v, -1, *both])
        behind = z_function(back_u) + [0]
        for q in range(1, min(most, len(u)) + 1):
            b = behind[q]
            keep(mid - q - b, b + q + ahead[len(v) + 1 + len(u) - q], q)
    return sorted((a, length, q) for (a, length), q in found.items())


def text_runs(text: bytes, min_words: int, min_periods: int) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words, the runs, and the text with each run cut to its first period (one blank between words)."""
    own = text.split()  # bytes: [\x20\x09-\x0D] alone
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own))
    runs = []
    for a, b in surviving(ids, overlap(min_words, min_periods)):
        if b - a >= min_words:
            runs += [(a + s, length, q) for s, length, q in maximal_runs(ids[a:b].tolist(), min_words, min_periods)]
    if runs:
        drop = np.zeros(len(own) + 1, np.int64)
        for s, length, q in runs:
            drop[s + q] += 1
            drop[s + length] -= 1
        own = [own[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return len(ids), runs, b" ".join(own)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text with each run cut to its first period.

    A run is a stretch of consecutive words (of any characters but ASCII white
    space) of smallest period q, ``min_words`` and ``min_periods`` * q words long
    at least, that no neighbouring word extends. Runs may overlap; a word goes
    if any run holds it after that run's first q words. A null text counts as
    empty: no words, no runs, an empty collapsed text. Null ids and repeated
    rows are judged each on its own; an empty table gives no rows; other columns
    are not read. Work is O(n log n) in a text's words, memory linear in it.
    """
    if min_periods < 2:
        raise ValueError("a run holds its period twice at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, raw = text_buffer(batch.column(1))
            raw, at = raw.tobytes(), offsets.tolist()
            rows = [text_runs(raw[a:b], min_words, min_periods) for a, b in zip(at[:-1], at[1:], strict=True)]
            flat = [r for _, runs, _ in rows for r in runs]
            items = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], ["start", "length", "period"])
            ends = np.concatenate(([0], np.cumsum([len(runs) for _, runs, _ in rows]))).astype(np.int32)
            columns = [batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), items), pa.array([t for _, _, t in rows], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def with_cycles(text: Column, doc_id: Column) -> Column:
    """The texts that the query reads: where h = crc32(decimal id) is a multiple of 10, the words from a = g % n on cycle through p of them (g = h div 10, p = 1 + (n - a) div (3 + g % 8)). A null id changes nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def cycled(w: Column) -> Column:
        n = F.size(w).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        places = let(F.struct(a.alias("a"), p.alias("p")), lambda c: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < c["a"], i).otherwise(c["a"] + (i - c["a"]) % c["p"])))
        return F.array_join(F.transform(places, lambda i: F.get(w, i.cast("int"))), " ")

    return F.when((h % 10 == 0) & text.isNotNull(), let(words(text), lambda w: F.when(F.size(w) == 0, text).otherwise(cycled(w)))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = periodic_runs(docs.select("doc_id", with_cycles(F.col("text"), F.col("doc_id")).alias("text")))
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    first = F.get("runs", F.lit(0))
    # runs come by start, then period, so the first of equals stays
    best = F.when(F.size("runs") > 0, F.aggregate("runs", first, lambda a, r: F.when(longer(r, a), r).otherwise(a)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = out.select("doc_id", "n_words", "runs", "collapsed", F.explode(F.array(best)).alias("best"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
