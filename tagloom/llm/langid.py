"""Language identification (op8) by prediction by partial matching over bytes.

Each language has a byte context tree of order ``ORDER`` with frozen counts. A
byte's code length in a context is -log2 of its share there (escape method C:
n / (N + D), D distinct bytes after N occurrences), or the escape's code length
plus the byte's code length in the next shorter context; below order 0 all bytes
are alike. A text's code length in a language is the exact sum over all its
bytes, in 1/1024 bit; the shortest code wins.

As counts are frozen, the trees of all languages become one automaton: the
longest kept context of the bytes before, and a table of code lengths by
(context, next byte, language), at most ``STATES`` contexts large. Scoring is
two array look-ups a byte and needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, text_buffer

ORDER = 3
#: Documents learnt from, at most, for each language (those with the smallest hash of the id).
SAMPLE = 2000
#: Contexts of order 2 and 3 kept in the automaton, at most (those with the greatest sum of shares of each language's bytes).
STATES = 16384
UNIT = 1024
PAD = 10
_word = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _word(text))


def _context(offsets: np.ndarray, symbols: np.ndarray, pad: int, back: int) -> np.ndarray:
    """The symbol ``back`` places before each, ``pad`` before a text's start."""
    out = np.empty_like(symbols)
    out[:back] = pad
    out[back:] = symbols[:-back]
    for k in range(back):
        at = offsets[:-1] + k
        out[at[at < len(out)]] = pad
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): four bytes as one number, the last being the one to predict."""
    for batch in slices(batches):
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            part = batch.column(1).filter(pa.array([x == lang for x in langs]))
            offsets, raw = text_buffer(part)
            code = raw.astype(np.int64)
            for back in range(1, ORDER + 1):
                code |= _context(offsets, raw, PAD, back).astype(np.int64) << (8 * back)
            values, counts = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["lang", "gram", "n"])


class Model:
    """langs; of[byte] -> symbol; state_of[three symbols before] -> context; cost[lang][context * symbols + symbol]."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], states: int = STATES) -> None:
        self.langs = sorted(grams)
        seen = np.unique(np.concatenate([np.unique(np.concatenate([(g >> s) & 255 for s in (0, 8, 16, 24)])) for g, _ in grams.values()] + [np.array([PAD])]))
        self.of = np.zeros(256, np.int64)  # 0: a byte that no language has
        self.of[seen] = np.arange(1, len(seen) + 1)
        a = self.symbols = len(seen) + 1
        self.pad = int(self.of[PAD])
        parts = {}
        for lang, (g, n) in grams.items():
            parts[lang] = [self.of[(g >> s) & 255] for s in (24, 16, 8, 0)] + [n.astype(np.float64)]
        # contexts: 0 the empty one, 1..a-1 single symbols, then pairs and triples by their shares of the languages' bytes, all languages alike
        three = np.zeros(a**3)
        two = np.zeros(a**2)
        for x, y, z, _, n in parts.values():
            np.add.at(three, (x * a + y) * a + z, n / n.sum())
            np.add.at(two, y * a + z, n / n.sum())
        keys = np.concatenate((np.flatnonzero(two), np.flatnonzero(three) + a * a))
        weight = np.concatenate((two[two > 0], three[three > 0]))
        keys = np.sort(keys[np.lexsort((keys, -weight))[:states]])
        two_kept, three_kept = keys[keys < a * a], keys[keys >= a * a] - a * a
        self.n_states = a + len(keys)
        state2 = np.tile(np.arange(a), (a, 1))  # longest kept context of at most two symbols
        state2[two_kept // a, two_kept % a] = a + np.arange(len(two_kept))
        state3 = np.broadcast_to(state2, (a, a, a)).copy()
        ids3 = a + len(two_kept) + np.arange(len(three_kept))
        x3, y3, z3 = three_kept // (a * a), three_kept // a % a, three_kept % a
        state3[x3, y3, z3] = ids3
        self.state_of = state3.ravel().astype(np.int32)
        shorter = np.zeros(self.n_states, np.int64)
        shorter[a : a + len(two_kept)] = two_kept % a
        shorter[ids3] = state2[y3, z3]
        exact2 = np.full(a * a, -1)
        exact2[two_kept] = a + np.arange(len(two_kept))
        exact3 = np.full(a**3, -1)
        exact3[three_kept] = ids3
        self.cost = []
        for lang in self.langs:
            x, y, z, s, n = parts[lang]
            count = np.zeros((self.n_states, a))
            np.add.at(count[0], s, n)
            np.add.at(count, (z, s), n)  # z is a symbol that occurs, so at least 1
            for to in (exact2[y * a + z], exact3[(x * a + y) * a + z]):
                np.add.at(count, (to[to >= 0], s[to >= 0]), n[to >= 0])
            self.cost.append(self._lengths(count, shorter, a + len(two_kept)))

    def _lengths(self, count: np.ndarray, shorter: np.ndarray, first3: int) -> np.ndarray:
        a = self.symbols
        out = np.empty_like(count)
        total, kinds = count.sum(1), (count > 0).sum(1)
        below = np.full(a, 8.0)

        def fill(rows: slice | int, base: np.ndarray) -> None:
            c, t, k = count[rows], total[rows], kinds[rows]
            t, k = np.asarray(t)[..., None], np.asarray(k)[..., None]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[rows] = np.where(t == 0, base, np.where(c > 0, -np.log2(c / (t + k)), base - np.log2(k / (t + k))))

        fill(0, below)
        for rows in (slice(1, a), slice(a, first3), slice(first3, self.n_states)):
            fill(rows, out[shorter[rows]])
        return np.rint(out * UNIT).astype(np.int32).ravel()

    def lengths(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, int64[n, languages]."""
        out = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        some = np.flatnonzero(np.diff(offsets) > 0)
        if not len(some) or not self.langs:
            return out
        s = self.of[raw].astype(np.int32)
        key = _context(offsets, s, self.pad, 3)
        for back in (2, 1):
            key *= self.symbols
            key += _context(offsets, s, self.pad, back)
        at = self.state_of[key] * np.int32(self.symbols) + s
        for k, cost in enumerate(self.cost):
            out[some, k] = np.add.reduceat(cost[at], offsets[some], dtype=np.int64)
        return out


def learn(docs: DataFrame, sample: int = SAMPLE, states: int = STATES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts of at most ``sample`` labelled documents a language; rows with a null id, text or label teach nothing."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    ids = d.select("id", "lang").distinct().withColumn("hash", F.xxhash64("id")).withColumn("part", F.shiftright("hash", 48))
    # the 65,536 parts of the hashes are counted first, so that only those with the smallest hashes are sorted
    parts = ids.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    # their prefix sums go by 256 blocks of 256 parts, so that no task holds all parts of a language
    parts = parts.withColumn("block", F.shiftright("part", 8))
    blocks = parts.groupBy("lang", "block").agg(F.sum("n").alias("all"))
    blocks = blocks.select("lang", "block", (F.sum("all").over(Window.partitionBy("lang").orderBy("block")) - F.col("all")).alias("earlier")).where(F.col("earlier") < sample)
    before = F.col("earlier") + F.sum("n").over(Window.partitionBy("lang", "block").orderBy("part")) - F.col("n")
    # at most 256 blocks a language
    parts = parts.join(F.broadcast(blocks), ["lang", "block"]).withColumn("before", before).where(F.col("before") < sample).select("lang", "part")
    # at most ``sample`` parts a language
    ids = ids.join(F.broadcast(parts), ["lang", "part"])
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))).where(F.col("nth") <= sample).select("id", "lang")
    # at most ``sample`` ids a language
    rows = d.join(F.broadcast(ids), ["id", "lang"], "left_semi").select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long")
    got = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    lang, gram, n = got.column("lang").to_numpy(), got.column("gram").to_numpy(), got.column("n").to_numpy()
    return Model({x: (gram[lang == x], n[lang == x]) for x in sorted(set(lang))}, states)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the winner's share if all languages are as likely before), bits (its code length).

    ``und`` with score 0 for a null text, one without a letter, or a model
    without languages; of equal code lengths the first language by name wins.
    Repeated rows are judged each on its own; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            found = model.lengths(*text_buffer(batch.column(1)))
            ok = np.array([has_letter(t) for t in batch.column(1).to_pylist()], bool) & bool(model.langs)
            if model.langs:
                best = found.argmin(1)
                least = found[np.arange(len(found)), best]
                share = 1 / np.exp2(np.maximum((least[:, None] - found) / UNIT, -1000)).sum(1)
            else:
                best = least = share = np.zeros(len(found), np.int64)
            pred = [model.langs[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(ok, share, 0.0)), pa.array(np.where(ok, least / UNIT, 0.0))], ["doc_id", "lang_pred", "score", "bits"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
