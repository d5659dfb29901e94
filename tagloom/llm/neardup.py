"""N-gram Jaccard join (op9) by a token-group matrix.

Texts with the same shingle set are one class. All classes are compared, without
a loss, in two steps that both use the matrix of tokens and groups:

1. Groups of similar texts. Classes that share a band of minhashes form a
   bucket. In each of ``TURNS`` turns a bucket names two queries, one of its
   largest cluster and one of any, and classes of other clusters ask them, in
   groups of at most ``GROUP`` members. A link found makes the classes one
   cluster; turns end when none is found. Classes that stay alone are grouped
   with those that asked the same query. This is only a start: it unites large
   groups of near copies at linear cost, and no result hangs on it.
2. The exact search. Tokens have one global order, frequent ones last. Two sets
   with a Jaccard of ``t`` or more share a token among their first
   n - ceil(t n) + 1 in that order. The matrix holds those tokens by group, a
   group being at most about ``GROUP`` similar classes. A token that only one
   cluster has opens nothing; others give (query, group) pairs, and the number
   of them a pair has bounds its overlap, which leaves few pairs.

A pair's overlap is bounded before its sets are read: each class carries a
signature, one bit a token, and a bit that one of two sets lacks is a token that
it lacks. In step 2 the signatures go with tokens of many classes only, and a
query asks a group if the bound holds for one member at least.

For pairs that are left the tokens of the group's members are united, the overlap
of query and union is the upper bound of the query's overlap with each member, and
only a group whose bound reaches the least overlap is opened and compared member by
member. Components of the links give the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LUT_WS, bitmap, hash_words, id_text, in_bitmap, mix, release, slices, split_words, table, written
from .components import components

SHINGLE, PERCENT = 5, 75
GROUP = 64
#: Bands of minhashes, and minhashes a band.
BANDS, ROWS = 8, 2
#: Turns of the start, at most; the share of classes below which another turn is not worth it; and queries that a class asks in a turn, at most.
TURNS, WORTH, ASKED = 3, 0.05, 2
#: Longs of a signature; the signatures that go with tokens have half of them.
SIGNATURE = 8
#: Tokens reported so often are hot: signatures go with them. Rows of a hot token, and queries of a group, that one task takes.
HOT, TOKEN_ROWS, ASKERS = 8, 20_000, 1024
#: Tokens seen so often in one task's input are reported as frequent; at most FREQUENT of them are ordered by count.
LOCAL, FREQUENT = 3, 500_000
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_P = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by text, sorted distinct shingle hashes): a text of fewer words has one shingle, one without words none."""
    starts, ids, words = split_words(texts, LUT_WS)
    h = hash_words(words)[ids] if len(words) else np.zeros(0, np.uint64)
    n = np.diff(starts)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    rolled = np.zeros(len(h), np.uint64)
    if len(h) >= size:
        acc = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            acc = acc * _P + h[k : len(h) - size + 1 + k]
        rolled[: len(acc)] = mix(acc)
    for d in np.flatnonzero((n > 0) & (n < size)):  # the whole sequence
        acc = np.array([n[d]], np.uint64)
        for k in range(starts[d], starts[d + 1]):
            acc = acc * _P + h[k : k + 1]
        rolled[starts[d]] = mix(acc)[0]
    sets = [np.unique(rolled[s : s + c]) for s, c in zip(starts[:-1], count)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).astype(np.int64)
    return offsets, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _prints(offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; 0 for an empty one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5BF0_3635)))))
    n = np.diff(offsets).astype(np.uint64)
    return np.where(n > 0, mix(sums[offsets[1:]] - sums[offsets[:-1]] ^ mix(n)), np.uint64(0)).view(np.int64)


def _once(prints: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows whose non-empty set this task has not met yet."""
    keep = np.zeros(len(prints), bool)
    for k, p in enumerate(prints.tolist()):
        if p and p not in seen:
            seen.add(p)
            keep[k] = True
    return np.flatnonzero(keep)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)))


def _signatures(offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """One row of ``SIGNATURE`` longs a set: the bit of each of its tokens."""
    bits = 64 * SIGNATURE
    at = (tokens >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    out = []
    for a in range(0, len(offsets) - 1, 8192):
        ends = offsets[a : a + 8193]
        grid = np.zeros((len(ends) - 1, bits), bool)
        grid[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), at[ends[0] : ends[-1]]] = True
        out.append(np.packbits(grid, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(out) if out else np.zeros((0, SIGNATURE), np.uint64)


_SCAN = "doc_id long, n long, fp long, marks array<long>, token long, seen long"
_SCAN_NAMES = [x.split()[0] for x in _SCAN.split(", ")]


def _survey(size: int):
    """For mapInArrow: a row a document (size, fingerprint, band keys and signature), and rows of tokens that are frequent in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, most=12 << 20):
            offsets, tokens = shingle_sets(batch.column(1), size)
            n, prints = np.diff(offsets), _prints(offsets, tokens)
            marks = np.zeros((len(n), BANDS + SIGNATURE), np.int64)
            some = np.flatnonzero(n > 0)
            if len(some):
                mins = [np.minimum.reduceat(mix(tokens * a), offsets[some]) for a in _A]
                for b in range(BANDS):
                    acc = np.full(len(some), b, np.uint64)
                    for m in mins[b * ROWS : (b + 1) * ROWS]:
                        acc = mix(acc * _P + m)
                    marks[some, b] = acc.view(np.int64)
                marks[:, BANDS:] = _signatures(offsets, tokens).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, marks.shape[1], dtype=np.int32)), pa.array(marks.ravel()))
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(prints), lists, none, none], _SCAN_NAMES)
            own = [tokens[offsets[k] : offsets[k + 1]] for k in _once(prints, seen)]
            if own:
                values, counts = np.unique(np.concatenate(own), return_counts=True)
                often = counts >= LOCAL
                values, counts = values[often], counts[often]
                none = pa.nulls(len(values), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(values), pa.list_(pa.int64())), pa.array(values.view(np.int64)), pa.array(counts)], _SCAN_NAMES)

    return run


#: Flags of a token in a head, below the number of its cell.
FREE, HOT_TOKEN, SECOND, ACROSS = 1, 2, 4, 8


def _cells(heads: np.ndarray, codes: np.ndarray, weight: np.ndarray, fp: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of very many classes in cells: the classes are dealt to sides, and a cell is a pair of sides, so that each pair of classes meets in one cell."""
    tokens, out = [heads], [codes]
    for k in np.flatnonzero(weight > TOKEN_ROWS):
        sides = -(-int(weight[k]) // TOKEN_ROWS)
        own = (fp ^ (fp >> 17)) % sides
        other = np.arange(sides)
        cell = (np.minimum(other, own) << 16 | np.maximum(other, own)) << 4
        code = codes[k] | cell | np.where(other == own, 0, ACROSS) | np.where(other < own, SECOND, 0)
        out[0][k] = code[own]
        tokens.append(np.full(sides - 1, heads[k]))
        out.append(np.delete(code, own))
    return np.concatenate(tokens), np.concatenate(out)


def _prefixes(size: int, percent: int, frequent: np.ndarray, counts: np.ndarray):
    """For mapInArrow: the first n - ceil(t n) + 1 tokens of each distinct set, in the global order.

    The first common token of two sets lies among the first n - ceil(2 t n / (1 + t)) + 1
    of the smaller one. Frequent tokens after these are limited: they need not
    open a larger set. As frequent tokens come last, they are the last ones of the
    head; ``limited`` is their number. ``codes`` holds each token's flags and cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, most=8 << 20):
            offsets, tokens = shingle_sets(batch.column(1), size)
            prints = _prints(offsets, tokens)
            rows = _once(prints, seen)
            at = np.searchsorted(frequent, tokens)
            at[at == len(frequent)] = 0
            weight = np.where(frequent[at] == tokens, counts[at], 0) if len(frequent) else np.zeros(len(tokens), np.int64)
            heads, codes, limited, signed = [], [], [], []
            for k in rows:
                own, w = tokens[offsets[k] : offsets[k + 1]], weight[offsets[k] : offsets[k + 1]]
                first = len(own) - (percent * len(own) + 99) // 100 + 1
                short = len(own) - -(-2 * percent * len(own) // (100 + percent)) + 1
                if not w.any():
                    heads.append(own[:first])
                    codes.append(np.full(first, FREE, np.int64))
                    limited.append(0)
                    signed.append(None)
                    continue
                order = np.argsort(w, kind="stable")[:first]
                w = w[order]
                few = min(first - short, int((w[short:] > 0).sum()))
                code = np.where(np.arange(first) < first - few, FREE, 0) | np.where(w >= HOT, HOT_TOKEN, 0)
                head, code = _cells(own[order], code, w, int(prints[k]))
                heads.append(head)
                codes.append(code)
                limited.append(few)
                if w[-1] >= HOT:
                    s = _signatures(np.array([0, len(own)]), own)[0]
                    signed.append((s[: SIGNATURE // 2] | s[SIGNATURE // 2 :]).tobytes())
                else:
                    signed.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(prints[rows]), pa.array(np.diff(offsets)[rows]), pa.array(limited, pa.int64()), pa.array(signed, pa.binary()), _lists(heads), _lists(codes)], ["fp", "n", "limited", "sig", "head", "codes"])

    return run


def _token_rows(size: int, wanted: np.ndarray):
    """For mapInArrow: the whole sets of documents whose fingerprint is in the bitmap, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, most=8 << 20):
            offsets, tokens = shingle_sets(batch.column(1), size)
            prints = _prints(offsets, tokens)
            rows = _once(prints, seen)
            rows = rows[in_bitmap(wanted, prints[rows])]
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                yield pa.RecordBatch.from_arrays([pa.array(prints[part]), _lists([tokens[offsets[k] : offsets[k + 1]] for k in part])], ["fp", "tokens"])

    return run


def _open_groups(percent: int):
    """For mapInArrow over rows (grp, part, role, fp, tokens) sorted by these: members (0) first, then queries (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, union = None, [], None
        for batch in batches:
            a, b = [], []
            groups, parts, roles, prints = (batch.column(k).to_pylist() for k in range(4))
            lists = batch.column(4)
            flat, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(lists.offsets)
            for k, (grp, part, role, fp) in enumerate(zip(groups, parts, roles, prints)):
                own = flat[at[k] : at[k + 1]]
                if (grp, part) != now:
                    now, members, union = (grp, part), [], None
                if role == 0:
                    members.append((fp, own.copy()))
                    continue
                if not members:
                    continue
                if union is None:
                    union = members[0][1] if len(members) == 1 else np.unique(np.concatenate([m for _, m in members]))
                bound, n = _overlap(own, union), len(own)
                for fp2, m in members:
                    # 100 i >= t (n + m - i), so i >= t (n + m) / (100 + t); the bound is at least i
                    if fp2 != fp and (100 + percent) * bound >= percent * (n + len(m)):
                        i = bound if len(members) == 1 else _overlap(own, m)
                        if (100 + percent) * i >= percent * (n + len(m)):
                            a.append(fp)
                            b.append(fp2)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _one_each(sets: DataFrame) -> DataFrame:
    """One row a class of rows that several tasks met, dealt by class."""
    return sets.repartition("fp").dropDuplicates(["fp"])


def _match(docs: DataFrame, queries: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of queries (grp, part, fp) and members (grp, part, fp) of these groups; a group's parts are opened in tasks of their own."""
    role = lambda df, r: df.select("grp", "part", F.lit(r).alias("role"), "fp")
    rows = written(role(queries, 1).unionByName(role(members, 0)).distinct(), "pairs")
    wanted = bitmap(rows, "fp")
    sets = _one_each(docs.mapInArrow(_token_rows(size, wanted), "fp long, tokens array<long>"))
    placed = rows.join(sets.hint("merge"), "fp").select("grp", "part", "role", "fp", "tokens")
    sorted_ = placed.repartition("grp", "part").sortWithinPartitions("grp", "part", "role", "fp")
    return sorted_.mapInArrow(_open_groups(percent), "a long, b long").distinct()


_PAIRS = ("fp", "n", "grp", "low", "high", "limited")
_T, _CELL, _GRP, _CLUSTER, _FP, _N, _MEMBERS, _LIMITED, _FLAGS, _SIG = range(10)


def _candidates(percent: int):
    """For mapInArrow over rows (token, cell, grp, cluster, fp, n, members, limited, flags, sig) sorted by token and cell: a row for each query and group that have the token.

    low and high: sizes of the group's sets that have it and may link. Of two
    groups the one with fewer members asks, or else the one of the smaller number,
    at every token alike; in one group a class asks for those of larger number. A
    pair is left out where the token is limited in its smaller set (not FREE);
    limited, the largest number of such tokens, makes up for it in the bound.
    Classes of one cluster do not ask each other, nor do those whose signatures
    show that they are too far apart.
    """

    def may_link(q: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether columns of q and m, pairs of rows of one cell, may be links."""
        fit = (q[_CLUSTER] != m[_CLUSTER]) & (100 * q[_N] >= percent * m[_N]) & (100 * m[_N] >= percent * q[_N])
        fit &= ((q[_FLAGS] & FREE > 0) & (q[_N] <= m[_N])) | ((m[_FLAGS] & FREE > 0) & (m[_N] <= q[_N]))
        fit &= (q[_FLAGS] & ACROSS == 0) | ((q[_FLAGS] ^ m[_FLAGS]) & SECOND > 0)
        fit &= (q[_GRP] != m[_GRP]) | (q[_FP] < m[_FP])
        hot = np.flatnonzero(fit & (q[_FLAGS] & HOT_TOKEN > 0))
        if len(hot):
            x, y = q[_SIG:, hot].view(np.uint64), m[_SIG:, hot].view(np.uint64)  # bits of negative numbers are counted by their size
            most = np.minimum(q[_N, hot] - np.bitwise_count(x & ~y).sum(axis=0, dtype=np.int64), m[_N, hot] - np.bitwise_count(y & ~x).sum(axis=0, dtype=np.int64))
            fit[hot] = (100 + percent) * most >= percent * (q[_N, hot] + m[_N, hot])
        return fit

    def two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Runs of two rows, all at once."""
        swap = (a[_MEMBERS] > b[_MEMBERS]) | ((a[_MEMBERS] == b[_MEMBERS]) & ((a[_GRP] > b[_GRP]) | ((a[_GRP] == b[_GRP]) & (a[_FP] > b[_FP]))))
        q, m = np.where(swap, b, a), np.where(swap, a, b)
        return np.stack([q[_FP], q[_N], m[_GRP], m[_N], m[_N], np.maximum(q[_LIMITED], m[_LIMITED])])[:, may_link(q, m)]

    def many(rows: np.ndarray) -> np.ndarray:
        """A run of any length, in blocks of queries."""
        out = [np.zeros((len(_PAIRS), 0), np.int64)]
        if not (rows[_FLAGS] & FREE).any():
            return out[0]
        groups, at, inverse = np.unique(rows[_GRP], return_index=True, return_inverse=True)
        rank = np.empty(len(groups), np.int64)
        rank[np.lexsort((groups, rows[_MEMBERS][at]))] = np.arange(len(groups))
        order = np.argsort(rank[inverse], kind="stable")
        rows, rank = rows[:, order], rank[inverse][order]
        first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        count = np.diff(np.concatenate((first, [len(rank)])))
        low, high = np.minimum.reduceat(rows[_N], first), np.maximum.reduceat(rows[_N], first)
        free = np.maximum.reduceat(rows[_FLAGS] & FREE, first) > 0
        least, most = np.minimum.reduceat(rows[_CLUSTER], first), np.maximum.reduceat(rows[_CLUSTER], first)
        step = max(1, 1_000_000 // len(rank))
        for a in range(0, len(rank), step):
            block = rows[:, a : a + step]
            n = block[_N][:, None]
            fit = (rank[a : a + step, None] <= np.arange(len(first))) & (100 * n >= percent * low) & (100 * high >= percent * n)
            fit &= ((block[_FLAGS][:, None] & FREE > 0) & (n <= high)) | (free & (n >= low))
            fit &= (least != most) | (block[_CLUSTER][:, None] != least)
            q, g = np.nonzero(fit)
            if not len(q):
                continue
            # the members of these groups, one pair each
            size = count[g]
            pair = np.repeat(np.arange(len(q)), size)
            member = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + first[g][pair]
            good = may_link(block[:, q[pair]], rows[:, member])
            pair, member = pair[good], member[good]
            if not len(pair):
                continue
            starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            p, sizes = pair[starts], rows[_N][member]
            x = block[:, q[p]]
            out.append(np.stack([x[_FP], x[_N], rows[_GRP][first[g[p]]], np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts), np.maximum(x[_LIMITED], np.maximum.reduceat(rows[_LIMITED][member], starts))]))
        return np.concatenate(out, axis=1)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        rows = np.zeros((_SIG + SIGNATURE // 2, batch.num_rows), np.int64)
        for k, column in enumerate(batch.columns[:_SIG]):
            rows[k] = column.to_numpy(zero_copy_only=False)
        sig = batch.column(_SIG)
        some = np.flatnonzero(sig.is_valid().to_numpy(zero_copy_only=False))
        if len(some):
            rows[_SIG:, some] = np.frombuffer(b"".join(sig.drop_null().to_pylist()), np.int64).reshape(-1, SIGNATURE // 2).T
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in chain(batches, (None,)):
            found = [np.zeros((len(_PAIRS), 0), np.int64)]
            edges = np.zeros(1, np.int64)
            if batch is not None:
                if not batch.num_rows:
                    continue
                rows = matrix(batch)
                edges = np.concatenate(([0], np.flatnonzero((np.diff(rows[_T]) != 0) | (np.diff(rows[_CELL]) != 0)) + 1, [rows.shape[1]]))
                if held and (held[0][: _CELL + 1, 0] == rows[: _CELL + 1, 0]).all():
                    held.append(rows[:, edges[0] : edges[1]])
                    edges = edges[1:]
            if held and (batch is None or len(edges) > 1):
                whole = np.concatenate(held, axis=1)
                if whole[_CLUSTER].min() != whole[_CLUSTER].max():
                    found.append(many(whole))
                held = []
            if len(edges) > 1:
                inner = edges[:-1]
                # a run of one cluster opens nothing
                open_ = (np.minimum.reduceat(rows[_CLUSTER], inner) != np.maximum.reduceat(rows[_CLUSTER], inner))[:-1]
                size = np.diff(edges)[:-1]
                pair = inner[:-1][open_ & (size == 2)]
                found.append(two(rows[:, pair], rows[:, pair + 1]))
                found += [many(rows[:, inner[k] : edges[k + 1]]) for k in np.flatnonzero(open_ & (size > 2))]
                held = [rows[:, inner[-1] :]]
            out = np.concatenate(found, axis=1)
            for a in range(0, out.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in out], list(_PAIRS))

    return run


def _asks(keys: DataFrame, classes: DataFrame, clusters: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """fp, query, shared (buckets), near (whether their signatures leave a link possible): a class and queries of its buckets that are of other clusters."""
    placed = keys.withColumn("cluster", F.col("fp")) if clusters is None else keys.join(clusters.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "fp", "weight", F.coalesce("root", "fp").alias("cluster"))
    # at first the class that shares most bands with most others: it is likely to be what a group of near copies was made from
    rank = F.struct(F.col("weight") if turn == 0 else F.xxhash64("fp", F.lit(turn)).alias("weight"), "fp")
    per = placed.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("size"), F.max(rank).alias("hub"))
    big, other = F.max(F.struct("size", "hub", "cluster")), F.max(F.struct(F.xxhash64("cluster", F.lit(turn)).alias("size"), "hub", "cluster"))
    queries = written(per.groupBy("key").agg(F.array(big, other).alias("q"), F.count(F.lit(1)).alias("clusters")).where("clusters > 1").select("key", "q"), "queries")
    asks = placed.join(queries, "key").select("fp", "cluster", F.explode("q").alias("q")).where("cluster <> q.cluster")
    asks = asks.groupBy("fp", F.col("q.hub.fp").alias("query")).agg(F.count(F.lit(1)).alias("shared"))
    sized = classes.select("fp", "n", F.slice("marks", BANDS + 1, SIGNATURE).alias("s"))
    both = asks.join(sized, "fp").join(sized.select(F.col("fp").alias("query"), F.col("n").alias("m"), F.col("s").alias("t")), "query")
    lacks = lambda x, y: " + ".join(f"bit_count({x}[{k}] & ~{y}[{k}])" for k in range(SIGNATURE))
    near = F.expr(f"{100 + percent} * least(n - ({lacks('s', 't')}), m - ({lacks('t', 's')})) >= {percent} * (n + m)")
    return both.select("fp", "query", "shared", near.alias("near"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, fp (the class of equal sets), root (a class that stands for the component), component_id (the smallest doc_id that links lead to, its own included).

    Words are lower-cased (A-Z) and split at white space. Null, empty and blank
    texts have no shingles, are linked with nothing and are their own component.
    Repeated rows are equal texts and share a component; a null id takes part
    and never names a component unless all ids of it are null. An empty table
    gives no rows. Texts are read whole; no pair of classes is skipped.
    """
    d = id_text(docs, id_col, text_col)
    survey = written(d.mapInArrow(_survey(size), _SCAN), "survey")
    rows = survey.where("fp is not null").select("doc_id", "n", "fp", "marks")
    classes = written(rows.where("n > 0").groupBy("fp", "n").agg(F.min("marks").alias("marks"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least")), "classes")

    # 1. groups of similar texts
    keys = classes.select("fp", F.explode(F.slice("marks", 1, BANDS)).alias("key"))
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    keys = written(keys.join(shared, "key"), "keys")
    keys = written(keys.join(keys.groupBy("fp").agg(F.sum("members").alias("weight")), "fp").select("key", "fp", "weight"), "keys")
    links = clusters = bunch = tried = None
    for turn in range(TURNS):
        asks = written(_asks(keys, classes, clusters, turn, percent), "asks")
        if bunch is None:
            bunch = asks.groupBy("fp").agg(F.max(F.struct("shared", "query")).alias("q")).select("fp", F.col("q.query").alias("query"))
        asks = asks.where("near")
        asks = asks if tried is None else asks.join(tried, ["fp", "query"], "left_anti")
        best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("shared", "query")))), 1, ASKED)
        star = written(asks.groupBy("fp").agg(best.alias("q")).select("fp", F.explode("q.query").alias("query")), "star")
        if star.count() <= (WORTH if turn else 0) * classes.count():
            break
        tried = star if tried is None else tried.unionByName(star)
        star = star.join(star.groupBy("query").agg(F.count(F.lit(1)).alias("members")), "query")
        star = star.select("query", "fp", F.col("query").alias("grp"), F.pmod(F.xxhash64("fp"), F.ceil(F.col("members") / GROUP)).cast("int").alias("part"))
        more = written(_match(d, star.select("grp", "part", F.col("query").alias("fp")), star.select("grp", "part", "fp"), size, percent), "star-links")
        release(docs.sparkSession)
        if more.isEmpty():
            break
        links = more if links is None else links.unionByName(more)
        clusters = written(components(links), "clusters")
    links = docs.sparkSession.createDataFrame([], "a long, b long") if links is None else links
    clusters = docs.sparkSession.createDataFrame([], "node long, root long") if clusters is None else clusters

    # 2. the exact search between clusters
    often = survey.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT).toArrow()
    token, seen = often.column("token").to_numpy().view(np.uint64), often.column("seen").to_numpy()
    order = np.argsort(token)
    alone = bunch.join(clusters.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("fp").alias("cluster"), F.col("query").alias("of"))
    together = written(clusters.select(F.col("node").alias("fp"), F.col("root").alias("cluster"), F.col("root").alias("of")).unionByName(alone), "together")
    sized = written(together.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("blocks")), "sized")
    where = together.join(sized, "of").select("fp", "cluster", F.xxhash64("of", F.pmod(F.xxhash64("fp"), "blocks"), F.lit(2)).alias("grp"))
    where = written(where, "placed")
    where = written(where.join(where.groupBy("grp").agg(F.count(F.lit(1)).alias("members")), "grp"), "blocks")
    heads = _one_each(d.mapInArrow(_prefixes(size, percent, token[order], seen[order]), "fp long, n long, limited long, sig binary, head array<long>, codes array<long>"))
    placed = heads.hint("merge").join(where, "fp", "left").select(F.coalesce("grp", "fp").alias("grp"), F.coalesce("cluster", "fp").alias("cluster"), "fp", "n", F.coalesce("members", F.lit(1)).alias("members"), "limited", "sig", F.explode(F.arrays_zip("head", "codes")).alias("t"))
    tokens = placed.select(F.col("t.head").alias("token"), F.shiftright("t.codes", 4).alias("cell"), "grp", "cluster", "fp", "n", "members", "limited", F.expr("t.codes & 15").alias("flags"), F.expr(f"if((t.codes & {HOT_TOKEN}) > 0, sig, null)").alias("sig"))
    tokens = tokens.repartition("token", "cell").sortWithinPartitions("token", "cell")
    found = tokens.mapInArrow(_candidates(percent), ", ".join(f"{x} long" for x in _PAIRS)).groupBy("fp", "grp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("limited").alias("limited"))
    # Of two sets one's first tokens end first in the order: what they share is among these, c at most, or in the rest of that set
    bound = F.col("c") + F.col("limited") + F.ceil(percent * F.greatest("n", "high") / 100) - 1
    found = written(found.where((100 + percent) * bound >= percent * (F.col("n") + F.col("low"))).select("fp", "grp"), "candidates")
    release(docs.sparkSession)
    # a group that many ask is opened in several tasks, each with a share of its queries
    parts = written(found.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("parts")), "parts")
    queries = found.join(parts, "grp").select("grp", F.pmod(F.xxhash64("fp", F.lit(3)), "parts").cast("int").alias("part"), "fp")
    members = parts.join(where.select("grp", "fp"), "grp", "left").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.coalesce("fp", "grp").alias("fp"))
    joined = components(links.unionByName(_match(d, queries, members, size, percent)))

    # each class's smallest id, then its component's; the rows of a class only look it up
    reached = classes.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").where("docs > 1 or root is not null").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reached = written(reached, "reached")
    least = written(reached.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    label = written(reached.join(least, "root").select("fp", "root", "component_id"), "label")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    some = rows.where("n > 0").join(label, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), "fp", F.coalesce("root", "fp").alias("root"), component)
    return some.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "fp", F.col("fp").alias("root"), F.col("doc_id").alias("component_id")))


def fingerprints(docs: DataFrame, row: list[str], size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (as above; 0 without shingles) and ``row``, a struct of named columns of docs, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = pa.array(_prints(*shingle_sets(batch.column(1), size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, batch.column(2)], ["doc_id", "fp", "row"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*[docs[c] for c in row]).alias("row"))
    return d.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), d.schema["row"]]))


def op9_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = {
    "op9_token_groups": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""
}
