"""In-silico digestion: contigs to fixed-length tags around recognition patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.sequence import IUPAC_BASES, canonical
from tagloom.operators.enzymes import LONGEST_TAG, Enzyme, MarginEnzyme, resolve
from tagloom.sources.scratch import spread

_BITS = np.zeros(256, np.uint8)
for _k, _b in enumerate("ACGT"):
    _BITS[ord(_b)] = _BITS[ord(_b.lower())] = 1 << _k
TAGS = "genome_id string, contig_id long, enzyme string, position long, tag string"


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_ASCII = re.compile("[^\x00-\x7f]")


def _bytes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, upper-case bytes) of a column of sequences, one byte a letter; null counts as empty."""
    seqs = pc.fill_null(seqs.cast(pa.large_string()), "")
    if pc.any(pc.not_equal(pc.binary_length(seqs), pc.utf8_length(seqs))).as_py():
        seqs = pa.array([_ASCII.sub("N", s) for s in seqs.to_pylist()], pa.large_string())
    _, offsets, data = seqs.buffers()
    at = np.frombuffer(offsets, np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], _UPPER[raw]


#: Bases that are scanned at once (one contig at least): the arrays beside them take some hundred bytes a base.
SLICE = 1 << 20


def _slices(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches (genome_id, contig_id, seq, ...) so that a scan's arrays do not grow with a batch."""
    most = SLICE if most is None else most
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def positions(bits: np.ndarray, enzyme: Enzyme, impure: np.ndarray) -> np.ndarray:
    """Starts of windows that match a pattern of the enzyme, overlapping ones too, each once.

    bits: base bits of a sequence, or of several end to end; impure: running
    count of other letters.
    """
    n = len(bits) - enzyme.tag_len + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = []
    for pattern in enzyme.patterns:
        at = None
        for offset, bases in sorted(pattern, key=lambda p: len(p[1])):
            mask = np.uint8(sum(1 << "ACGT".index(b) for b in bases))
            if at is None:
                at = np.flatnonzero(bits[offset : offset + n] & mask)
            else:
                at = at[(bits[at + offset] & mask) > 0]
        found.append(at)
    out = np.unique(np.concatenate(found))
    return out[impure[out + enzyme.tag_len] == impure[out]]


def digest(contigs: DataFrame, panel: list[Enzyme] | None = None) -> DataFrame:
    """Tags (genome_id, contig_id, enzyme, position, tag) of contigs (genome_id, contig_id, seq).

    A batch of contigs is scanned end to end, once for all enzymes; windows that
    cross from one contig to the next are none. Lower-case bases count as upper
    case; windows with other letters have no tag; null sequences have none. Where
    contigs have a column ``start``, a sequence begins at that place of its contig.
    """
    panel = resolve() if panel is None else panel
    start = F.col("start").cast("long") if "start" in contigs.columns else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            offsets, raw = _bytes(batch.column(2))
            bits = _BITS[raw]
            impure = np.concatenate(([0], np.cumsum(bits == 0)))
            first = batch.column(3).to_numpy(zero_copy_only=False)
            for e in panel:
                at = positions(bits, e, impure)
                row = np.searchsorted(offsets, at, side="right") - 1
                inside = at + e.tag_len <= offsets[row + 1]
                at, row = at[inside], row[inside]
                if not len(at):
                    continue
                letters = np.ascontiguousarray(raw[at[:, None] + np.arange(e.tag_len)])
                ends = np.arange(0, letters.size + 1, e.tag_len, dtype=np.int32)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([e.name] * len(at), pa.string()), pa.array(at - offsets[row] + first[row]), pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(letters))], ["genome_id", "contig_id", "enzyme", "position", "tag"])

    return spread(contigs.select(F.col("genome_id").cast("string"), F.col("contig_id").cast("long"), F.col("seq").cast("string"), start)).mapInArrow(run, TAGS)


def digest_segments(segments: DataFrame, panel: list[Enzyme] | None = None) -> DataFrame:
    """The tags of contigs cut into segments (genome_id, contig_id, start, seq): those of the whole contigs.

    Every window belongs to the segment that it starts in. Those that end there
    are found in place; those that reach beyond, in the segment's last bases with
    the first ones of the segments that follow. Only these ends are shuffled, so a
    chromosome is as many tasks as it has segments.
    """
    panel = resolve() if panel is None else panel
    reach = max((e.tag_len for e in panel), default=1) - 1
    if not reach:
        return digest(segments, panel)
    ends = segments.select("genome_id", "contig_id", "start", F.length("seq").cast("long").alias("n"), F.substring("seq", 1, reach).alias("head"), F.right("seq", F.lit(reach)).alias("tail")).where("n > 0")
    # a segment shorter than the reach is its own head, and the next ones' heads go on where it ends
    after = Window.partitionBy("genome_id", "contig_id").orderBy("start").rowsBetween(1, reach)
    ends = ends.select("genome_id", "contig_id", (F.col("start") + F.col("n") - F.length("tail")).alias("start"), F.length("tail").alias("own"), "tail", F.substring(F.array_join(F.collect_list("head").over(after), ""), 1, reach).alias("next")).where("next <> ''")
    over = digest(ends.select("genome_id", "contig_id", "start", F.concat("tail", "next").alias("seq")), panel)
    edges = ends.select("genome_id", "contig_id", (F.col("start") + F.col("own")).alias("edge"))
    over = over.withColumn("edge", F.explode(F.sequence(F.col("position") + 1, F.col("position") + F.length("tag") - 1))).join(edges, ["genome_id", "contig_id", "edge"])
    # a window over several edges is found at each of them
    return digest(segments, panel).unionByName(over.select("genome_id", "contig_id", "enzyme", "position", "tag").distinct())


def margin_digest(contigs: DataFrame, enzymes: list[MarginEnzyme]) -> DataFrame:
    """Tags of enzymes given by two anchors and margins: genome_id, contig_id, enzyme, position, strand, tag.

    position is where the site begins. A tag is the site with the margins, its
    first 32 bases at most; one that the contig's start cuts is shorter, one that
    its end cuts is none, and so is one with other letters than A, C, G, T. Sites
    of the reverse strand, whose tags are reverse-complemented, are found on
    their own; where both strands have a site, the forward one counts. Contigs
    shorter than ``tag_len`` and null sequences have no tags.
    """
    mask = {code: np.uint8(sum(1 << "ACGT".index(b) for b in bases)) for code, bases in IUPAC_BASES.items()}
    other = np.zeros(256, np.uint8)
    other[list(b"ACGT")] = list(b"TGCA")

    def sites(bits: np.ndarray, left: str, right: str, spacer: int) -> np.ndarray:
        n = len(bits) - len(left) - spacer - len(right) + 1
        at = np.arange(max(n, 0))
        for k, code in [*enumerate(left), *enumerate(right, len(left) + spacer)]:
            at = at[(bits[at + k] & mask[code]) > 0]
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            offsets, raw = _bytes(batch.column(2))
            bits = _BITS[raw]
            impure = np.concatenate(([0], np.cumsum(bits == 0)))
            for e in enzymes:
                size = len(e.left) + e.spacer + len(e.right)
                if not size:
                    continue
                found = []
                for strand, left, right, lead, tail in (("+", e.left, e.right, e.left_margin, e.right_margin), ("-", *e.reverse_anchors, e.right_margin, e.left_margin)):
                    at = sites(bits, left.upper(), right.upper(), e.spacer)
                    row = np.searchsorted(offsets, at, side="right") - 1
                    start, end = np.maximum(at - lead, offsets[row]), at + size + tail
                    ok = (end <= offsets[row + 1]) & (offsets[row + 1] - offsets[row] >= e.tag_len)
                    ok[ok] = impure[end[ok]] == impure[start[ok]]
                    found += [(int(a), strand, int(r), int(s), min(int(t - s), LONGEST_TAG)) for a, r, s, t in zip(at[ok], row[ok], start[ok], end[ok])]
                sites_ = {}
                for hit in found:
                    sites_.setdefault(hit[0], hit)
                rows = [sites_[a] for a in sorted(sites_)]
                letters = [raw[s : s + n] if strand == "+" else other[raw[s : s + n]][::-1] for _, strand, _, s, n in rows]
                of = pa.array([r[2] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array([e.name] * len(rows), pa.string()), pa.array([r[0] - int(offsets[r[2]]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([x.tobytes().decode() for x in letters], pa.string())], ["genome_id", "contig_id", "enzyme", "position", "strand", "tag"])

    return spread(contigs.select(F.col("genome_id").cast("string"), F.col("contig_id").cast("long"), F.col("seq").cast("string"))).mapInArrow(run, "genome_id string, contig_id long, enzyme string, position long, strand string, tag string")


def with_canonical(tags: DataFrame) -> DataFrame:
    return tags.withColumn("canonical", canonical(F.col("tag")))


def occurrence_counts(tags: DataFrame) -> DataFrame:
    """How often each canonical tag occurs in its genome: genome_id, canonical, n."""
    return with_canonical(tags).groupBy("genome_id", "canonical").agg(F.count(F.lit(1)).alias("n"))


def with_occurrences(tags: DataFrame) -> DataFrame:
    """Tags with canonical and n, its occurrences in the genome."""
    return with_canonical(tags).join(occurrence_counts(tags), ["genome_id", "canonical"])


def rank_tags(tags: DataFrame, panel: list[Enzyme] | None = None) -> DataFrame:
    """tag_rank from 0 by contig and position over a genome's tags; at one position by the order of the panel."""
    order = {e.name: k for k, e in enumerate(resolve() if panel is None else panel)}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("enzyme"))
    return tags.withColumn("tag_rank", (F.row_number().over(Window.partitionBy("genome_id").orderBy("contig_id", "position", place)) - 1).cast("long"))


def rank_in_contig(tags: DataFrame, panel: list[Enzyme] | None = None) -> DataFrame:
    """tag_rank from 0 by position within a contig: what counts the tags that a step on it skips; at one position by the order of the panel, then the name."""
    order = {e.name: k for k, e in enumerate(resolve() if panel is None else panel)}
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("enzyme")), F.lit(len(order)))
    return tags.withColumn("tag_rank", (F.row_number().over(Window.partitionBy("genome_id", "contig_id").orderBy("position", place, "enzyme")) - 1).cast("long"))


_CODE = np.zeros(256, np.int64)
for _k, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _k


def _canonical(raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(canonical k-mer, whether it has bases only) of every window of k upper-case bytes or more."""
    n = len(raw) - k + 1
    impure = np.concatenate(([0], np.cumsum(_BITS[raw] == 0)))
    # words of 1, 2, 4, ... bases and their complements; those that k is the sum of stand end to end
    ahead = _CODE[raw]
    behind, width, done, rest = 3 - ahead, 1, 0, k
    forward, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    while rest:
        if rest & 1:
            forward = forward << 2 * width | ahead[done : done + n]
            back |= behind[done : done + n] << 2 * done
            done += width
        rest >>= 1
        if rest:
            ahead = ahead[:-width] << 2 * width | ahead[width:]
            behind = behind[:-width] | behind[width:] << 2 * width
            width *= 2
    return np.minimum(forward, back), impure[k:] == impure[:-k]


def _windows(offsets: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(canonical k-mer, its sequence's number, whether it has bases only and lies in one sequence) of every window."""
    x, ok = _canonical(raw, k)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(x)]
    return x, row, ok & (np.arange(len(x)) + k <= offsets[row + 1])


def canonical_kmers(sequence: str, k: int) -> np.ndarray:
    """The canonical k-mers of one sequence, as in ``kmers``, repeats too."""
    _, raw = _bytes(pa.array([sequence], pa.string()))
    if len(raw) < k:
        return np.zeros(0, np.int64)
    x, ok = _canonical(raw, k)
    return x[ok]


def kmers(contigs: DataFrame, k: int = 15, places: bool = False) -> DataFrame:
    """Distinct canonical k-mers of each contig (genome_id, contig_id, kmer), k at most 31; windows with other letters are skipped. With ``places`` every one, and where it starts (position).

    kmer is a number: two bits a base, of the strand with the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            offsets, raw = _bytes(batch.column(2))
            n = len(raw) - k + 1
            if n <= 0:
                continue
            x, row, ok = _windows(offsets, raw, k)
            if places:
                of = pa.array(row[ok])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(x[ok]), pa.array(np.flatnonzero(ok) - offsets[row[ok]])], ["genome_id", "contig_id", "kmer", "position"])
                continue
            row, x = row[ok], x[ok]
            order = np.lexsort((x, row))
            row, x = row[order], x[order]
            new = np.ones(len(x), bool)
            new[1:] = (np.diff(row) > 0) | (np.diff(x) != 0)
            rows = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x[new])], ["genome_id", "contig_id", "kmer"])

    return spread(contigs.select(F.col("genome_id").cast("string"), F.col("contig_id").cast("long"), F.col("seq").cast("string"))).mapInArrow(run, "genome_id string, contig_id long, kmer long" + (", position long" if places else ""))


#: Bits of a k-mer that tell its place in a bin (24 at most), and the k-mers that a task holds before it hands their bins on.
BIN_BITS, HELD = 20, 1 << 21


def kmer_bins(contigs: DataFrame, k: int = 15) -> DataFrame:
    """bin, number, low, high: canonical k-mers of contigs (number, seq), k at most 15, the bin being a k-mer's upper bits and its place there the lower ones.

    low has two bytes of each place, high, whose bytes are runs, the third. A row has each of its
    k-mers once, sorted; a number's rows of one bin may repeat each other's.
    """
    bits = min(BIN_BITS, 2 * k)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        # a sort and a comparison: some fifty times as fast as numpy's unique here
        x = np.concatenate(held)
        x.sort()
        x = x[np.diff(x, prepend=-1) != 0]
        of = x >> bits
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(starts, len(x))
        place = x & ((1 << bits) - 1)
        low, high = (pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(v)]) for v in (place.astype("<u2"), (place >> 16).astype(np.uint8)))
        of = of[starts]
        return pa.RecordBatch.from_arrays([pa.array((of & ((1 << (2 * k - bits)) - 1)).astype(np.int32)), pa.array((of >> (2 * k - bits)).astype(np.int32)), low, high], ["bin", "number", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in _slices(batches):
            offsets, raw = _bytes(batch.column(2))
            if len(raw) < k:
                continue
            x, row, ok = _windows(offsets, raw, k)
            held.append(batch.column(0).to_numpy()[row[ok]] << (2 * k) | x[ok])
            n += len(held[-1])
            if n >= HELD:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return spread(contigs.select(F.col("number").cast("long"), F.lit(0), F.col("seq").cast("string"))).mapInArrow(run, "bin int, number int, low binary, high binary")
