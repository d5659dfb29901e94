"""Sketches: tags stored once per genome, as Parquet and as a binary container (magic S2BA)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.sequence import gc_content, unpack
from tagloom.operators.enzymes import get

SKETCH = ("genome_id", "contig_id", "contig_name", "contig_len", "gc", "enzyme", "position", "tag")
MAGIC, VERSION = b"S2BA", 2


def sketch(contigs: DataFrame, tags: DataFrame) -> DataFrame:
    """One row a tag, and one without tag for a contig that has none, so that lengths survive."""
    name = F.col("contig_name") if "contig_name" in contigs.columns else F.col("contig_id").cast("string")
    c = contigs.select("genome_id", "contig_id", name.alias("contig_name"), F.col("length").alias("contig_len"), gc_content(F.col("seq")).alias("gc"))
    return c.join(tags, ["genome_id", "contig_id"], "left").select(*SKETCH)


def write_sketches(sketches: DataFrame, path: str, mode: str = "error") -> None:
    """A database: Parquet partitioned by genome, so that one genome is added, replaced or read alone."""
    sketches.write.mode(mode).partitionBy("genome_id").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).select(*[F.col(c).cast("string").alias(c) if c == "genome_id" else F.col(c) for c in SKETCH])


def tags_of(sketches: DataFrame) -> DataFrame:
    return sketches.where("tag is not null").select("genome_id", "contig_id", "enzyme", "position", "tag")


def contigs_of(sketches: DataFrame) -> DataFrame:
    return sketches.select("genome_id", "contig_id", "contig_name", F.col("contig_len").alias("length"), "gc").distinct()


def one_enzyme_tags(packed: DataFrame, enzyme: str, genome_id: str = "sketch", length: int = 32) -> DataFrame:
    """Tags (with strand) of packed rows (position, bits, direction: 0 is forward) without an enzyme table: all of one enzyme, on contig 0."""
    strand = F.when(F.col("direction") == 0, "+").otherwise("-").alias("strand")
    return packed.select(F.lit(genome_id).alias("genome_id"), F.lit(0).cast("long").alias("contig_id"), F.lit(enzyme).alias("enzyme"), F.col("position").cast("long").alias("position"), unpack(F.col("bits"), length).alias("tag"), strand)


def refuse_equal_names(contigs: DataFrame, by: str = "source_file") -> None:
    """Two inputs of one name would overwrite each other."""
    twice = contigs.select("genome_id", by).distinct().groupBy("genome_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several inputs are named {twice[0].genome_id}")


def db_list(sketches: DataFrame) -> DataFrame:
    """genome_id, n_contigs, tag_count, gc (weighted by length, four decimals)."""
    c = contigs_of(sketches).groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_contigs"), F.round(F.sum(F.col("gc") * F.col("length")) / F.greatest(F.sum("length"), F.lit(1)), 4).alias("gc"))
    t = sketches.groupBy("genome_id").agg(F.count("tag").alias("tag_count"))
    return c.join(t, "genome_id").select("genome_id", "n_contigs", "tag_count", "gc")


def db_add(database: DataFrame, new: DataFrame) -> DataFrame:
    """Genomes of ``new`` replace those of the same name."""
    return database.join(new.select("genome_id").distinct(), "genome_id", "left_anti").select(*SKETCH).unionByName(new.select(*SKETCH))


def db_remove(database: DataFrame, names: list[str]) -> DataFrame:
    """Without the named genomes; unknown names change nothing."""
    return database.where(~F.col("genome_id").isin(names)) if names else database


def db_merge(databases: list[DataFrame]) -> DataFrame:
    """The union; of equal genomes the later database's."""
    tagged = [d.select(*SKETCH, F.lit(k).alias("_at")) for k, d in enumerate(databases)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    last = out.groupBy("genome_id").agg(F.max("_at").alias("_at"))
    return out.join(last, ["genome_id", "_at"], "left_semi").select(*SKETCH)


# --- the binary container --------------------------------------------------------------------


def _text(s: str) -> bytes:
    b = s.encode()
    return struct.pack("<I", len(b)) + b


def _packed(tag: str) -> int:
    return sum(max("ACGT".find(c), 0) << (2 * k) for k, c in enumerate(tag[:32]))


#: Fields after the magic, little-endian. Texts are a u32 length and UTF-8 bytes.
#: version u32; genome text; n u32, n times (enzyme text, tag length u8, site length u8);
#: n u32, n times (contig text, length u64, gc f64, m u32, m times (position u64, packed tag u64, strand u8, enzyme u16));
#: total length u64, gc f64, number of tags u64.
_ENZYME, _CONTIG, _TAG, _TRAILER = "<BB", "<QdI", "<QQBH", "<QdQ"


def encode_sketch(genome_id: str, panel: list[str], contigs: list[tuple[str, int, float, list[tuple[int, str, str]]]]) -> bytes:
    """A container of contigs (name, length, gc, tags (position, bases, enzyme)); tags have the forward strand."""
    out = [MAGIC, struct.pack("<I", VERSION), _text(genome_id), struct.pack("<I", len(panel))]
    for e in map(get, panel):
        out += [_text(e.name), struct.pack(_ENZYME, e.tag_len, len(e.left) + len(e.right))]
    out.append(struct.pack("<I", len(contigs)))
    n, total, gc_bases = 0, 0, 0.0
    for name, length, gc, tags in contigs:
        out += [_text(name), struct.pack(_CONTIG, length, gc, len(tags))]
        out += [struct.pack(_TAG, p, _packed(t), 0, panel.index(e)) for p, t, e in tags]
        n, total, gc_bases = n + len(tags), total + length, gc_bases + gc * length
    return b"".join([*out, struct.pack(_TRAILER, total, gc_bases / max(total, 1), n)])


def decode_sketch(data: bytes) -> tuple[str, list[tuple]]:
    """(genome_id, rows of contig_id, contig_name, contig_len, gc, enzyme, position, tag).

    Tag lengths come from the container's own enzyme table; version 1 has none
    and is refused, as is an enzyme number beyond the table.
    """
    at = 0

    def take(fmt: str) -> tuple:
        nonlocal at
        v = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return v

    def text() -> str:
        nonlocal at
        (n,) = take("<I")
        s = data[at : at + n].decode("utf-8", "replace")
        at += n
        return s

    if data[:4] != MAGIC:
        raise ValueError("not a sketch")
    at = 4
    (version,) = take("<I")
    if version != VERSION:
        raise ValueError(f"sketch version {version} has no enzyme table" if version == 1 else f"unknown sketch version {version}")
    genome = text()
    panel = []
    for _ in range(take("<I")[0]):
        name = text()
        panel.append((name, min(take(_ENZYME)[0], 32)))
    rows = []
    for c in range(take("<I")[0]):
        name = text()
        length, gc, n = take(_CONTIG)
        for _ in range(n):
            p, bits, _, e = take(_TAG)
            if e >= len(panel):
                raise ValueError(f"enzyme number {e} is not in the table")
            enzyme, size = panel[e]
            rows.append((c, name, length, gc, enzyme, p, "".join("ACGT"[bits >> (2 * k) & 3] for k in range(size))))
        if not n:
            rows.append((c, name, length, gc, None, None, None))
    return genome, sorted(rows, key=lambda r: (r[0], r[5] or 0))


def export_sketches(sketches: DataFrame) -> DataFrame:
    """genome_id, content: the binary container of each genome (a genome's tags are in one row)."""

    def run(key: tuple, pdf):
        panel = sorted(set(pdf.enzyme.dropna()))
        contigs = []
        for (_, name, length, gc), g in pdf.sort_values(["contig_id", "position"]).groupby(["contig_id", "contig_name", "contig_len", "gc"], sort=True):
            contigs.append((name, int(length), float(gc), [(int(p), t, e) for p, t, e in zip(g.position, g.tag, g.enzyme) if isinstance(t, str)]))
        return pd.DataFrame({"genome_id": [key[0]], "content": [encode_sketch(key[0], panel, contigs)]})

    return sketches.groupBy("genome_id").applyInPandas(run, "genome_id string, content binary")


def import_sketches(binary: DataFrame, content: str = "content") -> DataFrame:
    """Rows of a sketch table from binary containers, as from ``spark.read.format('binaryFile')``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for cell in batch.column(0):
                genome, rows = decode_sketch(cell.as_py())
                rows = [(genome, *r) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(SKETCH))

    return binary.select(content).mapInArrow(run, "genome_id string, contig_id long, contig_name string, contig_len long, gc double, enzyme string, position long, tag string")

