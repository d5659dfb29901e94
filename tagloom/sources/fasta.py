"""FASTA and FASTQ scans, path lists, and the test tables read as sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.sources.scratch import stored

#: Letters a..z to bases by code point modulo 4.
LETTERS = "".join(chr(97 + k) for k in range(26))
BASES = "".join("ACGT"[(97 + k) % 4] for k in range(26))


def letters(text: Column) -> Column:
    """The ASCII letters of a text; they are as many as its bases, so a length needs no sequence."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")


def letters_to_bases(text: Column) -> Column:
    """A text as a sequence: its ASCII letters, each as the base of its code point modulo 4."""
    return F.translate(letters(text), LETTERS.upper() + LETTERS, BASES + BASES)


def document_contigs(docs: DataFrame) -> DataFrame:
    """documents as contigs: genome_id is the source, contig_id the document."""
    text = F.col("text")
    return docs.select(F.col("source").alias("genome_id"), F.col("doc_id").alias("contig_id"), letters_to_bases(text).alias("seq"), F.length(letters(text)).cast("long").alias("length"))


def text_contigs(rows: DataFrame, genome: str, contig: str, text: str) -> DataFrame:
    """Any table of texts as contigs."""
    return rows.select(F.col(genome).cast("string").alias("genome_id"), F.col(contig).cast("long").alias("contig_id"), letters_to_bases(F.col(text)).alias("seq"), F.length(letters(F.col(text))).cast("long").alias("length"))


def read_fasta(spark: SparkSession, path: str | list[str], genome_from_stem: bool = True) -> DataFrame:
    """genome_id, contig_id, contig_name, seq, length of FASTA files, gzipped or not.

    A record is what stands between two '>' at line starts; several lines join;
    letters become upper case. contig_id counts the records of a file. genome_id
    is the file's stem, or the first word of its first record's name. Text before
    the first '>' is an error.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    bad = F.when(F.length(F.trim("value")) == 0, F.lit(False)).otherwise(~F.ltrim("value").startswith(">"))
    raw = raw.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("not FASTA: "), "file"))).otherwise(F.col("value")))
    records = raw.select("file", F.posexplode(F.filter(F.split("value", r"(?m)^>"), lambda x: F.length(F.trim(x)) > 0)).alias("contig_id", "record"))
    name = F.regexp_replace(F.substring_index("record", "\n", 1), "\r$", "")
    seq = F.upper(F.regexp_replace(F.when(F.instr("record", "\n") > 0, F.expr("substr(record, instr(record, '\n') + 1)")).otherwise(""), r"\s+", ""))
    stem = F.regexp_replace("file", r"(\.(fa|fasta|fna|fas))?(\.gz)?$", "")
    out = records.select("file", F.col("contig_id").cast("long").alias("contig_id"), name.alias("contig_name"), seq.alias("seq"), stem.alias("stem"))
    if genome_from_stem:
        out = out.withColumn("genome_id", F.col("stem"))
    else:
        first = out.where("contig_id = 0").select("file", F.substring_index("contig_name", " ", 1).alias("genome_id"))
        out = out.join(first, "file")
    return out.select("genome_id", "contig_id", "contig_name", "seq", F.length("seq").cast("long").alias("length"))


_CHUNKS = "file string, block long, nth long, record long, name string, at long, seq string"


def read_segments(spark: SparkSession, path: str | list[str], size: int = 1 << 20, genome_from_stem: bool = True) -> DataFrame:
    """genome_id, contig_id, contig_name, start, seq of FASTA files of any size: the records in segments of ``size`` bases.

    Lines are read by splits of a file, so that a file of many gigabytes, or one
    chromosome of it, is many tasks (a gzipped file is one, but never one row). A
    split says how many records begin in it and how many bases follow the last of
    them; sums over a file's splits make contig numbers and places of that.
    contig_id, names, letters and errors are those of ``read_fasta``.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one split after another, its lines in order
        split, record, name, at, nth, parts, held = None, 0, None, 0, 0, [], 0

        def chunk() -> tuple:
            nonlocal name, at, nth, parts, held
            out = (*split, nth, record, name, at, "".join(parts))
            name, at, nth, parts, held = None, at + held, nth + 1, [], 0
            return out

        for batch in batches:
            rows = []
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != split:
                    if split is not None:
                        rows.append(chunk())
                    split, record, name, at, nth = (file, block), 0, None, 0, 0
                if line.startswith(">"):
                    if held or record or nth:
                        rows.append(chunk())
                    record, name, at = record + 1, line[1:], 0
                    continue
                bases = "".join(line.split())
                if bases and not record and not block:
                    raise ValueError(f"not FASTA: {file}")
                parts.append(bases)
                held += len(bases)
                if held >= size:
                    rows.append(chunk())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))], [x.split()[0] for x in _CHUNKS.split(", ")])
        if split is not None:
            last = chunk()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], [x.split()[0] for x in _CHUNKS.split(", ")])

    chunks = stored(lines.mapInArrow(run, _CHUNKS), "segments")
    n = F.length("seq").cast("long")
    splits = chunks.groupBy("file", "block").agg(F.max("record").alias("records"), F.max_by(F.struct("at", n.alias("n")), F.struct("record", "nth")).alias("last"))
    splits = splits.select("file", "block", "records", (F.col("last.at") + F.col("last.n")).alias("tail"))
    order = Window.partitionBy("file").orderBy("block")
    splits = splits.withColumn("run", F.sum((F.col("records") > 0).cast("int")).over(order)).withColumn("sum", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
    splits = splits.select("file", "block", (F.sum("records").over(order) - F.col("records")).alias("before"), F.coalesce(F.lag("sum").over(order), F.lit(0)).alias("carried"))
    stem = F.regexp_replace("file", r"(\.(fa|fasta|fna|fas))?(\.gz)?$", "")
    out = chunks.join(splits, ["file", "block"]).where("before + record > 0").select("file", (F.col("before") + F.col("record") - 1).alias("contig_id"), F.col("name").alias("contig_name"), (F.col("at") + F.when(F.col("record") == 0, F.col("carried")).otherwise(0)).alias("start"), F.upper("seq").alias("seq"))
    if genome_from_stem:
        return out.select(stem.alias("genome_id"), "contig_id", "contig_name", "start", "seq")
    first = out.where("contig_id = 0 and contig_name is not null").select("file", F.substring_index("contig_name", " ", 1).alias("genome_id"))
    return out.join(first, "file").select("genome_id", "contig_id", "contig_name", "start", "seq")


def segment_contigs(segments: DataFrame) -> DataFrame:
    """genome_id, contig_id, contig_name, length of the contigs of segments."""
    return segments.groupBy("genome_id", "contig_id").agg(F.max("contig_name").alias("contig_name"), F.sum(F.length("seq")).alias("length"))


def cut_segments(contigs: DataFrame, size: int = 1 << 20) -> DataFrame:
    """Contigs (genome_id, contig_id, seq) cut into segments of ``size`` bases; an empty one is one empty segment."""
    places = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))
    return contigs.select("genome_id", "contig_id", "seq", F.explode(places).alias("start")).select("genome_id", "contig_id", F.col("start").cast("long").alias("start"), F.expr(f"substr(seq, start + 1, {size})").alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """genome_id (stem), contig_id, contig_name, seq, length of four-line FASTQ records."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = raw.select("file", F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    rec = lines.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 4).cast("int"))).alias("contig_id"), "l").where(F.size("l") >= 4 * F.col("contig_id") + 4)
    head, seq = F.get("l", 4 * F.col("contig_id")), F.get("l", 4 * F.col("contig_id") + 1)
    stem = F.regexp_replace("file", r"(\.(fq|fastq))?(\.gz)?$", "")
    return rec.select(stem.alias("genome_id"), F.col("contig_id").cast("long").alias("contig_id"), F.when(head.startswith("@"), F.expr("substr(l[4 * contig_id], 2)")).otherwise(F.raise_error(F.lit("not FASTQ"))).alias("contig_name"), F.upper(seq).alias("seq"), F.length(seq).cast("long").alias("length"))


def read_paths(spark: SparkSession, path: str) -> list[str]:
    """Lines of a path list without blank ones (a list of inputs is bounded by what one names on a command line)."""
    return [r.value.strip() for r in spark.read.text(path).where(F.trim("value") != "").collect()]
