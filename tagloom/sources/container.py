"""``spark.read.format("s2ba")``: folders of sketch containers as a data source, one file a genome.

    register(spark)
    spark.read.format("s2ba").load("/shared/sketches")
    sketches.repartition("genome_id").write.format("s2ba").mode("append").save("/shared/sketches")

Files are read where they lie, several to a partition, and only the columns asked
for reach Spark as Arrow columns. A folder without containers is an error. What is
written stands beside its place until the job commits, so that a failed or killed
job changes nothing that readers see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tagloom.sources.sketch import SKETCH, decode_sketch, encode_sketch

SUFFIX = ".s2ba"
SCHEMA = "genome_id string, contig_id long, contig_name string, contig_len long, gc double, enzyme string, position long, tag string"
_TYPES = dict(zip(SKETCH, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.string()], strict=True))
#: Bytes of files that one partition reads, one file at least.
PARTITION = 64 << 20


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def containers(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a folder's containers in the order of their names, or of one container; without any it is an error."""
    fs, at = _place(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [(at, fs.get_file_info(at).size)]
    found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.File and f.path.endswith(SUFFIX))
    if not found:
        raise ValueError(f"{path} holds no {SUFFIX} sketches")
    return found


@dataclass
class Files(InputPartition):
    files: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[Files]:
        out, room = [], 0
        for file, size in containers(self.path):
            if not out or size > room:
                out.append(Files([]))
                room = PARTITION
            out[-1].files.append(file)
            room -= size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(self.path)
        for file in partition.files:
            with fs.open_input_stream(file) as f:
                genome, rows = decode_sketch(f.read())
            whole = [(genome, *r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[SKETCH.index(c)] for r in whole], _TYPES[c]) for c in self.columns], self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file stands, where it belongs


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        """A task's genomes, each whole: rows of one genome in two tasks make the commit fail."""
        fs, at = _place(self.path)
        genomes: dict[str, dict] = {}
        for row in iterator:
            contig = genomes.setdefault(row.genome_id, {}).setdefault((row.contig_id, row.contig_name, row.contig_len, row.gc), [])
            if row.tag is not None:
                contig.append((row.position, row.tag, row.enzyme))
        pending = f"{at}/_pending-{self.job}"
        files = []
        for genome, own in genomes.items():
            panel = sorted({e for tags in own.values() for _, _, e in tags})
            body = encode_sketch(genome, panel, [(name, length, gc, sorted(tags)) for (_, name, length, gc), tags in sorted(own.items())])
            fs.create_dir(pending, recursive=True)
            standing = f"{pending}/{uuid.uuid4().hex}"
            with fs.open_output_stream(standing) as f:
                f.write(body)
            files.append((standing, f"{at}/{genome}{SUFFIX}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _place(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("a genome was written by several tasks: repartition by genome_id first")
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.path.endswith(SUFFIX) and f.path not in {to for _, to in files}:
                    fs.delete_file(f.path)
        for standing, to in files:
            fs.move(standing, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _place(self.path)
        pending = f"{at}/_pending-{self.job}"
        if fs.get_file_info(pending).type == pafs.FileType.Directory:
            fs.delete_dir(pending)


class SketchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "s2ba"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        unknown = set(schema.names) - set(SKETCH)
        if unknown:
            raise ValueError(f"a sketch has no column {', '.join(sorted(unknown))}")
        return Reader(self.options["path"], list(schema.names))

    def writer(self, schema, overwrite: bool) -> Writer:
        missing = set(SKETCH) - set(schema.names)
        if missing:
            raise ValueError(f"a sketch needs the columns {', '.join(sorted(missing))}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SketchSource)
