"""A sketch database: tags in Parquet, with commits that replace genomes at once and remember the panel.

    <path>/data/part=<id>/      rows of SKETCH, written once, never changed
    <path>/manifests/<id>/      genome_id, part: where each genome's rows of a state lie
    <path>/commits/n=<k>/       one row: panel and manifest of state k

A state exists when its commit does, which is written last, after its data and its
manifest; a write that dies before leaves the state before as it was, and some files
that nothing names. Two writers that start from one state both write the commit of
the same number, and the second one fails.
"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.digest import digest
from tagloom.operators.enzymes import DEFAULT_PANEL, resolve
from tagloom.sources.sketch import SKETCH, sketch

SCHEMA = "contig_id long, contig_name string, contig_len long, gc double, enzyme string, position long, tag string, genome_id string, part string"


def other_panels(sketches: DataFrame, panel: list[str]) -> DataFrame:
    """genome_id, enzymes of the genomes whose tags are not of just this panel: only what both sides have counts in a comparison."""
    own = sketches.where("tag is not null").groupBy("genome_id").agg(F.sort_array(F.collect_set("enzyme")).alias("enzymes"))
    return own.where(F.col("enzymes") != F.array(*map(F.lit, sorted(panel))))


def warn_of_other_panels(sketches: DataFrame, panel: list[str]) -> int:
    """The number of such genomes, with a warning if there are any."""
    n = other_panels(sketches, panel).count()
    if n:
        warnings.warn(f"{n} sketches have tags of another panel than {', '.join(panel)}: only shared enzymes count", stacklevel=2)
    return n


@dataclass
class SketchDatabase:
    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _commits(self) -> DataFrame | None:
        return self._read("commits", "panel array<string>, manifest string, n long")

    def state(self) -> tuple[int, list[str]]:
        """Number and panel of the last commit; 0 and the default panel before the first."""
        commits = self._commits()
        last = commits.orderBy(F.desc("n")).first() if commits is not None else None
        return (last.n, list(last.panel)) if last else (0, list(DEFAULT_PANEL))

    def _manifest(self, n: int) -> DataFrame:
        if not n:
            return self.spark.createDataFrame([], "genome_id string, part string")
        return self._read(f"manifests/{self._commits().where(F.col('n') == n).first().manifest}", "genome_id string, part string")

    def read(self, n: int | None = None) -> DataFrame:
        """The sketch rows of a state, the last one unless another is named."""
        rows = self._read("data", SCHEMA)
        if rows is None:
            return self.spark.createDataFrame([], SCHEMA).select(*SKETCH)
        return rows.join(self._manifest(self.state()[0] if n is None else n), ["genome_id", "part"], "left_semi").select(*SKETCH)

    def genomes(self) -> DataFrame:
        return self._manifest(self.state()[0]).select("genome_id")

    def _commit(self, before: int, manifest: DataFrame, panel: list[str]) -> int:
        n, name = before + 1, uuid.uuid4().hex
        manifest.write.parquet(f"{self.path}/manifests/{name}")
        self.spark.createDataFrame([(panel, name)], "panel array<string>, manifest string").coalesce(1).write.mode("error").parquet(f"{self.path}/commits/n={n}")
        return n

    def put(self, sketches: DataFrame, panel: list[str] | None = None) -> int:
        """Genomes of ``sketches`` replace those of the same name, all at once; the number of the new state."""
        before, own = self.state()
        part = uuid.uuid4().hex
        # genomes side by side in few files, so that one is found by the files' statistics
        sketches.select(*SKETCH).repartitionByRange("genome_id").sortWithinPartitions("genome_id", "contig_id", "position").write.parquet(f"{self.path}/data/part={part}")
        new = self.spark.read.parquet(f"{self.path}/data/part={part}").select("genome_id").distinct()
        kept = self._manifest(before).join(new, "genome_id", "left_anti")
        return self._commit(before, kept.unionByName(new.withColumn("part", F.lit(part))), panel or own)

    def add(self, contigs: DataFrame) -> int:
        """Genomes of contigs, digested with the database's own panel; that of an empty one is the default."""
        panel = self.state()[1]
        return self.put(sketch(contigs, digest(contigs, resolve(panel))), panel)

    def remove(self, names: list[str]) -> int:
        """Without the named genomes; unknown names change nothing."""
        before, panel = self.state()
        return self._commit(before, self._manifest(before).where(~F.col("genome_id").isin(names)), panel)

    def merge(self, others: list[SketchDatabase]) -> int:
        """With the genomes of other databases; of equal ones the last database's. Databases of another panel give a warning."""
        panel = self.state()[1]
        for other in others:
            if sorted(other.state()[1]) != sorted(panel):
                warnings.warn(f"{other.path} has another panel: only shared enzymes count", stacklevel=2)
            self.put(other.read(), panel)
        return self.state()[0]
