"""Digest contigs as they arrive and append them to a sketch database (an extension: the measure itself is a batch one)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.digest import digest
from tagloom.operators.enzymes import DEFAULT_PANEL, resolve
from tagloom.sources.sketch import sketch


def ingest(contigs: DataFrame, database: str, checkpoint: str, panel: list[str] = list(DEFAULT_PANEL), **trigger) -> StreamingQuery:
    """A query that writes each micro-batch of contigs (genome_id, contig_id, seq, length) as sketches.

    Digestion has no state. A batch overwrites the partitions of its genomes, so
    that a batch that is repeated after a failure leaves one copy; a genome
    therefore arrives whole.
    """
    enzymes = resolve(panel)

    def put(batch: DataFrame, _: int) -> None:
        rows = sketch(batch, digest(batch, enzymes))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("genome_id").parquet(database)

    return contigs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
