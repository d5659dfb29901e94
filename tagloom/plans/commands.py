"""ani, dist, search, triangle, struct and database plans over (contigs, tags)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import report, sv
from tagloom.operators.chain import Config
from tagloom.operators.compare import Comparison, compare
from tagloom.operators.digest import digest
from tagloom.operators.enzymes import DEFAULT_PANEL, Enzyme, resolve
from tagloom.operators.screen import MIN_CONTAINMENT, MIN_SHARED, WINDOW, screen_keys, screen_pairs
from tagloom.sources.database import warn_of_other_panels
from tagloom.sources.scratch import stored
from tagloom.sources.sketch import contigs_of, tags_of


@dataclass
class Genomes:
    """Contigs (genome_id, contig_id, length, ...) and their tags; digested once, used by every plan."""

    contigs: DataFrame
    tags: DataFrame
    panel: list[Enzyme] = field(default_factory=resolve)

    @classmethod
    def from_contigs(cls, contigs: DataFrame, panel: str | list[str] = list(DEFAULT_PANEL)) -> Genomes:
        enzymes = resolve(panel)
        return cls(contigs, digest(contigs, enzymes), enzymes)

    @classmethod
    def from_sketches(cls, sketches: DataFrame, panel: str | list[str] = list(DEFAULT_PANEL), warn: bool = False) -> Genomes:
        """warn: say how many sketches have tags of another panel, which takes a pass over them."""
        enzymes = resolve(panel)
        if warn:
            warn_of_other_panels(sketches, [e.name for e in enzymes])
        return cls(contigs_of(sketches), tags_of(sketches).where(F.col("enzyme").isin([e.name for e in enzymes])), enzymes)

    def names(self) -> DataFrame:
        return self.contigs.select("genome_id").distinct()


def cross_pairs(q: Genomes, r: Genomes) -> DataFrame:
    """All query x reference genomes: what ``ani`` is asked for (genomes named on a command line; not documents)."""
    return q.names().withColumnRenamed("genome_id", "query").join(r.names().withColumnRenamed("genome_id", "reference"), how="cross")


def screened(q: Genomes, r: Genomes | None = None, window: int = WINDOW, min_shared: int = MIN_SHARED, min_containment: float = MIN_CONTAINMENT, min_approx: float = 0.0) -> DataFrame:
    """Pairs that pass the screen; without r all unordered pairs of q."""
    keys = lambda g: stored(screen_keys(g.tags, window), "keys")
    own = keys(q)
    pairs = screen_pairs(own, None if r is None else own if r is q else keys(r), window, min_shared, min_containment)
    return pairs.where((F.col("verdict") == "pass") & (F.col("approx_ani") >= min_approx))


def results(q: Genomes, r: Genomes, pairs: DataFrame, cfg: Config = Config()) -> Comparison:
    lengths = q.contigs.select("genome_id", "contig_id", "length")
    if r is not q:
        lengths = lengths.unionByName(r.contigs.select("genome_id", "contig_id", "length")).dropDuplicates(["genome_id", "contig_id"])
    # the pairs are joined several times: screened once and kept
    return compare(q.tags, r.tags, lengths, stored(pairs.select("query", "reference"), "pairs"), q.panel, cfg)


def ani(q: Genomes, r: Genomes, cfg: Config = Config(), calibrate: bool = False, verbose: bool = False) -> DataFrame:
    """Every query against every reference, without a screen."""
    return report.ani_rows(results(q, r, cross_pairs(q, r), cfg).pairs, calibrate, verbose)


def dist(q: Genomes, r: Genomes, min_ani: float = 0.0, min_approx: float = 0.0, cfg: Config = Config(), **screen) -> DataFrame:
    """Screened pairs, refined; with min_ani > 0 only those that reach it."""
    rows = report.ani_rows(results(q, r, screened(q, r, min_approx=min_approx, **screen), cfg).pairs)
    return rows.where(~F.isnan("ani_gated") & (F.col("ani_gated") >= 100 * min_ani)) if min_ani > 0 else rows


def search(q: Genomes, r: Genomes, min_ani: float = 0.8, cfg: Config = Config(), **screen) -> DataFrame:
    """Hits of each query, the best first."""
    return report.best_first(report.ani_rows(results(q, r, screened(q, r, **screen), cfg).pairs), min_ani)


def triangle(g: Genomes, cfg: Config = Config(), **screen) -> DataFrame:
    """All unordered pairs that pass the screen, refined; report.edges and report.matrix give its two forms."""
    return report.ani_rows(results(g, g, screened(g, **screen), cfg).pairs)


def struct(q: Genomes, r: Genomes, indel_min: int = 1000, rearrangement: bool = False, indel: bool = False, pairs: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """Structural variants of the pairs (all, unless given)."""
    found = results(q, r, cross_pairs(q, r) if pairs is None else pairs, cfg)
    return sv.detect(found.chains, indel_min, rearrangement, indel)
