"""The registered queries over the test tables, and their SQL.

documents are read as sequences (genome: source, contig: document). All run
over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom import comparison_sql as csql
from tagloom import legacy_sql as lsql
from tagloom.functions import sequence as seq
from tagloom.operators import anchors as anc
from tagloom.operators import digest as dig
from tagloom.operators import enzymes as enz
from tagloom.operators import fill, intervals, legacy, legacy_report, panel, report, screen, sv, synteny
from tagloom.operators.chain import Config
from tagloom.operators.compare import Comparison
from tagloom.plans import commands
from tagloom.sources import container
from tagloom.sources import sketch as sk
from tagloom.sources.database import SketchDatabase
from tagloom.sources.fasta import BASES, LETTERS, cut_segments, document_contigs, text_contigs
from tagloom.sources.scratch import shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return document_contigs(table(spark, sf, "documents"))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return dig.digest(contigs(spark, sf))


def tags_once(spark: SparkSession, sf: str) -> DataFrame:
    """Tags for plans that use them several times: digested once and kept."""
    return stored(tags(spark, sf), "tags")


def genomes(spark: SparkSession, sf: str) -> commands.Genomes:
    g = commands.Genomes.from_contigs(contigs(spark, sf))
    g.tags = stored(g.tags, "tags")
    return g


def benchmark_genomes(spark: SparkSession, sf: str) -> commands.Genomes:
    """Benchmark passages as one query genome."""
    b = table(spark, sf, "benchmark").withColumn("genome", F.lit("benchmark"))
    return commands.Genomes.from_contigs(text_contigs(b, "genome", "item_id", "text"))


# --- SQL pieces ------------------------------------------------------------------------------


def _contigs_sql() -> str:
    return f"contigs AS (SELECT source AS genome_id, doc_id AS contig_id, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{LETTERS.upper() + LETTERS}', '{BASES + BASES}') AS seq FROM documents)"


def _condition(e: enz.Enzyme) -> str:
    ways = []
    for p in e.patterns:
        runs: list[tuple[int, str]] = []
        for at, b in p:
            if len(b) == 1 and runs and runs[-1][0] + len(runs[-1][1]) == at and "[" not in runs[-1][1]:
                runs[-1] = (runs[-1][0], runs[-1][1] + b)
            else:
                runs.append((at, b if len(b) == 1 else f"[{b}]"))
        ways.append(" AND ".join(f"substr(w, {a + 1}, {len(r)}) = '{r}'" if "[" not in r else f"substr(w, {a + 1}, 1) IN ({', '.join(repr(x) for x in r[1:-1])})" for a, r in runs))
    return " OR ".join(f"({x})" for x in ways)


def _tags_sql(names: list[str] | tuple[str, ...] = enz.DEFAULT_PANEL) -> str:
    parts = [f"SELECT genome_id, contig_id, '{e.name}' AS enzyme, position, substr(w, 1, {e.tag_len}) AS tag FROM win WHERE length(w) >= {e.tag_len} AND ({_condition(e)})" for e in enz.resolve(names)]
    return f"""{_contigs_sql()},
chunks AS (SELECT genome_id, contig_id, a, substr(seq, a + 1, 287) AS c FROM (SELECT *, unnest(range(0, greatest(length(seq), 1), 256)) AS a FROM contigs)),
win AS (SELECT genome_id, contig_id, a + o AS position, substr(c, o + 1, 32) AS w FROM (SELECT *, unnest(range(0, 256)) AS o FROM chunks)),
tags AS ({' UNION ALL '.join(parts)})"""


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_CANON = f"canon AS (SELECT *, least(tag, {_RC.format('tag')}) AS canonical FROM tags), occ AS (SELECT genome_id, canonical, count(*) AS n FROM canon GROUP BY ALL), rare AS (SELECT c.*, n FROM canon c JOIN occ USING (genome_id, canonical) WHERE n <= 5)"
_KEYS = "keys AS (SELECT DISTINCT genome_id, enzyme, least(substr(tag, (length(tag) - 18) // 2 + 1, 18), substr(" + _RC.format("tag") + ", (length(tag) - 18) // 2 + 1, 18)) AS key FROM tags)"
_PAIRS = """sizes AS (SELECT genome_id, enzyme, count(*) AS n FROM keys GROUP BY ALL),
shared AS (SELECT a.genome_id AS query, b.genome_id AS reference, count(*) AS shared FROM keys a JOIN keys b USING (enzyme, key) WHERE a.genome_id < b.genome_id GROUP BY ALL),
pairs AS (SELECT query, reference, any_value(shared) AS shared, sum(least(x.n, y.n))::BIGINT AS min_total FROM shared JOIN sizes x ON x.genome_id = query JOIN sizes y ON y.genome_id = reference AND x.enzyme = y.enzyme GROUP BY query, reference)"""
_VERDICT = "CASE WHEN shared >= 3 AND min_total > 0 AND shared >= 0.001 * min_total THEN 'pass' ELSE 'fail' END"
_HITS = f"""{_CANON},
strands AS (SELECT *, '+' AS orient, tag AS s FROM rare UNION ALL SELECT *, '-' AS orient, {_RC.format('tag')} AS s FROM rare),
cut AS (SELECT *, unnest([1, 2, 3]) AS part FROM strands),
bounds AS (SELECT * FROM (VALUES (32, 1, 0, 11), (32, 2, 11, 11), (32, 3, 22, 10), (27, 1, 0, 9), (27, 2, 9, 9), (27, 3, 18, 9)) t(len, part, a, n2)),
rparts AS (SELECT c.*, substr(s, a + 1, n2) AS bits, count(*) OVER (PARTITION BY genome_id, enzyme, c.part, substr(s, a + 1, n2)) AS held FROM cut c JOIN bounds b ON b.len = length(c.tag) AND b.part = c.part),
qparts AS (SELECT * FROM rparts WHERE orient = '+'),
hits AS (
  SELECT q.genome_id AS query, r.genome_id AS reference, q.enzyme, q.contig_id AS q_contig, q.position AS q_pos, r.contig_id AS r_contig, r.position AS r_pos, r.orient, hamming(q.tag, r.s)::INT AS mm, q.n = 1 AND r.n = 1 AS uniq
  FROM qparts q JOIN rparts r ON q.enzyme = r.enzyme AND q.part = r.part AND q.bits = r.bits WHERE q.genome_id < r.genome_id AND r.held <= 256 AND hamming(q.tag, r.s) <= 2),
anchors AS (
  SELECT query, reference, enzyme, q_contig, q_pos, r_contig, r_pos, orient, mm, uniq FROM (
    SELECT *, row_number() OVER (PARTITION BY query, reference, q_contig, q_pos, r_contig, r_pos, orient ORDER BY mm, enzyme, uniq) AS k FROM hits) WHERE k = 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- sources, digestion, column functions ----------------------------------------------------


@query(_with(_contigs_sql()) + "SELECT genome_id, contig_id, length(seq)::BIGINT AS length, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / greatest(length(seq), 1), 6) AS gc FROM contigs")
def contig_stats(spark, sf):
    return contigs(spark, sf).select("genome_id", "contig_id", "length", F.round(seq.gc_content(F.col("seq")), 6).alias("gc"))


@query(_with(_contigs_sql()) + "SELECT genome_id, count(*) AS n_contigs, sum(length(seq))::BIGINT AS total_length, round(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) / greatest(sum(length(seq)), 1), 6) AS gc FROM contigs GROUP BY genome_id")
def genome_gc(spark, sf):
    c = contigs(spark, sf).select("genome_id", "length", seq.gc_count(F.col("seq")).alias("g"))
    return c.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum("length").alias("total_length"), F.round(F.sum("g") / F.greatest(F.sum("length"), F.lit(1)), 6).alias("gc"))


def _registry_values() -> str:
    return ", ".join(f"('{e.name}', '{e.left}', '{e.right}', {e.spacer}, {e.tag_len}, '{e.recognition}', {len(e.patterns)}, {e.exact_site}, {e.d2}, {e.d3}, {e.body_len})" for e in enz.REGISTRY.values())


@query(
    _with(_tags_sql([e.name for e in enz.usable()]), "n AS (SELECT enzyme, count(*) AS n_tags FROM tags GROUP BY ALL)")
    + f"SELECT t.*, coalesce(n_tags, 0) AS n_tags FROM (VALUES {_registry_values()}) t(enzyme, left_anchor, right_anchor, spacer, tag_len, recognition, n_patterns, exact_site, d2, d3, body_len) LEFT JOIN n USING (enzyme)"
)
def enzyme_registry(spark, sf):
    """The registry, with the tags that each enzyme has in all documents."""
    n = dig.digest(contigs(spark, sf), enz.usable()).groupBy("enzyme").agg(F.count(F.lit(1)).alias("n_tags"))
    return enz.registry(spark).join(n, "enzyme", "left").fillna(0, ["n_tags"])


@query(_with(_tags_sql()) + "SELECT * FROM tags")
def digest_tags(spark, sf):
    return tags(spark, sf)


@query(_with(_tags_sql()) + "SELECT * FROM tags")
def segment_tags(spark, sf):
    """Tags of contigs cut into segments of 500 bases."""
    return dig.digest_segments(stored(cut_segments(contigs(spark, sf), 500), "segments"))


_MARGINS = enz.MarginEnzyme("GacTrg", "GAC", "TRG", 4, 24, 9, 6)


def _margin_sql(strand: str, site: str, lead: int, tail: int) -> str:
    start = f"greatest(i - {lead}, 0)"
    tag = f"substr(seq, {start} + 1, least(i + 10 + {tail} - {start}, 32))"
    return f"SELECT genome_id, contig_id, i AS position, '{strand}' AS strand, {tag if strand == '+' else _RC.format(tag)} AS tag FROM places WHERE regexp_matches(substr(seq, i + 1, 10), '{site}') AND i + 10 + {tail} <= length(seq) AND length(seq) >= 24"


@query(
    _with(_contigs_sql())
    + f", places AS (SELECT *, unnest(range(0, length(seq))) AS i FROM contigs), found AS ({_margin_sql('+', 'GAC....T[AG]G', 9, 6)} UNION ALL {_margin_sql('-', 'C[CT]A....GTC', 6, 9)})"
    + " SELECT genome_id, contig_id, 'GacTrg' AS enzyme, position, min(strand) AS strand, min_by(tag, strand) AS tag FROM found WHERE regexp_full_match(tag, '[ACGT]+') GROUP BY genome_id, contig_id, position"
)
def margin_tags(spark, sf):
    """Tags of an enzyme of one's own, given by anchors and margins."""
    return dig.margin_digest(contigs(spark, sf), [_MARGINS])


@query(_with(_tags_sql([e.name for e in enz.usable()])) + "SELECT genome_id, enzyme, count(*) AS n_tags, min(position) AS first, max(position) AS last FROM tags GROUP BY ALL")
def tags_per_enzyme(spark, sf):
    t = dig.digest(contigs(spark, sf), enz.usable())
    return t.groupBy("genome_id", "enzyme").agg(F.count(F.lit(1)).alias("n_tags"), F.min("position").alias("first"), F.max("position").alias("last"))


_lo = " + ".join(f"((CASE WHEN length(tag) >= {k + 1} THEN strpos('ACGT', substr(tag, {k + 1}, 1)) - 1 ELSE 0 END)::BIGINT << {2 * k})" for k in range(16))
_hi = " + ".join(f"((CASE WHEN length(tag) >= {k + 17} THEN strpos('ACGT', substr(tag, {k + 17}, 1)) - 1 ELSE 0 END)::BIGINT << {2 * k})" for k in range(16))


@query(_with(_tags_sql()) + f"SELECT tag, {_RC.format('tag')} AS rc, least(tag, {_RC.format('tag')}) AS canonical, round(length(regexp_replace(tag, '[^GC]', '', 'g')) / length(tag), 6) AS gc, {_lo} AS packed_low, {_hi} AS packed_high, hamming(tag, {_RC.format('tag')})::INT AS self_mismatches FROM (SELECT DISTINCT tag FROM tags)")
def tag_strands(spark, sf):
    t = F.col("tag")
    p = seq.pack(t)
    d = tags(spark, sf).select("tag").distinct()
    return d.select("tag", seq.revcomp(t).alias("rc"), seq.canonical(t).alias("canonical"), F.round(seq.gc_content(t), 6).alias("gc"), p.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("packed_low"), F.shiftrightunsigned(p, 32).alias("packed_high"), seq.packed_mismatches(p, seq.pack(seq.revcomp(t))).alias("self_mismatches"))


@query(_with(_tags_sql(), _CANON) + "SELECT genome_id, canonical, n FROM occ")
def occurrence_counts(spark, sf):
    return dig.occurrence_counts(tags(spark, sf))


@query(_with(_tags_sql(), _CANON) + "SELECT genome_id, enzyme, contig_id, position, n = 1 AS uniq FROM rare")
def rare_tags(spark, sf):
    return anc.rare_tags(tags(spark, sf)).select("genome_id", "enzyme", "contig_id", "position", (F.col("n") == 1).alias("uniq"))


@query(_with(_tags_sql()) + "SELECT genome_id, contig_id, enzyme, position, row_number() OVER (PARTITION BY genome_id ORDER BY contig_id, position, list_position(['BcgI', 'AlfI', 'AloI', 'FalI'], enzyme)) - 1 AS tag_rank FROM tags")
def tag_ranks(spark, sf):
    return dig.rank_tags(tags(spark, sf)).select("genome_id", "contig_id", "enzyme", "position", "tag_rank")


def screen_keys_once(spark: SparkSession, sf: str) -> DataFrame:
    """Screen keys for the self-join and both size counts: computed once and kept."""
    return stored(screen.screen_keys(tags(spark, sf)), "keys")


# --- screen ----------------------------------------------------------------------------------


@query(_with(_tags_sql(), _KEYS) + "SELECT * FROM keys")
def screen_keys(spark, sf):
    return screen.screen_keys(tags(spark, sf))


@query(_with(_tags_sql(), _KEYS, _PAIRS) + f"SELECT query, reference, shared, min_total, round(shared / min_total, 9) AS containment, round(power(shared / min_total, 1.0 / 18), 9) AS approx_ani, {_VERDICT} AS verdict FROM pairs")
def screen_pairs(spark, sf):
    p = screen.screen_pairs(screen_keys_once(spark, sf))
    return p.select("query", "reference", "shared", "min_total", F.round("containment", 9).alias("containment"), F.round("approx_ani", 9).alias("approx_ani"), "verdict")


@query(_with(_tags_sql().replace("source AS genome_id", "doc_id::VARCHAR AS genome_id"), _KEYS, _PAIRS) + f"SELECT query, reference, shared, min_total FROM pairs WHERE {_VERDICT} = 'pass'")
def screen_documents(spark, sf):
    c = text_contigs(table(spark, sf, "documents"), "doc_id", "doc_id", "text")
    return screen.passing_pairs(stored(screen.screen_keys(dig.digest(c)), "keys"))


@query(_with(_tags_sql(), _KEYS, _PAIRS) + f"SELECT query, reference, round(power(shared / min_total, 1.0 / 18), 9) AS approx_ani, row_number() OVER (PARTITION BY query ORDER BY power(shared / min_total, 1.0 / 18) DESC, reference) AS hit FROM pairs WHERE {_VERDICT} = 'pass'")
def screen_best(spark, sf):
    p = screen.screen_pairs(screen_keys_once(spark, sf)).where("verdict = 'pass'")
    return p.select("query", "reference", F.round("approx_ani", 9).alias("approx_ani"), F.row_number().over(Window.partitionBy("query").orderBy(F.desc("approx_ani"), "reference")).alias("hit"))


_GENOMES = [f"src{k}" for k in range(20)]


def genome_names(spark: SparkSession, sf: str) -> list[str]:
    """The sources of the table, shorter names first: one column of a matrix each."""
    found = table(spark, sf, "documents").select("source").where("source is not null").distinct().collect()
    return sorted((r.source for r in found), key=lambda g: (len(g), g))


@query(
    _with(_tags_sql(), _KEYS, _PAIRS, f"v AS (SELECT query AS a, reference AS b, round(power(shared / min_total, 1.0 / 18), 9) AS x FROM pairs WHERE {_VERDICT} = 'pass')", "sym AS (SELECT * FROM v UNION ALL SELECT b, a, x FROM v)", f"g AS (SELECT unnest({_GENOMES!r}) AS genome)")
    + "SELECT genome, " + ", ".join(f"CASE WHEN genome = '{g}' THEN 1.0::DOUBLE ELSE coalesce(max(CASE WHEN b = '{g}' THEN x END), 'NaN'::DOUBLE) END AS {g}" for g in _GENOMES) + " FROM g LEFT JOIN sym ON a = genome GROUP BY genome"
)
def screen_matrix(spark, sf):
    p = screen.screen_pairs(screen_keys_once(spark, sf)).where("verdict = 'pass'").select("query", "reference", F.round("approx_ani", 9).alias("approx_ani"))
    return report.matrix(p, genome_names(spark, sf), "approx_ani", 1.0)


# --- anchors and what is relational after them -----------------------------------------------


def halves(t: DataFrame, **limits: int) -> DataFrame:
    """Anchors of each two genomes once: pairs arise where tags share a part, never from a list of all pairs."""
    return anc.find_anchors(t, t, **limits).where("query < reference")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return halves(tags_once(spark, sf))


def all_matches(spark: SparkSession, sf: str) -> DataFrame:
    return legacy.match_all(tags_once(spark, sf))


def _unordered(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered pairs of sources (a few names), for results that have a row for each pair asked for."""
    g = table(spark, sf, "documents").select(F.col("source").alias("query")).distinct()
    return g.join(g.withColumnRenamed("query", "reference"), F.col("query") < F.col("reference"))


@query(_with(_tags_sql(), _HITS) + "SELECT * FROM anchors")
def anchor_pairs(spark, sf):
    return anchors(spark, sf)


@query(_with(_tags_sql(), _HITS) + "SELECT query, reference, orient, mm, count(*) AS n, count(CASE WHEN uniq THEN 1 END) AS n_unique FROM anchors GROUP BY ALL")
def mismatch_histogram(spark, sf):
    return anchors(spark, sf).groupBy("query", "reference", "orient", "mm").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("uniq"), 1)).alias("n_unique"))


@query(_with(_tags_sql(), _HITS) + "SELECT query, reference, q_contig, r_contig, orient, count(*) AS n, min(q_pos) AS q_start, max(q_pos) AS q_end, min(r_pos) AS r_start, max(r_pos) AS r_end FROM anchors GROUP BY ALL")
def anchor_groups(spark, sf):
    return anchors(spark, sf).groupBy("query", "reference", "q_contig", "r_contig", "orient").agg(F.count(F.lit(1)).alias("n"), F.min("q_pos").alias("q_start"), F.max("q_pos").alias("q_end"), F.min("r_pos").alias("r_start"), F.max("r_pos").alias("r_end"))


@query(_with(_tags_sql(), _HITS, "total AS (SELECT genome_id AS query, enzyme, count(*) AS total FROM rare GROUP BY ALL)", "found AS (SELECT query, reference, enzyme, count(DISTINCT (q_contig, q_pos)) AS found FROM anchors GROUP BY ALL)") + "SELECT p.query, p.reference, t.enzyme, coalesce(found, 0) AS found, total FROM (SELECT DISTINCT query, reference FROM anchors) p JOIN total t USING (query) LEFT JOIN found f ON f.query = p.query AND f.reference = p.reference AND f.enzyme = t.enzyme")
def whole_genome_strata(spark, sf):
    t = tags_once(spark, sf)
    return anc.whole_genome_strata(t, halves(t))


@query(_with(_tags_sql(), _HITS, "m AS (SELECT query, reference, q_contig, r_contig, count(*) AS n, avg(mm) AS mean_mm FROM anchors GROUP BY ALL)") + "SELECT query, reference, q_contig, r_contig, n, round(mean_mm, 6) AS mean_mm FROM m QUALIFY row_number() OVER (PARTITION BY query, reference, q_contig ORDER BY n DESC, r_contig) = 1")
def contig_mash(spark, sf):
    return legacy.contig_mash_all(tags(spark, sf)).withColumn("mean_mm", F.round("mean_mm", 6))


@query(_with(_tags_sql(), "s AS (SELECT genome_id, contig_id, position AS a, position + length(tag) AS b FROM tags)", "x AS (SELECT *, max(b) OVER (PARTITION BY genome_id, contig_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)", "y AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY genome_id, contig_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM x)", "z AS (SELECT genome_id, contig_id, i, max(b) - min(a) AS bp FROM y GROUP BY ALL)") + "SELECT genome_id, contig_id, sum(bp)::BIGINT AS covered_bp, count(*) AS islands FROM z GROUP BY ALL")
def covered_bp(spark, sf):
    s = tags(spark, sf).select("genome_id", "contig_id", F.col("position").alias("start"), (F.col("position") + F.length("tag")).alias("end"))
    return intervals.covered(s, ["genome_id", "contig_id"])


@query(_with(_tags_sql(), _HITS) + "SELECT query, reference, a.enzyme, q_contig, q_pos, r_contig, r_pos, count(*) AS n_near, min(abs(t.position - r_pos)) AS nearest, max(t.position) AS last FROM anchors a JOIN tags t ON t.genome_id = reference AND t.enzyme = a.enzyme AND t.contig_id = r_contig AND abs(t.position - r_pos) <= 3000 WHERE orient = '+' GROUP BY ALL")
def local_band(spark, sf):
    t = tags_once(spark, sf)
    a = halves(t).where("orient = '+'")
    r = t.select(F.col("genome_id").alias("reference"), "enzyme", F.col("contig_id").alias("r_contig"), "position")
    j = intervals.band_join(a, r, ["reference", "enzyme", "r_contig"], "r_pos", "position", 3000)
    return j.groupBy("query", "reference", "enzyme", "q_contig", "q_pos", "r_contig", "r_pos").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.abs(F.col("position") - F.col("r_pos"))).alias("nearest"), F.max("position").alias("last"))


@query(_with(_tags_sql(), "p AS (SELECT DISTINCT genome_id, contig_id, position FROM tags)") + "SELECT genome_id, contig_id, position, lead(position) OVER w - position AS next_distance, position - lag(position) OVER w AS previous_distance FROM p WINDOW w AS (PARTITION BY genome_id, contig_id ORDER BY position)")
def nearest_tags(spark, sf):
    return intervals.nearest(tags(spark, sf), ["genome_id", "contig_id"], "position")


@query(_with(_tags_sql(), "p AS (SELECT genome_id, contig_id, position, enzyme, CASE WHEN position - lag(position) OVER (PARTITION BY genome_id, contig_id ORDER BY position) > 1000 THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT genome_id, contig_id, position, '' AS enzyme FROM tags))", "c AS (SELECT *, sum(f) OVER (PARTITION BY genome_id, contig_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS cluster FROM p)") + "SELECT genome_id, contig_id, cluster::BIGINT AS cluster, count(*) AS size, min(position) AS first, max(position) AS last FROM c GROUP BY ALL")
def tag_clusters(spark, sf):
    return intervals.gap_clusters(tags(spark, sf).select("genome_id", "contig_id", "position").distinct(), ["genome_id", "contig_id"], "position")


@query(_with(_tags_sql(), "a AS (SELECT genome_id, contig_id, list(position ORDER BY position) AS l FROM (SELECT DISTINCT genome_id, contig_id, position FROM tags) GROUP BY ALL)") + "SELECT genome_id, contig_id, len(l) AS n, CASE WHEN len(l) < 2 THEN 0 ELSE list_sort(list_transform(range(2, len(l) + 1), lambda i: l[i] - l[i - 1]))[(len(l) - 1) // 2 + 1] END::BIGINT AS median_gap FROM a")
def median_gaps(spark, sf):
    a = tags(spark, sf).select("genome_id", "contig_id", "position").distinct().groupBy("genome_id", "contig_id").agg(F.collect_list("position").alias("l"))
    return a.select("genome_id", "contig_id", F.size("l").cast("long").alias("n"), intervals.upper_median_gap(F.col("l")).alias("median_gap"))


@query(_with(_tags_sql(), _HITS) + "SELECT t.genome_id, t.enzyme, t.contig_id, t.position FROM tags t WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.query = t.genome_id AND a.q_contig = t.contig_id AND a.q_pos = t.position AND a.enzyme = t.enzyme)")
def unmatched_tags(spark, sf):
    return legacy.unmatched_queries(tags_once(spark, sf)).select("genome_id", "enzyme", "contig_id", "position")


@query(
    _with(_contigs_sql(), "chunks AS (SELECT genome_id, a, substr(seq, a + 1, 270) AS c FROM (SELECT *, unnest(range(0, greatest(length(seq) - 14, 0), 256)) AS a FROM contigs))", "win AS (SELECT genome_id, substr(c, o + 1, 15) AS k FROM (SELECT *, unnest(range(0, 256)) AS o FROM chunks))", f"own AS (SELECT DISTINCT genome_id, least(k, {_RC.format('k')}) AS k FROM win WHERE length(k) = 15)", "n AS (SELECT genome_id, count(*) AS n_query FROM own GROUP BY ALL)")
    + "SELECT a.genome_id AS query, b.genome_id AS reference, count(*) AS shared, any_value(n_query) AS n_query, round(count(*) / any_value(n_query), 9) AS containment, round(power(count(*) / any_value(n_query), 1.0 / 15), 9) AS kmer_ani FROM own a JOIN own b USING (k) JOIN n ON n.genome_id = a.genome_id WHERE a.genome_id < b.genome_id GROUP BY ALL"
)
def kmer_containment(spark, sf):
    k = legacy.kmer_containment(contigs(spark, sf))
    return k.withColumn("containment", F.round("containment", 9)).withColumn("kmer_ani", F.round("kmer_ani", 9))


@query(_with(_tags_sql(), _KEYS, _PAIRS, "b AS (SELECT *, floor(10 * power(shared / min_total, 1.0 / 18))::BIGINT AS band, substr(query, 1, 4) AS grp FROM pairs)") + "SELECT band, grp, query, reference, nth FROM (SELECT *, row_number() OVER (PARTITION BY band, grp ORDER BY shared DESC, query, reference) AS nth FROM b) WHERE nth <= 3")
def stratified_sample(spark, sf):
    p = screen.screen_pairs(screen_keys_once(spark, sf)).withColumn("band", F.floor(10 * F.col("approx_ani"))).withColumn("grp", F.substring("query", 1, 4)).withColumn("minus", -F.col("shared"))
    return panel.stratified_sample(p, "band", "grp", 3, ["minus", "query", "reference"]).select("band", "grp", "query", "reference", "nth")


# --- sketch databases ------------------------------------------------------------------------

_DB = "c AS (SELECT genome_id, count(*) AS n_contigs, round(sum(length(regexp_replace(seq, '[^GC]', '', 'g'))) / greatest(sum(length(seq)), 1), 4) AS gc FROM contigs GROUP BY ALL), n AS (SELECT genome_id, count(*) AS n FROM tags GROUP BY ALL)"


def sketches(spark: SparkSession, sf: str) -> DataFrame:
    c = contigs(spark, sf)
    return sk.sketch(c, dig.digest(c))


@query(_with(_tags_sql(), _DB) + "SELECT genome_id, n_contigs, coalesce(n, 0) AS tag_count, gc FROM c LEFT JOIN n USING (genome_id)")
def db_list(spark, sf):
    return sk.db_list(sketches(spark, sf))


@query(_with(_tags_sql(), _DB) + "SELECT genome_id, n_contigs, coalesce(n, 0) AS tag_count FROM c LEFT JOIN n USING (genome_id) WHERE genome_id NOT IN ('src1', 'src2')")
def db_remove(spark, sf):
    return sk.db_list(sk.db_remove(sketches(spark, sf), ["src1", "src2", "nowhere"])).select("genome_id", "n_contigs", "tag_count")


_BENCH = "SELECT 'benchmark' AS genome_id, item_id AS contig_id, translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '" + LETTERS.upper() + LETTERS + "', '" + BASES + BASES + "') AS seq FROM benchmark"


@query(_with(_tags_sql().replace("FROM documents)", f"FROM documents WHERE source <> 'src1' UNION ALL {_BENCH})", 1), _DB) + "SELECT genome_id, n_contigs, coalesce(n, 0) AS tag_count FROM c LEFT JOIN n USING (genome_id)")
def db_merge(spark, sf):
    b = benchmark_genomes(spark, sf)
    mine = sk.db_remove(sketches(spark, sf), ["src1"])
    added = sk.db_add(mine, sk.sketch(b.contigs, b.tags))
    return sk.db_list(sk.db_merge([mine, added])).select("genome_id", "n_contigs", "tag_count")


@query(_with(_tags_sql()) + "SELECT genome_id, contig_id, enzyme, position, tag FROM tags")
def container_tags(spark, sf):
    """The tags of all sources, written as containers and read back."""
    container.register(spark)
    path = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    sketches(spark, sf).where("genome_id is not null").repartition("genome_id").write.format("s2ba").mode("append").save(path)
    back = sk.tags_of(spark.read.format("s2ba").load(path).withColumn("contig_id", F.col("contig_name").cast("long")))
    return back.select("genome_id", "contig_id", "enzyme", "position", "tag")


@query(_with(_tags_sql().replace("FROM documents)", f"FROM documents WHERE source <> 'src1' UNION ALL {_BENCH})", 1), _DB) + "SELECT genome_id, n_contigs, coalesce(n, 0) AS tag_count FROM c LEFT JOIN n USING (genome_id)")
def database_states(spark, sf):
    """A database after three commits: all sources, one of them gone, and the benchmark passages digested with its panel."""
    db = SketchDatabase(spark, f"{shared_dir(spark)}/database-{uuid.uuid4().hex}")
    db.put(sketches(spark, sf))
    db.remove(["src1"])
    db.add(benchmark_genomes(spark, sf).contigs)
    return sk.db_list(db.read()).select("genome_id", "n_contigs", "tag_count")


# --- reports over whole rows of numbers: each line item stands for a result -------------------

_CASE_SQL = """c AS (SELECT l_orderkey AS id, l_linenumber AS line, 0.8 + l_discount AS het, 0.81 + l_tax AS uniform, CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE 0.8 + l_tax END AS loss, CASE WHEN l_returnflag = 'R' THEN 'NaN'::DOUBLE ELSE 0.8 + l_discount END AS hist,
CASE WHEN l_linestatus = 'O' THEN 'Infinity'::DOUBLE ELSE l_quantity / 8 END AS shape, l_quantity / 50 AS kept, l_suppkey AS n_anchors, l_partkey % 100 AS unconserved FROM lineitem)"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of a result, read off line items; some estimates are missing, some shapes infinite."""
    nan, l = F.lit(float("nan")), table(spark, sf, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (0.8 + F.col("l_discount")).alias("het"), (0.81 + F.col("l_tax")).alias("uniform"), F.when(F.col("l_linenumber") == 7, nan).otherwise(0.8 + F.col("l_tax")).alias("loss"), F.when(F.col("l_returnflag") == "R", nan).otherwise(0.8 + F.col("l_discount")).alias("hist"),
        F.when(F.col("l_linestatus") == "O", F.lit(float("inf"))).otherwise(F.col("l_quantity") / 8).alias("shape"), (F.col("l_quantity") / 50).alias("kept"), F.col("l_suppkey").alias("n_anchors"), (F.col("l_partkey") % 100).alias("unconserved"),
    )


_FALLBACK = "(isfinite(loss) AND isfinite(hist) AND abs(loss - hist) > 0.05 + 1e-12)"


@query(_with(_CASE_SQL) + f"SELECT id, line, round(CASE WHEN {_FALLBACK} THEN uniform ELSE het END, 9) AS ani_gated, CASE WHEN {_FALLBACK} THEN 'uniform_fallback' WHEN isfinite(shape) THEN 'gamma' ELSE 'uniform' END AS gate, CASE WHEN isnan(kept) OR kept < 0.2 THEN 'BELOW_DETECTION' WHEN {_FALLBACK} OR unconserved / greatest(n_anchors, 1) > 0.5 THEN 'INCONSISTENT' ELSE 'ok' END AS flag FROM c")
def gate_and_flag(spark, sf):
    c = _cases(spark, sf)
    g = report.gated_estimate(F.col("het"), F.col("uniform"), F.col("loss"), F.col("hist"))
    fallback = g != F.col("het")
    return c.select("id", "line", F.round(g, 9).alias("ani_gated"), report.gate_name(g, fallback, F.col("shape")).alias("gate"), report.flag(F.isnan("kept") | (F.col("kept") < 0.2), fallback | (F.col("unconserved") / F.greatest("n_anchors", F.lit(1)) > 0.5)).alias("flag"))


@query(
    _with(_CASE_SQL) + "SELECT id, line, round(" + f"{report.CALIBRATION['intercept']} + "
    + " + ".join(f"({c!r} * ((CASE WHEN isfinite({x}) THEN {x} ELSE {m!r} END) - {mean!r}) / {s!r})" for x, mean, s, c, m in zip(["(het * 100)", "(uniform * 100)", "loss", "hist", "(shape * 100)", "kept", "n_anchors::DOUBLE", "unconserved::DOUBLE", "(n_anchors * 2)::DOUBLE"], report.CALIBRATION["means"], report.CALIBRATION["scales"], report.CALIBRATION["coefficients"], report.CALIBRATION["imputer_medians"]))
    + ", 6) AS calibrated, round(het * 100 + 0.02 * (100 - het * 100) * (1 - kept), 10) AS debiased, round(het * 100 + 0.02 * (100 - het * 100) * (1 - kept) + 0.0001 * (100 - het * 100) * (100 - het * 100) * (1 - kept), 10) AS debiased_quadratic FROM c"
)
def calibration(spark, sf):
    x = [F.col("het") * 100, F.col("uniform") * 100, F.col("loss"), F.col("hist"), F.col("shape") * 100, F.col("kept"), F.col("n_anchors"), F.col("unconserved"), F.col("n_anchors") * 2]
    d = lambda q: F.round(report.debias(F.col("het") * 100, F.col("kept"), q), 10)
    return _cases(spark, sf).select("id", "line", F.round(report.calibrated(x), 6).alias("calibrated"), d(False).alias("debiased"), d(True).alias("debiased_quadratic"))


_TREES = [[{"feature": 0, "threshold": 0.9, "left": 1, "right": 2}, {"value": -0.2}, {"feature": 1, "threshold": 0.5, "left": 3, "right": 4}, {"value": 0.1}, {"value": 0.3}], [{"feature": 1, "threshold": 0.2, "left": 1, "right": 2}, {"value": 0.05}, {"value": -0.05}]]


@query(_with(_CASE_SQL) + "SELECT id, line, round(greatest(0, least(1, 0.9 + 0.1 * (CASE WHEN het <= 0.9 THEN -0.2 WHEN kept <= 0.5 THEN 0.1 ELSE 0.3 END) + 0.1 * (CASE WHEN kept <= 0.2 THEN 0.05 ELSE -0.05 END)))::DOUBLE, 9) AS prediction FROM c")
def tree_prediction(spark, sf):
    return report.predict_trees(_cases(spark, sf), ["het", "kept"], _TREES, 0.9, 0.1).select("id", "line", F.round("prediction", 9).alias("prediction"))


# --- first pass of a comparison: sources end to end, chains, tags in their spans ----------------

_PLACED = """off AS (SELECT genome_id, contig_id, (sum(length(seq)) OVER (PARTITION BY genome_id ORDER BY contig_id) - length(seq))::BIGINT AS off FROM contigs),
total AS (SELECT genome_id, sum(length(seq))::BIGINT AS bp FROM contigs GROUP BY ALL),
pl AS (SELECT query, reference, orient, q_pos + a.off AS q, r_pos + b.off AS r, CASE orient WHEN '-' THEN -1 ELSE 1 END * (r_pos + b.off) AS s FROM anchors JOIN off a ON a.genome_id = query AND a.contig_id = q_contig JOIN off b ON b.genome_id = reference AND b.contig_id = r_contig),
runs AS (SELECT query, reference, orient, list(q ORDER BY q, s) AS q, list(r ORDER BY q, s) AS r, list(s ORDER BY q, s) AS s, count(*) AS n FROM pl GROUP BY ALL HAVING n >= {least})"""
_COST = "0.0005::DOUBLE * abs((q[i] - q[j]) - (s[i] - s[j])) + 0.05::DOUBLE * log2(abs((q[i] - q[j]) - (s[i] - s[j])) + 1)"
# one row a step: an anchor is added to the programme, or the best path is taken and its anchors die
_CHAINS = f"""st AS (
  SELECT query, reference, orient, q, r, s, n, list_transform(q, lambda x: true) AS alive, 1::BIGINT AS i, []::DOUBLE[] AS score, []::BIGINT[][] AS path, NULL::BIGINT[] AS found, true AS go FROM runs
  UNION ALL
  SELECT query, reference, orient, q, r, s, n, CASE WHEN i <= n THEN alive ELSE list_transform(range(1, n + 1), lambda k: alive[k] AND NOT list_contains(top, k)) END, CASE WHEN i <= n THEN i + 1 ELSE 1 END,
    CASE WHEN i <= n THEN list_append(score, CASE WHEN NOT alive[i] THEN '-inf'::DOUBLE WHEN best > 1 THEN best ELSE 1::DOUBLE END) ELSE [] END,
    CASE WHEN i <= n THEN list_append(path, CASE WHEN alive[i] AND best > 1 THEN list_append(path[origin], i) ELSE [i] END) ELSE [] END,
    CASE WHEN i > n AND high >= {{least}} THEN top END, i <= n OR high >= {{least}}
  FROM (SELECT *, list_max(prev) AS best, greatest(1, i - 60) - 1 + list_position(prev, list_max(prev)) AS origin, list_max(score) AS high, path[list_position(score, list_max(score))] AS top
    FROM (SELECT *, list_transform(range(greatest(1, i - 60), i), lambda j: CASE WHEN alive[j] AND q[i] > q[j] AND s[i] > s[j] AND q[i] - q[j] <= 50000 AND s[i] - s[j] <= 50000 THEN score[j] + 1 - ({_COST}) ELSE '-inf'::DOUBLE END) AS prev FROM st WHERE go))),
ch AS (SELECT query, reference, row_number() OVER (PARTITION BY query, reference ORDER BY len(cq) DESC, cq[1], cr[1], orient) - 1 AS chain_id, orient, len(cq)::BIGINT AS n_anchors, cq, cr
  FROM (SELECT query, reference, orient, list_transform(found, lambda k: q[k]) AS cq, list_transform(found, lambda k: r[k]) AS cr FROM st WHERE found IS NOT NULL))"""
_STEP = "least(list_sort(list_transform(range(2, len({0}) + 1), lambda i: abs({0}[i] - {0}[i - 1])))[(len({0}) - 1) // 2 + 1] // 2, 10000)"
_SPANS = f"""sp AS (SELECT query, reference, chain_id, 0::BIGINT AS q_contig, 0::BIGINT AS r_contig, orient, n_anchors, cq, cr, greatest(list_min(cq) - {_STEP.format('cq')}, 0) AS q_start, least(list_max(cq) + {_STEP.format('cq')}, a.bp) AS q_end, greatest(list_min(cr) - {_STEP.format('cr')}, 0) AS r_start, least(list_max(cr) + {_STEP.format('cr')}, b.bp) AS r_end, a.bp AS q_bp, b.bp AS r_bp
  FROM ch JOIN total a ON a.genome_id = query JOIN total b ON b.genome_id = reference)"""
_BLOCK_COLUMNS = "query, reference, chain_id, q_contig, r_contig, orient, n_anchors, q_start, q_end, r_start, r_end"


def _recursive(*parts: str, least: int = 4) -> str:
    """Chains of at least ``least`` anchors, and what is built on them."""
    return _with(_tags_sql(), _HITS, _PLACED.replace("{least}", str(least)), _CHAINS.replace("{least}", str(least)), *parts).replace("WITH ", "WITH RECURSIVE ", 1)


def scaffold_anchors(spark: SparkSession, sf: str, t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Offsets of the documents in their source, the sources' lengths, and anchors at places of whole sources."""
    c = contigs(spark, sf)
    offsets = stored(fill.scaffold(c), "offsets")
    lengths = c.groupBy("genome_id").agg(F.sum("length").alias("length")).select("genome_id", F.lit(0).cast("long").alias("contig_id"), "length")
    a = halves(t)
    return offsets, lengths, fill.placed(fill.placed(a, offsets, "query", "q_contig", "q_pos"), offsets, "reference", "r_contig", "r_pos")


def scaffold_spans(spark: SparkSession, sf: str, least: int = 4) -> DataFrame:
    _, lengths, a = scaffold_anchors(spark, sf, tags_once(spark, sf))
    return stored(fill.spanned(fill.collinear(a, Config(min_chain_anchors=least)), lengths, lengths), "chains")


@query(_recursive(_SPANS) + f"SELECT {_BLOCK_COLUMNS}, list_aggregate(cq, 'string_agg', ',') AS q_places, list_aggregate(cr, 'string_agg', ',') AS r_places FROM sp")
def scaffold_chains(spark, sf):
    places = lambda side: F.array_join(F.transform(f"anchors.{side}_pos", lambda x: x.cast("string")), ",").alias(f"{side}_places")
    return scaffold_spans(spark, sf).select(*_BLOCK_COLUMNS.split(", "), places("q"), places("r"))


@query(_recursive(_SPANS, "cl AS (SELECT query, reference, count(*) AS n, sum(n_anchors)::BIGINT AS k, max(n_anchors) AS most, avg(n_anchors) AS mean FROM sp GROUP BY ALL)", "al AS (SELECT query, reference, count(*) AS n_all FROM pl GROUP BY ALL)") + "SELECT query, reference, n AS synteny_blocks, round(CASE WHEN k > 1 THEN (k - n) / (k - 1) ELSE 0 END, 9) AS synteny_score, n - 1 AS breakpoint_count, n_all - 1 - (k - n) AS unconserved, most AS max_block_anchors, round(mean, 9) AS mean_block_anchors FROM cl JOIN al USING (query, reference)")
def scaffold_synteny(spark, sf):
    _, _, a = scaffold_anchors(spark, sf, tags_once(spark, sf))
    a = stored(a, "anchors")
    s = intervals.synteny(fill.collinear(a), a)
    return s.withColumn("synteny_score", F.round("synteny_score", 9)).withColumn("mean_block_anchors", F.round("mean_block_anchors", 9))


def _union_sql(side: str) -> str:
    """Covered base pairs of a side: gaps and islands over the chains' spans."""
    a, b, w = f"{side}_start", f"{side}_end", f"OVER (PARTITION BY query, reference ORDER BY {side}_start, {side}_end"
    return f"""{side}1 AS (SELECT *, max({b}) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sp),
{side}2 AS (SELECT *, sum(CASE WHEN m IS NULL OR {a} > m THEN 1 ELSE 0 END) {w} ROWS UNBOUNDED PRECEDING) AS island FROM {side}1),
{side}3 AS (SELECT query, reference, sum(bp)::BIGINT AS {side}_covered FROM (SELECT query, reference, island, max({b}) - min({a}) AS bp FROM {side}2 GROUP BY ALL) GROUP BY ALL)"""


@query(_recursive(_SPANS, _union_sql("q"), _union_sql("r")) + "SELECT query, reference, q_covered, r_covered, round(q_covered / a.bp, 9) AS af_query, round(r_covered / b.bp, 9) AS af_reference FROM q3 JOIN r3 USING (query, reference) JOIN total a ON a.genome_id = query JOIN total b ON b.genome_id = reference")
def scaffold_fractions(spark, sf):
    """Aligned fractions of the pairs with chains."""
    _, lengths, a = scaffold_anchors(spark, sf, tags_once(spark, sf))
    chains = stored(fill.spanned(fill.collinear(a), lengths, lengths), "chains")
    out = None
    for side, genome, af in (("q", "query", "af_query"), ("r", "reference", "af_reference")):
        c = intervals.covered(chains, ["query", "reference", f"{side}_contig"], f"{side}_start", f"{side}_end").select("query", "reference", F.col("covered_bp").alias(f"{side}_covered"))
        c = c.join(lengths.select(F.col("genome_id").alias(genome), "length"), genome).withColumn(af, F.round(F.col(f"{side}_covered") / F.col("length"), 9)).drop("length")
        out = c if out is None else out.join(c, ["query", "reference"])
    return out.select("query", "reference", "q_covered", "r_covered", "af_query", "af_reference")


@query(_recursive(_SPANS) + "SELECT query || ':0' AS q_name, q_bp AS q_len, q_start, q_end, orient AS strand, reference || ':0' AS r_name, r_bp AS r_len, r_start, r_end, least(n_anchors * 29, greatest(q_end - q_start, r_end - r_start)) AS n_match, greatest(q_end - q_start, r_end - r_start) AS aln_len, least(60, floor(10 * (n_anchors / (greatest(q_end - q_start, 1) / 1000))))::INT AS mapq FROM sp")
def scaffold_paf(spark, sf):
    _, lengths, a = scaffold_anchors(spark, sf, tags_once(spark, sf))
    return sv.paf(fill.spanned(fill.collinear(a), lengths, lengths), lengths, lengths)


_SV_SQL = """stp AS (SELECT *, unnest(range(1, n_anchors)) AS k FROM sp),
wd AS (SELECT *, (cq[k + 1] - cq[k]) - CASE orient WHEN '-' THEN -1 ELSE 1 END * (cr[k + 1] - cr[k]) AS diff FROM stp),
within AS (SELECT query, reference, CASE WHEN diff > 0 THEN 'insertion' ELSE 'deletion' END AS sv_type, q_contig, cq[k] AS q_start, cq[k + 1] AS q_end, r_contig, least(cr[k], cr[k + 1]) AS r_start, greatest(cr[k], cr[k + 1]) AS r_end, abs(diff) AS size, k AS support_left, n_anchors - k AS support_right FROM wd WHERE abs(diff) > 100),
nb AS (SELECT *, coalesce(lag(n_anchors) OVER w, 0) AS l, coalesce(lead(n_anchors) OVER w, 0) AS g, cq[len(cq)] AS aq, cr[len(cr)] AS ar, lead(chain_id) OVER w AS b_id, lead(orient) OVER w AS bo, lead(r_contig) OVER w AS bc, lead(cq[1]) OVER w AS bq, lead(cr[1]) OVER w AS br FROM sp WINDOW w AS (PARTITION BY query, reference, q_contig ORDER BY q_start, q_end, chain_id)),
inv AS (SELECT query, reference, 'inversion' AS sv_type, q_contig, q_start, q_end, r_contig, r_start, r_end, q_end - q_start AS size, l AS support_left, g AS support_right FROM nb WHERE orient = '-'),
jn AS (SELECT *, bq - aq AS q_gap, CASE orient WHEN '-' THEN -1 ELSE 1 END * (br - ar) AS r_gap, r_contig = bc AS same FROM nb WHERE b_id IS NOT NULL),
trans AS (SELECT query, reference, 'translocation' AS sv_type, q_contig, aq AS q_start, greatest(aq, bq) AS q_end, bc AS r_contig, CASE WHEN same THEN least(ar, br) ELSE br END AS r_start, CASE WHEN same THEN greatest(ar, br) ELSE br END AS r_end, CASE WHEN same THEN abs(r_gap) ELSE greatest(0, q_gap) END AS size, n_anchors AS support_left, g AS support_right FROM jn WHERE NOT same OR (orient = bo AND r_gap < 0)),
gaps AS (SELECT query, reference, CASE WHEN q_gap > r_gap THEN 'insertion' ELSE 'deletion' END AS sv_type, q_contig, aq AS q_start, bq AS q_end, r_contig, least(ar, br) AS r_start, greatest(ar, br) AS r_end, abs(q_gap - r_gap) AS size, n_anchors AS support_left, g AS support_right FROM jn
  WHERE same AND orient = bo AND r_gap >= 0 AND abs(q_gap - r_gap) > 100 AND NOT EXISTS (SELECT 1 FROM sp o WHERE o.query = jn.query AND o.reference = jn.reference AND o.r_contig = jn.r_contig AND o.chain_id <> jn.chain_id AND o.chain_id <> jn.b_id AND len(list_filter(o.cr, lambda x: x > least(ar, br) AND x < greatest(ar, br))) > 0)),
calls AS (SELECT * FROM within UNION ALL SELECT * FROM inv UNION ALL SELECT * FROM trans UNION ALL SELECT * FROM gaps)"""


@query(_recursive(_SPANS, _SV_SQL, least=2) + "SELECT * FROM calls")
def scaffold_variants(spark, sf):
    """Variants of chains of two anchors and more, so that there are some to call."""
    return sv.ordered(sv.detect(scaffold_spans(spark, sf, 2), indel_min=100))


_FILL_SQL = f"""tp AS (SELECT t.genome_id, enzyme, position + off AS p, tag FROM tags t JOIN off USING (genome_id, contig_id)),
stp AS (SELECT *, unnest(range(1, n_anchors)) AS k FROM ch),
cand AS (SELECT query, reference, enzyme, p, tag, chain_id, orient, floor(cr[k] + (cr[k + 1] - cr[k]) * (p - cq[k]) / (cq[k + 1] - cq[k]))::BIGINT AS at, row_number() OVER (PARTITION BY query, reference, enzyme, p ORDER BY chain_id, k) AS nth FROM stp JOIN tp ON genome_id = query AND p >= cq[k] AND p <= cq[k + 1]),
own AS (SELECT *, CASE orient WHEN '-' THEN {_RC.format('tag')} ELSE tag END AS s FROM cand WHERE nth = 1),
near AS (SELECT o.query, o.reference, o.enzyme, o.p, min(hamming(o.s, t.tag)) AS mm FROM own o LEFT JOIN tp t ON t.genome_id = o.reference AND t.enzyme = o.enzyme AND abs(t.p - o.at) <= 3000 GROUP BY ALL)"""


@query(_recursive(_FILL_SQL) + "SELECT query, reference, enzyme, count(CASE WHEN mm = 0 THEN 1 END) AS m0, count(CASE WHEN mm = 1 THEN 1 END) AS m1, count(CASE WHEN mm = 2 THEN 1 END) AS m2, count(CASE WHEN mm IS NULL OR mm > 2 THEN 1 END) AS n_miss FROM near GROUP BY ALL")
def scaffold_strata(spark, sf):
    t = tags_once(spark, sf)
    offsets, _, a = scaffold_anchors(spark, sf, t)
    p = stored(fill.placed(t.select("genome_id", "contig_id", "enzyme", "position", "tag"), offsets, "genome_id", "contig_id", "position"), "placed")
    return fill.filled(stored(fill.claimed(stored(fill.collinear(a), "chains"), p), "claims"), p)


# --- whole comparisons ---------------------------------------------------------------------------

_SEL = f"sel AS MATERIALIZED (SELECT query, reference FROM pairs WHERE {_VERDICT} = 'pass')"


def _compared(*parts: str, sel: str = _SEL, more: str = "", ordered: bool = False) -> str:
    """The comparison of the pairs of ``sel``; more: further contigs, to be united with the documents; ordered: (a, b), (b, a) and (a, a) are pairs."""
    tags_ = _tags_sql().replace("FROM documents)", f"FROM documents UNION ALL {more})", 1) if more else _tags_sql()
    materialized = lambda x: x.replace("\ntags AS (", "\ntags AS MATERIALIZED (").replace("anchors AS (", "anchors AS MATERIALIZED (").replace("contigs AS (", "contigs AS MATERIALIZED (")
    out = materialized(_with(tags_, _KEYS, _PAIRS, _HITS, sel, csql.chains_sql(), *parts)).replace("WITH ", "WITH RECURSIVE ", 1)
    return out.replace(" WHERE a.genome_id < b.genome_id", "").replace("q.genome_id < r.genome_id AND ", "") if ordered else out


def _calibrated_sql() -> str:
    m = report.CALIBRATION
    x = ["gated * 100", "uniform * 100", "af_query", "af_reference", "std_err * 100", "kept", "n_anchors::DOUBLE", "blocks::DOUBLE", "n_tags::DOUBLE"]
    return f"{m['intercept']!r} + " + " + ".join(f"{c!r} * ((CASE WHEN isfinite({v}) THEN {v} ELSE {med!r} END) - {mean!r}) / {scale!r}" for v, mean, scale, c, med in zip(x, m["means"], m["scales"], m["coefficients"], m["imputer_medians"], strict=True))


def source_results(spark: SparkSession, sf: str) -> Comparison:
    g = genomes(spark, sf)
    return commands.results(g, g, commands.screened(g))


@query(_compared(csql.results_sql()) + csql.verbose_rows(_calibrated_sql()))
def triangle(spark, sf):
    return report.ani_rows(source_results(spark, sf).pairs, calibrate=True, verbose=True)


@query(_compared(csql.results_sql()) + "SELECT query, reference, round(greatest(0, least(1, 0.9 + 0.1 * (CASE WHEN het <= 0.9 THEN -0.2 WHEN kept <= 0.5 THEN 0.1 ELSE 0.3 END) + 0.1 * (CASE WHEN kept <= 0.2 THEN 0.05 ELSE -0.05 END)))::DOUBLE, 9) AS prediction FROM flagged")
def tree_results(spark, sf):
    """A small ensemble of trees over the results of all screened pairs."""
    found = report.predict_trees(source_results(spark, sf).pairs, ["ani_het", "retention"], _TREES, 0.9, 0.1)
    return found.select("query", "reference", F.round("prediction", 9).alias("prediction"))


@query(_compared(csql.results_sql()) + f"SELECT query, reference, {csql.pct('gated')} AS ani_gated FROM flagged WHERE NOT isnan(gated)")
def triangle_edges(spark, sf):
    return report.edges(report.ani_rows(source_results(spark, sf).pairs))


@query(
    _compared(csql.results_sql(), f"v AS (SELECT query AS a, reference AS b, {csql.pct('gated')} AS x FROM flagged WHERE NOT isnan(gated))", "sym AS (SELECT * FROM v UNION ALL SELECT b, a, x FROM v)", f"g AS (SELECT unnest({_GENOMES!r}) AS genome)")
    + "SELECT genome, " + ", ".join(f"CASE WHEN genome = '{g}' THEN 100.0::DOUBLE ELSE coalesce(max(CASE WHEN b = '{g}' THEN x END), 'NaN'::DOUBLE) END AS {g}" for g in _GENOMES) + " FROM g LEFT JOIN sym ON a = genome GROUP BY genome"
)
def triangle_matrix(spark, sf):
    return report.matrix(report.ani_rows(source_results(spark, sf).pairs), genome_names(spark, sf))


@query(_compared(csql.results_sql(), sel=_SEL.replace("pairs WHERE", "pairs WHERE query = 'benchmark' AND"), more=_BENCH) + f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY ani_gated DESC, reference) AS hit FROM ({csql.ROWS}) WHERE ani_gated >= 50 AND NOT isnan(ani_gated)")
def search_benchmark(spark, sf):
    g = genomes(spark, sf)
    return commands.search(benchmark_genomes(spark, sf), g, min_ani=0.5)


@query(_compared(csql.results_sql(), ordered=True) + f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY ani_gated DESC, reference) AS hit FROM ({csql.ROWS}) WHERE ani_gated >= 80 AND NOT isnan(ani_gated)")
def search_sources(spark, sf):
    """Each source against all, itself included: the hits best first."""
    g = genomes(spark, sf)
    return commands.search(g, g, min_ani=0.8)


@query(_compared(csql.results_sql(), sel="sel AS MATERIALIZED (SELECT 'benchmark' AS query, reference FROM (SELECT DISTINCT genome_id AS reference FROM contigs WHERE genome_id <> 'benchmark'))", more=_BENCH) + csql.ROWS)
def ani_benchmark(spark, sf):
    return commands.ani(benchmark_genomes(spark, sf), genomes(spark, sf))


@query(_compared(csql.results_sql(), ordered=True) + csql.ROWS + " WHERE gated >= 0.8 AND NOT isnan(gated)")
def dist_sources(spark, sf):
    g = genomes(spark, sf)
    return commands.dist(g, g, min_ani=0.8)


@query(_compared() + "SELECT query, reference, chain_id, q_contig, r_contig, orient, n_anchors, q_start, q_end, r_start, r_end FROM sp")
def chain_blocks(spark, sf):
    return source_results(spark, sf).chains.drop("anchors")


@query(_compared() + "SELECT query, reference, enzyme, tag_len, body_len, miss::BIGINT AS n_miss, concat_ws(',', h0::BIGINT, h1::BIGINT, h2::BIGINT) AS hist FROM str2 JOIN geo USING (enzyme)")
def pair_strata(spark, sf):
    return report.strata_rows(source_results(spark, sf).strata)


@query(_compared(_SV_SQL) + "SELECT * FROM calls")
def structural_variants(spark, sf):
    return sv.detect(source_results(spark, sf).chains, indel_min=100)


@query(_compared() + "SELECT query || ':' || q_contig AS q_name, q_bp AS q_len, q_start, q_end, orient AS strand, reference || ':' || r_contig AS r_name, r_bp AS r_len, r_start, r_end, least(n_anchors * 29, greatest(q_end - q_start, r_end - r_start)) AS n_match, greatest(q_end - q_start, r_end - r_start) AS aln_len, least(60, floor(10 * (n_anchors / (greatest(q_end - q_start, 1) / 1000))))::INT AS mapq FROM sp")
def chain_paf(spark, sf):
    lengths = contigs(spark, sf).select("genome_id", "contig_id", "length")
    return sv.paf(source_results(spark, sf).chains, lengths, lengths)


_PANELS = "pn1 AS (SELECT query, reference, p.panel AS panel, list_filter(s, lambda t: p.names IS NULL OR list_contains(p.names, t.enzyme)) AS s FROM ar2, (VALUES ('all', NULL), ('BcgI', ['BcgI']), ('BcgI+AlfI', ['BcgI', 'AlfI'])) p(panel, names)), "
_PANELS += f"pn AS MATERIALIZED (SELECT query, reference, panel, query || '|' || reference || '|' || panel AS key, s, {csql.UNIFORM} AS uniform FROM pn1 WHERE len(s) > 0)"


@query(
    _compared(csql.results_sql(), _PANELS, csql.heterogeneous("hp", "pn"), "er AS (SELECT panel, 100 * ani - 100 * f.uniform AS e FROM pn1 JOIN fit3 f USING (query, reference) LEFT JOIN (SELECT key, ani FROM hp) h ON h.key = query || '|' || reference || '|' || panel)")
    + "SELECT panel, count(e) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias FROM er GROUP BY panel"
)
def panel_scores(spark, sf):
    found = source_results(spark, sf)
    s = stored(found.strata, "strata")
    truth = stored(found.pairs.select("query", "reference", (100 * F.col("ani_uniform")).alias("truth")), "truth")
    found = panel.score(panel.estimates(s, {"all": None, "BcgI": ["BcgI"], "BcgI+AlfI": ["BcgI", "AlfI"]}), truth)
    return found.withColumn("mae", F.round("mae", 6)).withColumn("bias", F.round("bias", 6))


_BLOCK_KMERS = f"""side AS (SELECT query, reference, chain_id, 'q' AS side, query AS genome_id, q_contig AS contig_id, list_min(cq) AS lo, list_max(cq) + 1 AS hi FROM ch UNION ALL SELECT query, reference, chain_id, 'r', reference, r_contig, list_min(cr), list_max(cr) + 1 FROM ch),
trimmed AS (SELECT s.query, s.reference, s.chain_id, s.side, substr(c.seq, lo + 1, least(hi, length(seq)) - lo) AS w FROM side s JOIN contigs c USING (genome_id, contig_id)),
km AS (SELECT DISTINCT query, reference, chain_id, side, least(m, {_RC.format('m')}) AS m FROM (SELECT *, substr(w, i + 1, 15) AS m FROM (SELECT *, unnest(range(0, length(w) - 14)) AS i FROM trimmed WHERE length(w) > 15))),
two AS (SELECT query, reference, chain_id, m, max(CASE WHEN side = 'q' THEN 1 ELSE 0 END) AS q, max(CASE WHEN side = 'r' THEN 1 ELSE 0 END) AS r FROM km GROUP BY ALL),
bk AS (SELECT query, reference, chain_id, sum(q) AS n_query, sum(r) AS n_reference, sum(q * r) AS shared FROM two GROUP BY ALL)"""


def block_spans(chains: DataFrame) -> DataFrame:
    """From the first anchor of a chain to its last, on either side."""
    ends = [f(f"anchors.{s}_pos").alias(f"{s}_{e}") for s in ("q", "r") for e, f in (("start", F.array_min), ("end", F.array_max))]
    return chains.select("query", "reference", "chain_id", "q_contig", "r_contig", "n_anchors", *ends)


@query(_compared(_BLOCK_KMERS) + "SELECT query, reference, chain_id, n_query::BIGINT AS n_query, n_reference::BIGINT AS n_reference, shared::BIGINT AS shared FROM bk")
def block_kmers(spark, sf):
    """k-mers of both sides within each chain."""
    return legacy.block_kmers(stored(block_spans(source_results(spark, sf).chains), "blocks"), contigs(spark, sf), ["query", "reference", "chain_id"])


@query(_compared(_BLOCK_KMERS) + "SELECT query, reference, round(sum(greatest(least(1 + ln(greatest(least(shared / least(n_query, n_reference), 1), 1e-9)) / 15, 1), 0) * n_anchors) / sum(n_anchors), 9) AS kmer_ani FROM bk JOIN ch USING (query, reference, chain_id) WHERE n_query > 0 AND n_reference > 0 GROUP BY ALL")
def block_kmer_identity(spark, sf):
    """k-mer identity of each pair's chains, weighted by their anchors."""
    k = legacy.block_kmer_identity(stored(block_spans(source_results(spark, sf).chains), "blocks"), contigs(spark, sf), ["query", "reference", "chain_id"], "n_anchors")
    return k.withColumn("kmer_ani", F.round("kmer_ani", 9))


_ALONE = "pa1 AS (SELECT query, reference, x.enzyme AS panel, [x] AS s FROM (SELECT query, reference, unnest(s) AS x FROM ar2))"
_ALONE += f", pa AS MATERIALIZED (SELECT query, reference, panel, query || '|' || reference || '|' || panel AS key, s, {csql.UNIFORM} AS uniform FROM pa1)"


@query(
    _compared(csql.results_sql(), _ALONE, csql.heterogeneous("ha", "pa"), "er AS (SELECT panel, 100 * h.ani - 100 * f.uniform AS e FROM pa JOIN fit3 f USING (query, reference) JOIN (SELECT key, ani FROM ha) h ON h.key = pa.key)")
    + "SELECT panel, count(e) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias FROM er GROUP BY panel"
)
def panel_singles(spark, sf):
    """Each enzyme alone against the fit of all."""
    found = source_results(spark, sf)
    truth = stored(found.pairs.select("query", "reference", (100 * F.col("ani_uniform")).alias("truth")), "truth")
    return panel.singles(stored(found.strata, "strata"), truth).withColumn("mae", F.round("mae", 6)).withColumn("bias", F.round("bias", 6))


def _older(*parts: str) -> str:
    return _with(_tags_sql().replace("\ntags AS (", "\ntags AS MATERIALIZED ("), *parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(_older(lsql.MATCHES) + "SELECT * EXCLUDE (len, mean_len) FROM ma")
def legacy_matches(spark, sf):
    return all_matches(spark, sf)


@query(_older(lsql.MATCHES, lsql.BLOCKS) + "SELECT * REPLACE (round(block_ani, 9) AS block_ani) FROM bl")
def legacy_blocks(spark, sf):
    return _rounded(synteny.chained_blocks(all_matches(spark, sf)), "block_ani")


@query(_older(lsql.MATCHES, lsql.BLOCKS, lsql.VARIANTS) + "SELECT * FROM va")
def legacy_variants(spark, sf):
    t = tags_once(spark, sf)
    pairs = _unordered(spark, sf)
    m = stored(legacy.match_all(t, pairs), "matches")
    return synteny.variants(t, pairs, m, synteny.chained_blocks(m))


_SHARES = ("ani", "raw_ani", "weighted_ani", "mash_ani", "kmer_ani", "af_query", "af_reference", "confidence")


@query(_older(lsql.MATCHES, lsql.BLOCKS, lsql.SUMMARY) + "SELECT query, reference, " + ", ".join(f"round({c}::DOUBLE, 9) AS {c}" for c in _SHARES) + ", shared_tags, ani < 0.83 AS below_detection FROM su")
def legacy_summary(spark, sf):
    t = tags_once(spark, sf)
    pairs = _unordered(spark, sf)
    return _rounded(legacy_report.summary(stored(legacy.match_all(t, pairs), "matches"), t, pairs, contigs=contigs(spark, sf)), *_SHARES)


@query(_older(lsql.MATCHES, lsql.BLOCKS) + "SELECT query, reference, round(avg(100 * (1 - mm / len)), 9) AS raw_ani, round(sum(100 * (1 - mm / len) * sqrt(size)) / sum(sqrt(size)), 9) AS weighted_ani, count(*) AS n_tags FROM sized GROUP BY ALL")
def legacy_ani(spark, sf):
    return _rounded(legacy.weighted_pairs(all_matches(spark, sf)), "raw_ani", "weighted_ani")
