import gzip
import warnings

import pytest
from pyspark.sql import functions as F

from tagloom.operators import legacy, panel, synteny
from tagloom.operators.digest import digest
from tagloom.operators.enzymes import resolve
from tagloom.sources import fasta, sketch, strata
from tagloom.streaming.ingest import ingest

BCG = "A" * 10 + "CGA" + "A" * 6 + "TGC" + "A" * 10


def test_fasta(spark, tmp_path):
    (tmp_path / "one.fa").write_text(f">c1 first\nac\ngt\n\n>c2\n{BCG}\n")
    with gzip.open(tmp_path / "two.fasta.gz", "wt") as f:
        f.write(">x\r\nACGT\r\n>empty\n")
    rows = {(r.genome_id, r.contig_id): (r.contig_name, r.seq, r.length) for r in fasta.read_fasta(spark, str(tmp_path)).collect()}
    assert rows == {("one", 0): ("c1 first", "ACGT", 4), ("one", 1): ("c2", BCG, 32), ("two", 0): ("x", "ACGT", 4), ("two", 1): ("empty", "", 0)}
    ids = {r.genome_id for r in fasta.read_fasta(spark, str(tmp_path / "one.fa"), genome_from_stem=False).collect()}
    assert ids == {"c1"}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/bad.fa").write_text("ACGT\n")
    with pytest.raises(Exception, match="not FASTA"):
        fasta.read_fasta(spark, str(tmp_path / "bad")).collect()
    with pytest.raises(Exception):
        fasta.read_fasta(spark, str(tmp_path / "nowhere.fa")).collect()
    (tmp_path / "r.fastq").write_text("@a\nacg\n+\nIII\n@b\nTT\n+\nII\n")
    assert [(r.contig_name, r.seq) for r in fasta.read_fastq(spark, str(tmp_path / "r.fastq")).collect()] == [("a", "ACG"), ("b", "TT")]
    (tmp_path / "list").write_text("a.fa\n\n b.fa \n")
    assert fasta.read_paths(spark, str(tmp_path / "list")) == ["a.fa", "b.fa"]


@pytest.fixture
def sketches(spark):
    c = spark.createDataFrame([("g", 0, BCG + "A" * 20), ("g", 1, "ACGT"), ("h", 0, BCG)], "genome_id string, contig_id long, seq string").withColumn("length", F.length("seq").cast("long"))
    return sketch.sketch(c, digest(c, resolve()))


def plain(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sketch.SKETCH).collect())))


def test_sketch_round_trips(spark, sketches, tmp_path):
    sketch.write_sketches(sketches, str(tmp_path / "db"))
    assert plain(sketch.read_sketches(spark, str(tmp_path / "db"))) == plain(sketches)
    binary = sketch.export_sketches(sketches)
    assert all(r.content[:8] == b"S2BA\x02\0\0\0" for r in binary.collect())
    assert plain(sketch.import_sketches(binary)) == plain(sketches)
    with pytest.raises(ValueError):
        sketch.decode_sketch(b"S2BA\x01\0\0\0" + b"\0" * 20)
    with pytest.raises(ValueError):
        sketch.decode_sketch(b"xxxx")
    with pytest.raises(Exception):
        sketch.read_sketches(spark, str(tmp_path / "nowhere")).collect()


def test_databases(spark, sketches):
    one = sketches.where("genome_id = 'g'")
    assert {(r.genome_id, r.n_contigs, r.tag_count) for r in sketch.db_list(sketches).collect()} == {("g", 2, 1), ("h", 1, 1)}
    assert plain(sketch.db_add(sketches, one)) == plain(sketches)
    assert plain(sketch.db_remove(sketches, ["h", "zzz"])) == plain(one)
    changed = one.withColumn("gc", F.lit(0.0))
    assert plain(sketch.db_merge([sketches, changed])) == plain(sketches.where("genome_id = 'h'").unionByName(changed))
    twice = spark.createDataFrame([("g", "a/g.fa"), ("g", "b/g.fa")], "genome_id string, source_file string")
    with pytest.raises(ValueError):
        sketch.refuse_equal_names(twice)


def test_strata_and_panel(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("query\treference\tenzyme\ttag_len\tbody_len\tn_miss\thist\na\tb\tBcgI\t32\t26\t805\t186,7,2\na\tb\tHin4I\t27\t21\t10\t90,9,1\n")
    (tmp_path / "t.tsv").write_text("query\treference\tani\na\tb\t95.5\n")
    s, t = strata.read_strata(spark, str(tmp_path / "s.tsv")), strata.read_truth(spark, str(tmp_path / "t.tsv"))
    assert [(r.enzyme, r.hist, r.d2, r.d3) for r in s.orderBy("enzyme").collect()] == [("BcgI", [186, 7, 2], 0, 0), ("Hin4I", [90, 9, 1], 1, 1)]
    assert t.first().truth == 95.5 and t.count() == 1
    scores = {r.panel: r for r in panel.singles(s, t).collect()}
    assert set(scores) == {"BcgI", "Hin4I"} and all(r.n == 1 and r.mae == abs(r.bias) for r in scores.values())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        path = panel.greedy(s, t)
    assert path[0].mae == min(r.mae for r in scores.values())
    # all enzymes come in, and marks say which steps helped
    assert [len(x.panel) for x in path] == list(range(1, len(scores) + 1)) and path[0].improved
    best = float("inf")
    for x in path:
        assert x.improved == (x.mae < best)
        best = min(best, x.mae)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        lines = panel.report(s, t, "BcgI;nobody", True)
    assert lines[0].endswith(",".join(sorted(scores))) and any(x.startswith("  nobody") and x.endswith("n/a") for x in lines) and sum(x.startswith("  BcgI") for x in lines) == 2
    with pytest.raises(ValueError, match="truth"):
        panel.report(s, t.limit(0))


def test_legacy(spark):
    rows = [("q", "r", "BcgI", 0, 1000 * k, 0, 1000 * k + (6000 if k >= 5 else 0), "+", 0, True) for k in range(10)] + [("q", "r", "BcgI", 0, 0, 0, 5, "+", 2, True)]
    a = spark.createDataFrame(rows, "query string, reference string, enzyme string, q_contig long, q_pos long, r_contig long, r_pos long, orient string, mm int, uniq boolean")
    m = legacy.match_tags(a)
    assert m.count() == 10 and m.agg(F.max("gap_diff")).first()[0] == 6000 and m.where("q_pos = 0").first().mm == 0
    b = synteny.chained_blocks(m)
    assert sorted(r.n_tags for r in b.collect()) == [5, 5] and legacy.block_paf(b).count() == 2
    assert legacy.contig_mash(a).first().n == 11
    one = spark.createDataFrame([(100, 0.25)], "n int, af double").select(legacy.confidence(F.col("n"), F.col("af")).alias("c")).first().c
    assert abs(one - 0.5 * (1 - 2.718281828 ** -1)) < 1e-6


def test_stream(spark, tmp_path):
    schema = "genome_id string, contig_id long, seq string, length long"
    spark.createDataFrame([("g", 0, BCG, 32)], schema).write.parquet(str(tmp_path / "in/1"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    go = lambda: ingest(read(), str(tmp_path / "db"), str(tmp_path / "ck")).awaitTermination(120)
    go()
    spark.createDataFrame([("h", 0, BCG + BCG, 64)], schema).write.parquet(str(tmp_path / "in/2"))
    go()
    assert {(r.genome_id, r.tag_count) for r in sketch.db_list(sketch.read_sketches(spark, str(tmp_path / "db"))).collect()} == {("g", 1), ("h", 2)}
