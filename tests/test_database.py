import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators.digest import digest
from tagloom.operators.enzymes import resolve
from tagloom.plans import commands
from tagloom.sources import container, database, sketch
from tagloom.sources.database import SketchDatabase


def contigs(spark, seed, *names, n=30_000):
    rng = np.random.default_rng(seed)
    rows = [(g, k, f"{g}.{k}", s, len(s)) for g in names for k, s in enumerate("".join(rng.choice(list("ACGT"), m)) for m in (n, 20))]
    return spark.createDataFrame(rows, "genome_id string, contig_id long, contig_name string, seq string, length long")


def rows(df):
    return sorted((tuple(r) for r in df.select(*sketch.SKETCH).collect()), key=str)


def test_containers_as_a_source(spark, tmp_path, monkeypatch):
    container.register(spark)
    path = str(tmp_path / "db")
    with pytest.raises(Exception, match="holds no .s2ba"):
        spark.read.format("s2ba").load(path).count()
    c = contigs(spark, 1, "a", "b", "c")
    own = sketch.sketch(c, digest(c))
    own.repartition("genome_id").write.format("s2ba").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["a.s2ba", "b.s2ba", "c.s2ba"]
    back = spark.read.format("s2ba").load(path)
    assert rows(back) == rows(own)
    assert rows(spark.read.format("s2ba").load(f"{path}/b.s2ba")) == rows(own.where("genome_id = 'b'"))
    assert rows(sketch.import_sketches(spark.read.format("binaryFile").load(path))) == rows(own)
    # asked for two columns, the reader makes two
    two = spark.read.schema("genome_id string, tag string").format("s2ba").load(path)
    assert two.columns == ["genome_id", "tag"] and two.where("tag is not null").count() == own.where("tag is not null").count()
    assert [len(p.files) for p in container.Reader(path, ["tag"]).partitions()] == [3]
    monkeypatch.setattr(container, "PARTITION", 1)
    assert len(container.Reader(path, ["tag"]).partitions()) == 3
    # one genome again, then all anew
    more = contigs(spark, 2, "b")
    sketch.sketch(more, digest(more)).repartition("genome_id").write.format("s2ba").mode("append").save(path)
    assert rows(spark.read.format("s2ba").load(path)) == rows(sketch.db_add(own, sketch.sketch(more, digest(more))))
    sketch.sketch(more, digest(more)).repartition("genome_id").write.format("s2ba").mode("overwrite").save(path)
    assert os.listdir(path) == ["b.s2ba"]


def test_failed_write_changes_nothing(spark, tmp_path):
    container.register(spark)
    path = str(tmp_path / "db")
    c = contigs(spark, 3, "a", "b")
    own = sketch.sketch(c, digest(c))
    own.repartition("genome_id").write.format("s2ba").mode("append").save(path)
    bad = own.withColumn("tag", F.when(F.col("genome_id") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("tag")))
    with pytest.raises(Exception, match="broken"):
        bad.repartition("genome_id").write.format("s2ba").mode("overwrite").save(path)
    with pytest.raises(Exception, match="several tasks"):
        own.where("genome_id = 'a'").repartition(4).write.format("s2ba").mode("append").save(path)
    assert rows(spark.read.format("s2ba").load(path)) == rows(own)


def test_database_states(spark, tmp_path, monkeypatch):
    db = SketchDatabase(spark, str(tmp_path / "db"))
    assert db.state() == (0, ["BcgI", "AlfI", "AloI", "FalI"]) and db.read().count() == 0
    first = contigs(spark, 4, "a", "b")
    panel = ["BcgI", "CjeI"]
    assert db.put(sketch.sketch(first, digest(first, resolve(panel))), panel) == 1
    again = contigs(spark, 5, "b", "c")
    assert db.add(again) == 2 and db.state() == (2, panel)
    # what was added has the database's panel, and replaced the genome of its name whole
    want = sketch.sketch(first.where("genome_id = 'a'"), digest(first.where("genome_id = 'a'"), resolve(panel))).unionByName(sketch.sketch(again, digest(again, resolve(panel))))
    assert rows(db.read()) == rows(want) and {r.enzyme for r in db.read().where("tag is not null").collect()} == set(panel)
    assert rows(db.read(1)) == rows(sketch.sketch(first, digest(first, resolve(panel))))
    assert db.remove(["a", "nowhere"]) == 3 and {r.genome_id for r in db.genomes().collect()} == {"b", "c"}
    # a write that dies before its commit leaves the old state
    held = rows(db.read())
    with monkeypatch.context() as m:
        m.setattr(SketchDatabase, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            db.add(contigs(spark, 6, "b", "d"))
    assert db.state()[0] == 3 and rows(db.read()) == held
    # of two writers from one state the second fails
    with monkeypatch.context() as m:
        m.setattr(SketchDatabase, "state", lambda self: (2, panel))
        with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
            db.remove(["b"])
    assert rows(db.read()) == held


def test_merge_and_panels(spark, tmp_path):
    one, two = (SketchDatabase(spark, str(tmp_path / n)) for n in ("one", "two"))
    a, b = contigs(spark, 7, "a", "b"), contigs(spark, 8, "b")
    one.add(a)
    two.put(sketch.sketch(b, digest(b, resolve(["BcgI"]))), ["BcgI"])
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        one.merge([two])
        assert database.warn_of_other_panels(one.read(), one.state()[1]) == 1
    assert sum("another panel" in str(w.message) for w in said) == 2
    assert {(r.genome_id, r.n) for r in one.read().groupBy("genome_id").agg(F.countDistinct("enzyme").alias("n")).collect()} == {("a", 4), ("b", 1)}
    g = commands.Genomes.from_sketches(one.read())
    assert g.tags.select("genome_id").distinct().count() == 2
