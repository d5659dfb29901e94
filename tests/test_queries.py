"""Every query with SQL equals DuckDB; the others give rows of a stable schema."""

import duckdb
import pytest

from tagloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = sorted(tuple(norm(v) for _, v in sorted(r.asDict().items())) for r in df.collect())
    r = con.sql(SQL[name])
    assert sorted(r.columns) == sorted(df.columns)
    order = sorted(range(len(r.columns)), key=lambda k: r.columns[k])
    assert got == sorted(tuple(norm(x[k]) for k in order) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_matrices_have_every_source(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf}/documents.parquet")
    more = d.where("source in ('src1', 'src2')").select(*[F.concat(F.lit("new."), c).alias(c) if c == "source" else c for c in d.columns])
    d.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["genome"]: r.asDict() for r in QUERIES["screen_matrix"](spark, str(tmp_path)).collect()}
    names = {f"src{k}" for k in range(20)} | {"new.src1", "new.src2"}
    assert set(got) == names and all(set(r) == names | {"genome"} for r in got.values())
    assert all(got[g][g] == 1.0 for g in names) and got["src1"]["new.src1"] == got["new.src1"]["src1"] == 1.0
