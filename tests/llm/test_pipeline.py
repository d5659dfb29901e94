import corpus_pipeline
from tagloom.llm.packing import SCHEMA

from .common_rows import frame, rows
from .test_lines import brute as brute_lines
from .test_neardup import brute as brute_near
from .test_packing import whole
from .test_phrases import brute as brute_phrases
from .test_quality import brute as brute_quality
from tagloom.llm.quality import BUCKETS, THRESHOLD, trusted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = {r.doc_id for r in trusted(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    now = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows_ = out.collect()
        before = [(d, r.text) for d, r in now.items()]
        if name == "quality_rules":
            want = {d: now[d].text for d, *_, kept, _ in brute_quality(before, good, THRESHOLD, BUCKETS) if kept}
        elif name == "line_dedup":
            want = {d: t for d, t, _, n in brute_lines(before) if not n or (t or "").strip()}
        elif name == "near_duplicates":
            want = {d: now[d].text for d, _, c in brute_near(before) if d == c}
        elif name == "decontamination":
            want = {d: now[d].text for d, _, hit, _ in brute_phrases(before, items) if not hit}
        else:
            assert whole(rows_, {d: r.text for d, r in now.items()}) == 0 and out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
            break
        assert {r.doc_id: r.text for r in rows_} == want and len(rows_) == len(want) <= len(now)
        assert out.columns == COLUMNS and all((r.lang, r.source) == (now[r.doc_id].lang, now[r.doc_id].source) for r in rows_)
        assert all(r.n_chars == len(r.text) for r in rows_)
        docs, now = out, {r.doc_id: r for r in rows_}
    assert sum(r.length for r in corpus_pipeline.run(spark, sf).collect()) == sum(r.length for r in rows_)


def test_stages_bear_odd_rows(spark, sf):
    docs, none = frame(spark), frame(spark).limit(0)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).collect()
        kept[name] = [r.doc_id for r in out]
        assert stage(spark, none, sf).count() == 0
    assert len(kept["line_dedup"]) == len(rows())
    assert sorted(kept["near_duplicates"], key=str) == sorted([1, 2, 3, 4, 5, 6, None], key=str)
    assert set(kept["sequence_packing"]) == {r[0] for r in rows()}


def test_near_duplicates_of_repeated_ids(spark, sf):
    """Rows of one id are judged by their texts; of a component without ids one row a set stays."""
    text = lambda k, n=30: " ".join(f"w{k}x{j}" for j in range(n))
    rows_ = [(1, text(1)), (2, text(2)), (2, text(3)), (2, text(3)), (3, text(3) + " more"), (4, text(1)), (4, text(4)), (None, text(2)), (None, text(5)), (None, text(5)), (5, None), (5, None), (6, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    want = [(1, text(1)), (2, text(2)), (2, text(3)), (4, text(4)), (None, text(5)), (5, None), (5, None), (6, text(6))]
    assert sorted(kept, key=str) == sorted(want, key=str)
