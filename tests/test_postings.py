import itertools
import random

from pyspark.sql import functions as F

from tagloom.operators import digest, legacy, postings, screen
from tagloom.operators.postings import cells, lists, numbered, shared_counts
from tagloom.queries import QUERIES


def frame(spark, sets):
    return spark.createDataFrame([(g, k % 3, k) for g, ks in sets.items() for k in ks], "genome_id string, enzyme int, key long")


def test_counts_of_all_pairs(spark):
    rnd = random.Random(2)
    sets = {f"g{n}": {0, *rnd.sample(range(1, 200), rnd.randrange(0, 40))} for n in range(60)} | {"alone": {1000}, "big": set(range(200))}
    rows = frame(spark, sets)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    for block in (1, 7, 16, 512):
        got = {(r.query, r.reference): r.shared for r in shared_counts(rows, "genome_id", ["enzyme", "key"], block=block).collect()}
        assert got == want
    some = {g: s for g, s in sets.items() if g in ("g1", "g2", "alone", "big")} | {"new": {0, 1, 2}}
    got = {(r.query, r.reference): r.shared for r in shared_counts(rows, "genome_id", ["enzyme", "key"], frame(spark, some), block=9).collect()}
    assert got == {(a, b): len(sets[a] & some[b]) for a in sets for b in some if sets[a] & some[b]}


def test_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), (None, 1, 1), ("a", 1, None), ("b", 1, None), ("c", 1, 2)], "genome_id string, enzyme int, key long")
    assert [tuple(r) for r in shared_counts(rows, "genome_id", ["enzyme", "key"]).collect()] == [("a", "b", 1)]
    assert shared_counts(rows.limit(0), "genome_id", ["enzyme", "key"]).count() == 0
    assert screen.screen_pairs(rows.limit(0).withColumn("enzyme", F.lit("x"))).count() == 0


def test_a_key_of_all_sets_makes_few_rows(spark, monkeypatch):
    """One key of 3,000 sets: as many cell rows as pairs of blocks, over several slices of tasks, and each count leaves a task once."""
    monkeypatch.setattr(postings, "CELLS", 3)
    rows = spark.range(3000).select(F.concat(F.lit("g"), "id").alias("genome_id"), F.explode(F.array(*[F.lit(k).cast("long") for k in (7, 8, 9, 10)])).alias("key"))
    ids = numbered(rows.select(F.col("genome_id").alias("name")).distinct(), 250)
    made = cells(lists(rows, "genome_id", ["key"], ids), None, ["key"])
    assert made.count() <= 4 * (12 * 13) // 2 and made.select("slice").distinct().count() > 1
    assert made.agg(F.max(F.size("x"))).first()[0] < 400
    total = shared_counts(rows, "genome_id", ["key"], block=250)
    assert total.agg(F.count(F.lit(1)), F.min("shared"), F.max("shared")).first() == (3000 * 2999 // 2, 4, 4)


def test_a_batch_of_many_cells_holds_few(spark, monkeypatch):
    """Counts of thousands of cells in one batch are handed on as they come, and each alone."""
    import pyarrow as pa

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(postings, "FEW", 0)
    n = 400
    rows = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([[0, 1]] * n), pa.array([[2]] * n)], ["a", "b", "x", "y"])
    out = postings.counted(Rows())(iter([rows]))
    seen = []
    for batch in out:
        seen.append(batch.num_rows)
    assert seen == [2] * n


def test_passing_pairs_are_those_that_pass(spark):
    rnd = random.Random(5)
    sets = {f"g{n}": {0, 1, *rnd.sample(range(2, 30), rnd.randrange(0, 9))} for n in range(60)} | {f"c{n}": {0, 1, 2, 90} for n in range(5)} | {"two": {0, 1}, "other": {0, 1}, "alone": {1000}}
    rows = frame(spark, sets).unionByName(spark.createDataFrame([(None, 0, k) for k in range(9)], "genome_id string, enzyme int, key long"))
    for limits in ((3, 0.001), (3, 0.5), (1, 0.001), (6, 0.0)):
        pairs = screen.screen_pairs(rows, min_shared=limits[0], min_containment=limits[1]).where("verdict = 'pass'")
        want = {(r.query, r.reference, r.shared, r.min_total) for r in pairs.collect()}
        got = [tuple(r) for r in screen.passing_pairs(rows, *limits).collect()]
        assert len(want) > 9 and len(got) == len(want) and set(got) == want


def test_documents_of_a_common_key_are_not_paired(spark, tmp_path, monkeypatch):
    """150 documents that share one key alone, 60 copies, and a pair: what is counted are the pairs of distinct key sets that may pass."""
    rnd = random.Random(4)
    # d, a, b and g stand for A, C, G and T
    part = lambda n: "".join(rnd.choice("dabg") for _ in range(n))
    tag = lambda: f"{part(10)}abd{part(6)}gba{part(10)}"
    common, copied, near = tag(), "".join(tag() for _ in range(4)), "".join(tag() for _ in range(4))
    texts = [common + tag() + tag() for _ in range(150)] + [copied] * 60 + [near + tag(), near + tag()]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    counted, plain = [], screen.shared_counts

    def seen(*args, **kwargs):
        counted.append(plain(*args, **kwargs))
        return counted[-1]

    monkeypatch.setattr(screen, "shared_counts", seen)
    got = {(r.query, r.reference) for r in QUERIES["screen_documents"](spark, str(tmp_path)).collect()}
    assert got == {tuple(sorted(map(str, p))) for p in [*itertools.combinations(range(150, 210), 2), (210, 211)]}
    assert sum(c.count() for c in counted) < 20


def plain_kmers(seq, k):
    windows = [seq[p : p + k] for p in range(len(seq) - k + 1)]
    return {min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in windows if set(w) <= set("ACGT")}


def test_kmers_of_genomes_by_bins(spark, monkeypatch):
    """Genomes of several contigs, over 64 of them, odd letters, short and null sequences: the same by bins (of few places too) and by posting lists."""
    rnd = random.Random(9)
    pool = ["".join(rnd.choice("ACGT") for _ in range(60)) for _ in range(12)]
    rows = [(f"g{n}", c, rnd.choice(pool)[rnd.randrange(20) :] + rnd.choice(["N", ""]) + rnd.choice(pool)) for n in range(70) for c in range(3)]
    rows += [("short", 0, "ACGT"), ("null", 0, None), (None, 0, pool[0]), ("lower", 0, pool[1].lower())]
    contigs = spark.createDataFrame(rows, "genome_id string, contig_id long, seq string").repartition(9)
    for k, few in ((15, 512), (15, 8), (5, 512)):
        sets = {}
        for g, _, s in rows:
            if g is not None:
                sets.setdefault(g, set()).update(plain_kmers((s or "").upper(), k))
        want = {(a, b, len(sets[a] & sets[b]), len(sets[a])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
        monkeypatch.setattr(legacy, "BLOCK", few)
        got = [tuple(r)[:4] for r in legacy.kmer_containment(contigs, k).collect()]
        assert len(want) > 99 and len(got) == len(want) and set(got) == want


def test_kmers_are_met_as_lists(spark, monkeypatch):
    """The k-mers of a few genomes are never a row each: a task's rows are as many as genomes and bins, and it hands on what it holds."""
    rnd = random.Random(10)
    rows = [(n % 3, "".join(rnd.choice("ACGT") for _ in range(20_000))) for n in range(12)]
    contigs = spark.createDataFrame(rows, "number long, seq string").coalesce(1)
    monkeypatch.setattr(digest, "spread", lambda df: df)
    monkeypatch.setattr(digest, "BIN_BITS", 24)
    whole = digest.kmer_bins(contigs).count()
    assert 3 * 50 < whole <= 3 * 64
    monkeypatch.setattr(digest, "HELD", 30_000)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "1")
    try:
        bins = digest.kmer_bins(contigs)
        # two contigs of two genomes at a time
        assert whole < bins.count() <= 6 * 2 * 64
        assert bins.select(F.sum(F.length("high"))).first()[0] > 230_000
    finally:
        spark.conf.unset(batch)


def test_the_query_of_kmers_makes_no_posting_lists(spark, sf, monkeypatch):
    def none(*_, **__):
        raise AssertionError("posting lists of a few genomes")

    monkeypatch.setattr(legacy, "shared_counts", none)
    assert QUERIES["kmer_containment"](spark, sf).count() > 0
