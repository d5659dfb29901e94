import random

from pyspark.sql import functions as F

from tagloom.functions import sequence as seq

FLIP = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


def rc(s):
    return s[::-1].translate(FLIP)


def packed(s):
    v = sum("ACGT".index(c) << (2 * k) for k, c in enumerate(s))
    return v - (1 << 64) if v >> 63 else v


def test_strings_and_bits(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1, 2, 15, 16, 17, 25, 27, 28, 31, 32) for _ in range(20)] + ["T" * 32, "A" * 32]
    other = [w[:-1] + rng.choice("ACGT") for w in words]
    df = spark.createDataFrame(list(zip(words, other)), "a string, b string")
    p = seq.pack(F.col("a"))
    for r in df.select("a", "b", seq.revcomp(F.col("a")).alias("rc"), p.alias("p"), seq.canonical(F.col("a")).alias("c"), seq.gc_content(F.col("a")).alias("gc"), seq.packed_mismatches(p, seq.pack(F.col("b"))).alias("mm"), seq.screen_key(F.col("a")).alias("key"), seq.screen_key(seq.revcomp(F.col("a"))).alias("key2")).collect():
        assert r.rc == rc(r.a) and r.p == packed(r.a) and r.c == min(r.a, rc(r.a))
        assert r.mm == sum(x != y for x, y in zip(r.a, r.b))
        assert abs(r.gc - sum(x in "GC" for x in r.a) / len(r.a)) < 1e-12
        if len(r.a) % 2 == 0 or len(r.a) <= 18:
            assert r.key == r.key2
    full = spark.createDataFrame([(w,) for w in words if len(w) == 32], "a string")
    assert all(r.a == r.u for r in full.select("a", seq.unpack(seq.pack(F.col("a")), 32).alias("u")).collect())


def test_edges(spark):
    df = spark.createDataFrame([("",), ("ACGTN",), ("acgt",), ("AXC",), (None,)], "s string")
    rows = df.select("s", seq.revcomp(F.col("s")).alias("rc"), seq.is_pure(F.col("s")).alias("pure"), seq.gc_content(F.col("s")).alias("gc")).collect()
    assert [(r.rc, r.pure, r.gc) for r in rows] == [("", False, 0.0), ("NACGT", False, 0.4), ("ACGT", True, 0.5), ("GNT", False, 1 / 3), (None, None, None)]
    codes = spark.createDataFrame([(b, c, b in x) for c, x in seq.IUPAC_BASES.items() for b in "ACGT"], "b string, c string, want boolean")
    assert codes.where(seq.iupac_matches(F.col("b"), F.col("c")) != F.col("want")).count() == 0


def test_parts():
    assert [b - a for a, b in seq.part_bounds(27, 3)] == [9, 9, 9]
    assert [b - a for a, b in seq.part_bounds(32, 3)] == [11, 11, 10]
    assert [b - a for a, b in seq.part_bounds(28, 3)] == [10, 9, 9]
    assert [b - a for a, b in seq.part_bounds(25, 3)] == [9, 8, 8]


def test_lengths_need_no_sequence(spark):
    """As many as the bases of the sequence, also of no text and of other letters; the letters are not mapped for it."""
    from tagloom.sources.fasta import document_contigs, text_contigs

    rows = [(1, "Ab c-9", "s"), (2, None, "s"), (3, "", None), (4, "éz\U0001d49cQ\n", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in (document_contigs(docs), text_contigs(docs, "source", "doc_id", "text")):
        assert [(r.contig_id, r.length, len(r.seq)) for r in c.orderBy("contig_id").collect()] == [(1, 3, 3), (2, 0, 0), (3, 0, 0), (4, 2, 2)]
        plan = c.select("contig_id", "length")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" in plan and "translate" not in plan
        assert dict(c.dtypes)["length"] == "bigint" and c.columns == ["genome_id", "contig_id", "seq", "length"]
