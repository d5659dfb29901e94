import gzip

import numpy as np
import pytest

from tagloom.operators.digest import digest, digest_segments
from tagloom.operators.enzymes import resolve, usable
from tagloom.sources.fasta import cut_segments, read_fasta, read_segments, segment_contigs


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Records longer than several splits, many in one split, empty ones, blank lines, carriage returns, small letters."""
    rng = np.random.default_rng(9)
    path = tmp_path_factory.mktemp("fasta")
    base = lambda n: "".join(rng.choice(list("ACGTacgtN"), n, p=[0.22] * 4 + [0.029] * 4 + [0.004]))

    def record(name, n, width=60, end="\n"):
        s = base(n)
        return f">{name}{end}" + end.join(s[k : k + width] for k in range(0, n, width)) + (end if n else "")

    (path / "one.fa").write_text(record("chr one", 300_000) + record("empty", 0) + record("chr2", 70_001, 71) + "\n\n" + "".join(record(f"c{k}", int(rng.integers(0, 90))) for k in range(400)) + record("last", 5_000))
    (path / "two.fasta").write_bytes((record("x", 40_000, 60, "\r\n") + record("y", 30, 60, "\r\n")).encode())
    with gzip.open(path / "three.fna.gz", "wt") as f:
        f.write(record("z one", 50_000) + record("z two", 900))
    (path / "four.fas").write_text("")
    return str(path)


def test_segments_are_the_records(spark, files):
    want = read_fasta(spark, files).cache()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split, size in (("4096", 1000), ("20000", 1 << 20), ("128m", 7)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = read_segments(spark, files, size)
            assert rows(segment_contigs(got)) == rows(want.select("genome_id", "contig_id", "contig_name", "length"))
            whole = {}
            for r in got.select("genome_id", "contig_id", "start", "seq").collect():
                whole.setdefault((r.genome_id, r.contig_id), []).append((r.start, r.seq))
            for r in want.collect():
                own = sorted(x for x in whole[r.genome_id, r.contig_id] if x[1])
                assert "".join(s for _, s in own) == r.seq and [a for a, _ in own] == np.cumsum([0, *[len(s) for _, s in own]])[: len(own)].tolist()
            if split == "4096":
                assert len([s for _, s in whole["one", 0] if s]) > 250 and rows(digest_segments(got)) == rows(digest(want))
        named = read_segments(spark, files, genome_from_stem=False).select("genome_id").distinct()
        assert rows(named) == rows(read_fasta(spark, files, genome_from_stem=False).select("genome_id").distinct())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tags_across_edges(spark, files):
    c = read_fasta(spark, files)
    want = rows(digest(c, usable()))
    for size in (5, 26, 33, 4096):
        assert rows(digest_segments(cut_segments(c.where("length < 80000"), size), usable())) == rows(digest(c.where("length < 80000"), usable()))
    assert rows(digest_segments(cut_segments(c), usable())) == want and len(want) > 1000
    assert digest_segments(cut_segments(c.limit(0)), resolve()).count() == 0


def test_not_fasta(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nACGT\n")
    with pytest.raises(Exception, match="not FASTA"):
        read_segments(spark, str(tmp_path)).count()
