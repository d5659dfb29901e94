import os

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tagloom.llm import tokencount
from tagloom.llm.packing import tokenizer_path
from tagloom.llm.tokencount import count_tokens, counter, drops_space_and_case, normalised, op12_token_counts, stored_counts, version

from .common_rows import LONG, frame
from .test_packing import ODD

TOKENIZER = Tokenizer.from_file(tokenizer_path())


def plain(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def test_normalising_keeps_the_count():
    texts = [t for t in ODD if t] + ["A\n\t B\x0bC", " <|ENDOFTEXT|> ", "<|endoftext|>X\r\n<| Endoftext|>", "Á ́b", "e\ń", "x Y \x85z \x1cQ"]
    for t in texts:
        assert plain(normalised(t.encode(), True).decode()) == plain(t), repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_the_library(name):
    path = public_tokenizers.path(name)
    got = counter(path)(pa.array(ODD)).tolist()
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(p.encode(t or "")) for t in ODD]
    else:
        t_ = Tokenizer.from_file(path)
        want = [len(t_.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    assert got == want
    assert drops_space_and_case(path) == (name == "word_bpe_49k.json")
    assert len(counter(path)(pa.array([], pa.string()))) == 0


def test_query_by_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), plain(r.text), plain(r.text) > 2048) for r in docs)
    assert sorted(tuple(r) for r in op12_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), tokenizer_path()
    first = spark.createDataFrame([(1, "One two"), (2, "one   TWO\n"), (3, "three"), (4, None), (5, ""), (3, "three")], "doc_id long, text string")

    def held():
        return [r for r in pq.read_table(cache).to_pylist()] if os.path.isdir(cache) else []

    empty = count_tokens(first.limit(0), cache)
    assert empty.collect() == [] and held() == []
    want = sorted([(1, 7, 2), (2, 10, 2), (3, 5, 1), (3, 5, 1), (4, 0, 0), (5, 0, 0)])
    assert sorted(map(tuple, count_tokens(first, cache).collect())) == want
    assert len(held()) == 3  # one two, three, empty
    assert sorted(map(tuple, count_tokens(first, cache).collect())) == want
    assert len(held()) == 3
    # what is stored is what is given back, and only news are added
    more = first.unionByName(spark.createDataFrame([(6, "four and five"), (7, "four and five")], "doc_id long, text string"))
    assert sorted(map(tuple, count_tokens(more, cache).collect())) == sorted([*want, (6, 13, 3), (7, 13, 3)])
    assert len(held()) == 4
    # another tokenizer is another version
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert version(other) != version(path)
    got = {r.doc_id: r.n_tokens for r in count_tokens(first, cache, other).collect()}
    assert got[2] != got[1] and len(held()) == 4 + 4  # white space and case count there


def test_crowded_filters_and_a_doubled_cache(spark, tmp_path, monkeypatch):
    """Filters of 64 bits confuse nearly all; counts and cache stay the same. A digest that two runs appended counts once."""
    bitmap = tokencount.bitmap
    monkeypatch.setattr(tokencount, "bitmap", lambda df, c: bitmap(df, c, 7))
    cache = str(tmp_path / "cache")
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(concat('w', id % 200, ' '), 3) as text").repartition(5)
    want = {k: plain(f"w{k % 200} " * 3) for k in range(300)}
    for known in (docs.where("doc_id < 120"), docs, docs):
        got = {r.doc_id: r.n_tokens for r in count_tokens(known, cache).collect()}
        assert got == {k: want[k] for k in got}
    assert pq.read_table(cache).num_rows == 200
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, cache).collect()} == want
    assert stored_counts(spark, cache, version(tokenizer_path())).count() == 200


def test_odd_rows(spark, tmp_path):
    rows = frame(spark).withColumnsRenamed({"kept": "digest", "n_chars": "n_tokens", "source": "head"})
    got = sorted(map(tuple, count_tokens(rows, str(tmp_path / "cache")).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), plain(r.text)) for r in rows.collect()), key=str)
    assert got == want and (5, len(LONG), 60_000) in got
