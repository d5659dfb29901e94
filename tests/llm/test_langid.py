import zlib

import numpy as np
import pyarrow as pa

from tagloom.llm.common import text_buffer
from tagloom.llm.langid import ORDER, PAD, UNIT, Model, has_letter, identify, learn, op8_ppm_langid

from .common_rows import frame, rows


def counts(texts):
    out = {}
    for t in texts:
        b = bytes([PAD] * ORDER) + t.encode()
        for k in range(ORDER, len(b)):
            g = int.from_bytes(b[k - ORDER : k + 1], "big")
            out[g] = out.get(g, 0) + 1
    keys = sorted(out)
    return np.array(keys), np.array([out[k] for k in keys])


def brute_length(train, text):
    """Code length by walking the context tree byte by byte."""
    tree = {}
    for t in train:
        b = bytes([PAD] * ORDER) + t.encode()
        for k in range(ORDER, len(b)):
            for n in range(ORDER + 1):
                tree.setdefault(b[k - n : k], {}).setdefault(b[k], 0)
                tree[b[k - n : k]][b[k]] += 1
    total, b = 0, bytes([PAD] * ORDER) + text.encode()
    for k in range(ORDER, len(b)):
        bits = 0.0
        for n in range(ORDER, -1, -1):
            seen = tree.get(b[k - n : k])
            if not seen:
                continue
            s = sum(seen.values()) + len(seen)
            if b[k] in seen:
                bits -= np.log2(seen[b[k]] / s)
                break
            bits -= np.log2(len(seen) / s)
        else:
            bits += 8
        total += round(bits * UNIT)
    return total


def test_code_lengths_are_exact():
    train = {"a": ["abcab abd", "bad cab", "a"], "b": ["xyz zyx", "yyz é"]}
    m = Model({k: counts(v) for k, v in train.items()})
    texts = ["abcab", "xyz", "q", "", "aé z", "abdabdabd xyx", "x"]
    got = m.lengths(*text_buffer(pa.array(texts)))
    for i, t in enumerate(texts):
        for j, lang in enumerate(m.langs):
            assert abs(got[i, j] - brute_length(train[lang], t)) <= len(t.encode())


def test_no_code_length_is_cut():
    """A byte that only the escapes of all orders reach: more than 32 bits."""
    train = {"a": ["a" * 20_000], "b": ["b" * 20_000 + "q"]}
    m = Model({k: counts(v) for k, v in train.items()})
    text = "a" * 10 + "q"
    got = m.lengths(*text_buffer(pa.array([text])))[0]
    for j, lang in enumerate(m.langs):
        assert abs(got[j] - brute_length(train[lang], text)) <= len(text)
    assert got[0] > 32 * UNIT


def test_a_rare_language_keeps_its_contexts():
    common = ["".join(chr(97 + (k * k + j * k) % 20) for k in range(400)) for j in range(60)]
    m = Model({"common": counts(common), "rare": counts(["zvwzvwzvw"])}, states=40)
    kept = m.state_of.reshape(m.symbols, m.symbols, m.symbols)
    assert kept[m.of[122], m.of[118], m.of[119]] >= m.symbols


def test_ids_are_those_of_the_smallest_hash(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(k, f"text {k} {'abc' * (k % 7)}", "x" if k % 10 else "y") for k in range(900)], "doc_id long, text string, lang string")
    first = d.withColumn("h", F.xxhash64("doc_id")).toPandas().sort_values("h").groupby("lang").head(50)
    want = Model({x: counts(g.text.tolist()) for x, g in first.groupby("lang")})
    got = learn(d, sample=50)
    assert got.langs == want.langs and all((a == b).all() for a, b in zip(got.cost, want.cost))


def test_pruning_keeps_shorter_contexts():
    train = {"a": counts(["the cat sat on the mat"]), "b": counts(["der hund und die katze"])}
    few, all_ = Model(train, states=5), Model(train)
    assert few.n_states == few.symbols + 5 < all_.n_states
    got = few.lengths(*text_buffer(pa.array(["the cat", "die katze"])))
    assert got[0].argmin() == 0 and got[1].argmin() == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows_ = op8_ppm_langid(spark, sf).collect()
    assert len(rows_) == len(true)
    held = [r for r in rows_ if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows_)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark):
    docs = frame(spark, (7, "123 ² _ 4", "en", "s", 1, "x"), (8, "the one", "xx", "s", 1, "x"))
    m = learn(docs)
    assert m.langs == ["en", "xx"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, m).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 7)) and got[4][0] == "en" and got[8][0] == "xx"
    assert identify(docs, m).count() == len(rows()) + 2 and identify(docs.limit(0), m).count() == 0
    assert {r.lang_pred for r in identify(docs, learn(docs.where("lang = 'nothing'"))).collect()} == {"und"}
    assert has_letter("é") and not has_letter("1_²") and not has_letter(None)
