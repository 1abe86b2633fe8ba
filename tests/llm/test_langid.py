import math
from collections import defaultdict

import numpy as np
import pyarrow as pa

from graingrid.llm import op06_langid as L
from graingrid.llm.textcore import flat, fold


def brute_bits(train, text, order):
    """Code length by walking the contexts of a plain dictionary."""
    low = lambda t: bytes(fold(np.frombuffer(t.encode(), np.uint8)))
    counts = defaultdict(lambda: defaultdict(int))
    for t in train:
        b = b"\n" * order + low(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    bits, b = 0.0, b"\n" * order + low(text)
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = counts.get(b[i - k : i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if b[i] in seen:
                bits -= math.log2(seen[b[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    train = {"a": ["the cat sat on the mat", "a cat", "Été à Paris"], "b": ["der hund lag im hof", "ein hund"], "c": ["x"]}
    texts = ["the dog sat", "der Hund", "zzz 9 été", "", "t", "the cat sat on the mat", "ünknown ßtuff"]
    m = L.PPM(train, 3)
    got = m.bits(*flat(pa.array(texts)))
    want = [[brute_bits(train[lang], t, 3) for lang in m.languages] for t in texts]
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-4)


def test_held_out_accuracy_and_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    m = L.train(docs.where("doc_id % 2 = 0"))
    held_out = docs.where("doc_id % 2 = 1")
    got = held_out.join(L.identify(held_out, m), "doc_id").select("lang", "language", "accepted").collect()
    assert np.mean([r.lang == r.language for r in got]) > 0.95
    assert np.mean([r.accepted for r in got]) > 0.995


def test_edges(spark):
    m = L.PPM({"en": ["the cat sat on the mat and the dog ran to the house"] * 3, "de": ["der hund lag im hof und die katze lief in das haus"] * 3})
    rows = [(1, "the cat and the dog", "x"), (1, "der hund und die katze", "y"), (2, None, None), (3, "", "z"), (4, " !?. ", "z"), (None, "the mat", "z"), (5, "qzxj kvwq zzxq jjvk qqzx vkjq", "z"), (6, "the cat " * 40000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string")
    got = sorted(map(tuple, L.identify(df, m).collect()), key=str)
    by = lambda i: [r for r in got if r[0] == i]
    assert {r[1] for r in by(1)} == {"en", "de"} and all(r[4] for r in by(1))
    assert all(by(i)[0][1] is None and by(i)[0][2] == 0 and not by(i)[0][4] for i in (2, 3))
    assert not by(4)[0][4] and not by(5)[0][4] and by(6)[0][4] and by(None)[0][4]
    kept = L.keep_known(df, m)
    assert kept.columns == ["doc_id", "text", "language"] and kept.count() == 4


def test_a_key_in_a_short_sentence_is_no_reason_to_reject(spark):
    base = ["the cat sat on the mat and the dog ran to the house while the rain fell on the town"] * 3
    m = L.PPM({"en": base})
    df = spark.createDataFrame([(1, "the cat 4a13bc3f14f7945614a0203af883334c312a9d6f the house and the dog")], "doc_id long, text string")
    assert L.identify(df, m).first().accepted


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(df, L.train(df)).count() == 0
    df = spark.createDataFrame([(1, "some words", None), (2, "more", "")], "doc_id long, text string, lang string")
    got = L.identify(df, L.train(df)).collect()
    assert [(r.language, r.accepted) for r in got] == [(None, False)] * 2
