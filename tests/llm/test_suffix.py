import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from graingrid.llm import op08_suffix as S

DOCS = "doc_id long, text string, hash long, place string"


def brute(rows, n):
    """Word places covered by a passage of n words that occurs again, and of those that occurred before."""
    occ = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        for k in range(len(w) - n + 1):
            occ[tuple(w[k : k + n])].append((i, k))
    every, later = defaultdict(set), defaultdict(set)
    for at in occ.values():
        if len(at) > 1:
            for m, (i, k) in enumerate(sorted(at)):
                every[i].update(range(k, k + n))
                if m:
                    later[i].update(range(k, k + n))
    return every, later


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [make(n) for n in (55, 80, 120, 300, 51, 50, 49)]
    rows = []
    for k in range(80):
        words = make(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            words += p + make(rng.randint(0, 30))
        rows.append((k, words))
    for k in range(20):
        copy = list(rows[k][1])
        for at in rng.sample(range(len(copy)), len(copy) // 60):
            copy[at] = "edit"
        rows.append((100 + k, copy))
    rows += [(200 + k, passages[3] + make(k)) for k in range(60)] + [(300, passages[2] + make(70) + passages[2])]
    return [(i, ", ".join(w)) for i, w in rows]


def cover(out):
    every, later = defaultdict(set), defaultdict(set)
    for r in out:
        assert r.n_words == r.end_word - r.start_word >= 1
        every[r.doc_id].update(range(r.start_word, r.end_word))
        if r.duplicate:
            later[r.doc_id].update(range(r.start_word, r.end_word))
    return every, later


def test_equals_brute_force(spark):
    rows = corpus() + [(400 + k, f"{'x' * (k % 5 + 1)}, " + "boiler plate line of words that all of these share " * 6 + " ".join(f"q{k}z{j}" for j in range(60))) for k in range(40)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)
    want = brute(rows, 50)
    assert all(sum(map(len, w.values())) > 5000 for w in want)
    for params in ({}, {"hot": 3, "broadcast_bytes": 0}, {"hot": 30}):
        got = cover(S.passages(df, **params).collect())
        assert [{i: c for i, c in g.items() if c} for g in got] == [dict(w) for w in want], params


def test_many_batches_keep_their_groups():
    """Keys that go on over batches, copies and spans, against the same in one batch."""
    rng = random.Random(4)
    rows = corpus(5)
    texts = [t for _, t in rows] * 3
    rng.shuffle(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    marks = pa.Table.from_batches(S._anchors(50, 16)(iter([batch]))).sort_by("key")
    split = pa.Table.from_batches([b for k in range(0, len(texts), 7) for b in S._anchors(50, 16)(iter([batch.slice(k, 7)]))]).sort_by("key")
    found = [{(r["row"], r["place"]) for b in S._repeated(5)(iter(t.to_batches(n))) for r in b.to_pylist() if not r["n"]} for t, n in ((marks, 1 << 20), (split, 1 << 20), (split, 3))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 500
    hot = [{(r["hash"], r["n"]) for b in S._repeated(5)(iter(t.to_batches(n))) for r in b.to_pylist() if r["n"]} for t, n in ((marks, 1 << 20), (split, 1 << 20), (split, 3))]
    assert hot[0] == hot[1] == hot[2] and hot[0]


def test_suffix_sort_orders_and_extends():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 30, 300)
    words = rng.integers(0, 3, size.sum()).astype(np.uint32)
    ends = np.cumsum(size)
    start = ends - size
    text = S.Text(words, ends)
    group = np.sort(rng.integers(0, 9, 300))
    low, high = np.searchsorted(group, group), np.searchsorted(group, group, "right")
    order = text.suffix_sort(start, low, high)
    keys = [(group[k], words[start[k] : ends[k]].tolist(), k) for k in range(300)]
    assert [keys[k] for k in order] == sorted(keys)
    a, b = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    for i, j, n in zip(a, b, text.common(start[a], start[b], ends[a], ends[b])):
        x, y = words[start[i] : ends[i]], words[start[j] : ends[j]]
        m = min(len(x), len(y))
        eq = x[:m] == y[:m]
        assert n == (m if eq.all() else eq.argmin())


def test_collisions_are_cut():
    text = S.Text(np.array([1, 2, 3, 9, 1, 2, 4, 9], np.uint32), np.array([4, 8]))
    assert text.verified(np.array([0]), np.array([4]), np.array([4])).tolist() == [2]


def test_edges(spark):
    p = " ".join(f"w{k}" for k in range(60))
    rows = [(1, p, 1, "x"), (1, p, 1, "x"), (2, None, 1, "x"), (3, "", None, None), (None, p, 1, "x"), (4, "a b c", 1, "x"), (5, "same " * 30000, 1, "x"), (6, "Q " + p.upper(), 1, "x")]
    got = S.passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in got} == {1, 5, 6}
    assert {(r.start_word, r.end_word) for r in got if r.doc_id == 6 and r.duplicate} == {(1, 61)}
    assert S.passages(spark.createDataFrame([], DOCS)).count() == 0
    apart = spark.createDataFrame([(1, p, 1, "x"), (1, "other words", 1, "x"), (2, p, 1, "x")], DOCS)
    assert {r.doc_id for r in S.passages(apart).collect()} == {1, 2}


def test_sql_gives_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(S.ORACLE_SQL).fetchall()
    got = S.passages(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10
