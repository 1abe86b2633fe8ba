import random

import numpy as np
import pytest

from graingrid.llm import op10_simhash as S

DOCS = "doc_id long, text string, lang string, group_id string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = []
    for k in range(40):
        text = words(rng, rng.randint(60, 200))
        rows.append((10 * k, text, "en", "x"))
        if k % 2 == 0:
            rows.append((10 * k + 1, text.upper() + "!", "en", "x"))
        if k % 4 == 0:
            edited = text.split()
            for at in rng.sample(range(len(edited)), len(edited) // 40):
                edited[at] = "edited"
            rows.append((10 * k + 2, " ".join(edited), "en", None))
    return rows + [(1001, None, "en", "x"), (1002, "", "en", "x"), (1003, " .,! ", None, "x"), (None, rows[0][1], "en", "x")]


def brute(rows, radius=S.RADIUS, pair_radius=S.PAIR_RADIUS):
    """Components of the relation over all pairs."""
    from graingrid.llm.textcore import flat
    import pyarrow as pa

    rows = [r for r in rows if r[0] is not None]
    sig, n = S.signatures_of(*flat(pa.array([r[1] for r in rows])))
    label = {r[0]: r[0] for r in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if n[i] and n[j] and np.bitwise_count(sig[i, :2] ^ sig[j, :2]).sum() <= radius and np.bitwise_count(sig[i, 2:] ^ sig[j, 2:]).sum() <= pair_radius:
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                label[b] = a
    out = {x: root(x) for x in label}
    many = {r for x, r in out.items() if x != r}
    return {(x, r) for x, r in out.items() if r in many}


@pytest.mark.parametrize("limit,block", [(1 << 24, 1 << 17), (0, 1 << 17), (0, 3), (0, 1)])
def test_groups_match_brute_force_either_way(spark, limit, block):
    rows = corpus()
    got = {tuple(r) for r in S.groups(spark.createDataFrame(rows, DOCS), broadcast_bytes=limit, block=block).collect()}
    want = brute(rows)
    assert len(want) >= 50
    assert got == want


def test_stage_keeps_one_of_each_group_and_all_else(spark):
    rows = corpus()
    out = S.deduplicate(spark.createDataFrame(rows + [rows[1], rows[1]], DOCS))
    assert out.columns == ["doc_id", "text", "lang", "group_id"]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    gone = {x for x, r in brute(rows) if x != r}
    assert got == sorted((r[0] is None, r[0] or 0) for r in rows if r[0] not in gone)


def test_repeated_ids_are_one_document(spark):
    out = S.deduplicate(spark.createDataFrame([(7, "one two three four", "en", "g")] * 3 + [(8, None, "en", "g")] * 2, DOCS)).collect()
    assert sorted(r.doc_id for r in out) == [7, 8]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert S.groups(df).count() == 0 and S.deduplicate(df).count() == 0


def test_tree_search_finds_all_within_radius():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2**63, (400, 2), dtype=np.uint64)
    sig[200:] = sig[:200] ^ (np.uint64(1) << rng.integers(0, 60, (200, 2), dtype=np.uint64))
    forest = S.Forest(sig, np.repeat([0, 1], 200))
    got = {(int(q), int(n)) for a, b in forest.near(np.arange(400), 50) for q, n in zip(a, b)}
    d = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2)
    want = {(i, j) for i in range(400) for j in range(i) if d[i, j] <= 50 and (i < 200) == (j < 200)}
    assert got == want


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {tuple(r) for r in S.components(df).collect()}
    assert got == {(k, 0) for k in range(1, 61)} | {(101, 100)}


def test_long_text(spark):
    text = words(random.Random(1), 60000)
    got = S.groups(spark.createDataFrame([(1, text, "", ""), (2, text + " tail", "", "")], DOCS)).collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 1)}


def test_clashing_names(spark):
    rows = [(1, "some words of a text", "a", 1), (1, "some words of a text", "b", 2), (2, "other things entirely here", "c", 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __place string, place int")
    out = S.deduplicate(df)
    assert out.columns == df.columns and {(r.doc_id, r.place) for r in out.collect()} == {(1, 1), (2, 3), (None, None)}


def test_recall_at_the_edge_of_the_radius():
    """Pairs at 16 to 20 bits, all in one table set: found as often as the sampled bits say."""
    rng = np.random.default_rng(5)
    for d in (12, 16, 18, 20):
        base = rng.integers(0, 2, (1500, S.BITS), dtype=np.uint8)
        near = base.copy()
        for row in near:
            row[rng.permutation(S.BITS)[:d]] ^= 1
        both = np.packbits(np.vstack([base, near]), axis=1).view(np.uint64)
        sig, ids = np.hstack([both, np.zeros_like(both)]), np.arange(3000)
        keys, found = S.keys_of(sig), set()
        for t in range(S.TABLES):
            found |= set(zip(*(x.tolist() for x in S.linked(ids, sig, keys[:, t], S.RADIUS, S.PAIR_RADIUS))))
        got = sum((k + 1500, k) in found for k in range(1500)) / 1500
        assert got >= {12: 0.998, 16: 0.98, 18: 0.95, 20: 0.92}[d]
