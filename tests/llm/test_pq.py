import numpy as np

from graingrid.llm import op05_pq as P

SCHEMA = "vec_id long, embedding array<float>, id long, list int"


def brute(ids, x, threshold):
    """For each id: the smallest id of its component, and its number of links."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        least = np.minimum(label, np.where(near, label, len(x)).min(1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return {int(i): (int(ids[label[k]]), int(near[k].sum())) for k, i in enumerate(ids)}


def made(seed=2, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(1500, dim))
    near = base[:700] + rng.normal(size=(700, dim)) * 0.2
    # a third of all rows: near copies of one vector, and exact ones
    hot = np.vstack([base[3] + rng.normal(size=(900, dim)) * 0.1, np.tile(base[0], (200, 1))])
    x = np.vstack([base, near, base[:100], hot]).astype(np.float32)
    return np.arange(len(x)) * 3, x


def test_classes_and_links_against_brute_force(spark):
    ids, x = made()
    df = spark.createDataFrame([(int(i), v.tolist(), None, 0) for i, v in zip(ids, x)], SCHEMA)
    for threshold, options in ((0.95, ({}, {"block": 64})), (0.9, ({"sigmas": 6.0, "block": 500},))):
        want = brute(ids, x.astype(np.float64), threshold)
        for params in options:
            got = {r.vec_id: r for r in P.classes(df, threshold=threshold, **params).collect()}
            assert set(got) == set(want)
            links, all_links = sum(r.links for r in got.values()), sum(n for _, n in want.values())
            assert all_links > 100000 and all(r.links <= want[i][1] for i, r in got.items())
            assert links >= 0.99 * all_links
            assert sum(got[i].class_id == want[i][0] for i in want) >= 0.99 * len(want)
            if params.get("sigmas"):  # sqrt(32) and over: exact
                assert {i: (r.class_id, r.links) for i, r in got.items()} == want
    assert {got[3 * k].rep_id for k in (0, 2200, 3200, 3399)} == {0} and got[9].rep_id == 9


def test_edges(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v, 5, 1), (2, [2.0, 4.0, 6.0, 8.0], 5, 1), (3, None, 5, 1), (None, v, 5, 1), (4, [0.0] * 4, 5, 1), (5, [1.0, None, 1.0, 1.0], 5, 1), (6, [float("nan"), 1.0, 1.0, 1.0], 5, 1), (7, [1.0, 2.0], 5, 1), (8, [-1.0, -2.0, -3.0, -4.0], None, None), (1, v, 5, 1), (9, [], 1, 1), (10, [1e30, 2e30, 3e30, 4e30], 1, 1), (11, [1.0, 2.0, 3.0, 4.5], 1, 1)]
    got = {(r.vec_id, r.class_id, r.links) for r in P.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (8, 8, 0), (10, 1, 3), (11, 1, 3)}
    assert P.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in P.classes(spark.createDataFrame(rows[:1], SCHEMA)).collect()] == [(1, 1, 1, 0)]
    assert P.classes(spark.createDataFrame(rows[2:3] + rows[4:5], SCHEMA)).count() == 0
