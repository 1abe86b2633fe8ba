import numpy as np
import pytest

from graingrid.llm import op07_mixing as M
from graingrid.llm.durable import checkpointed


def test_rates_meet_targets(spark, sf):
    base = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = M.mix(docs.withColumnRenamed("source", "rate"), labels)
    assert out.columns == ["doc_id", "text", "lang", "n_chars", *M._RESULT]
    p = out.drop("text").toPandas()
    share = [(p.rate * p.n_tokens * p[f"p_{d}"]).sum() / p.n_tokens.sum() for d in M.DOMAINS]
    np.testing.assert_allclose(share, [M.TARGETS[d] for d in M.DOMAINS], atol=2e-4)
    assert (p.rate >= 0).all() and len(p) == docs.count()
    np.testing.assert_allclose(p.p_high + p.p_low + p.p_toxic, 1, atol=1e-9)
    assert abs(p.copies.mean() - p.rate.mean()) < 0.05


def test_classifier_on_held_out_labels(spark, sf):
    base = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    m = M.train(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id")
    from graingrid.llm.textcore import flat
    import pyarrow as pa

    rows = held.select("text", "quality", "toxic").collect()
    p, _ = m.posteriors(*flat(pa.array([r.text for r in rows])))
    toxic, quality = np.array([r.toxic for r in rows]), np.array([r.quality for r in rows])
    assert ((p[:, 2] > 0.5) == toxic).mean() > 0.93
    assert ((p[:, 0] > p[:, 1]) == quality).mean() > 0.95


@pytest.mark.parametrize("targets", [{"high": 0.6, "low": 0.3, "toxic": 0.1}, {"high": 0.0, "low": 0.0, "toxic": 1.0}])
def test_iterations_equal_a_plain_loop(spark, targets):
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([0.3, 0.4, 0.2], 500), rng.integers(0, 400, 500)
    df = checkpointed(spark.createDataFrame([(int(k), *map(float, r)) for k, r in zip(n, p)], "n_tokens long, p_high double, p_low double, p_toxic double").repartition(5))
    moves = M.fit_rates(df, targets)
    r = np.ones(500)
    white = np.linalg.pinv((p * n[:, None]).T @ p / n.sum(), rcond=1e-6, hermitian=True)
    want = np.array([targets[d] for d in M.DOMAINS])
    for _ in range(M.STEPS):
        gap = (r * n) @ p / n.sum() - want
        if np.abs(gap).max() < M.TOLERANCE:
            break
        r = np.maximum(0, r - p @ (white @ gap))
    np.testing.assert_allclose(M._rates(p, moves), r, atol=1e-6)
    # all of one domain can't be had from mixed documents; what is possible is met
    assert np.abs((r * n) @ p / n.sum() - want).max() < (0.001 if targets["high"] else 0.1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "fine words here", "a"), (1, "fine words here", "a"), (2, None, None), (3, "", "b"), (None, "bad bad idiot", "c"), (4, "long text " * 50000, "d")], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = M.mix(docs, labels).collect()
    assert len(out) == 6 and all(r.rate >= 0 for r in out)
    assert sorted(r.n_tokens for r in out) == [0, 0, 3, 3, 3, 100000]
    assert len({(r.rate, r.copies) for r in out if r.doc_id == 1}) == 1
    none = M.mix(docs, labels.where("false")).collect()
    assert {round(r.p_high, 6) for r in none} == {0.333333}
    assert M.mix(docs.where("false"), labels).count() == 0
    assert M.mix(docs.where("text is null or text = ''"), labels).count() == 2


def test_clashing_names_and_repeated_labelled_ids(spark):
    rows = [(k // 2, f"word{k} text some more {'Loud !!!' if k % 3 else 'calm'}", 1.5, 2, "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spin double, RATE int, __text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    out = M.mix(docs, labels)
    assert out.columns == ["doc_id", "text", "spin", "__text", "n_tokens", "p_high", "p_low", "p_toxic", "rate", "copies"]
    assert out.where("spin = 1.5 and rate >= 0 and __text = 'x'").count() == 40
