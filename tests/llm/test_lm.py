import numpy as np
import pyarrow as pa

from graingrid.llm import op02_lm as L
from graingrid.llm.textcore import U, Words, flat, word_hash

DOCS = "doc_id long, text string, n_tokens string"


def test_training_beats_the_unigram_model_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").repartition(4)
    vocab, model = L.train(docs.where("doc_id % 10 <> 0"))
    held = docs.where("doc_id % 10 = 0")
    mean = lambda m: (lambda p: p.logprob.sum() / p.n_tokens.sum())(L.score(held, vocab, m).toPandas())
    assert mean(model) > mean(L.LogBilinear(vocab.size).start(vocab.count)) + 0.1


def test_probabilities_are_normalised_and_scores_equal_a_plain_sum(spark):
    rows = [(1, "a b c a b d", "z"), (2, "b b b", "z"), (3, None, "z"), (4, "", None), (5, " ?! ", "z"), (None, "a c", "z"), (1, "a b c a b d", "z"), (6, "a b " * 70000, "z")]
    df = spark.createDataFrame(rows, DOCS)
    vocab, model = L.train(df)
    assert vocab.count.sum() == sum(len((t or "").replace("?!", "").split()) for _, t, _ in rows)
    out = L.score(df, vocab, model).collect()
    assert len(out) == len(rows)
    for r, t in zip(out, [t for _, t, _ in rows][: len(out)]):
        w = Words(*flat(pa.array([t], pa.string())))
        ids = vocab.ids(w.hash)
        assert r.n_tokens == len(ids)
        if not len(ids):
            assert (r.logprob, r.mean_logprob, r.perplexity) == (0.0, None, None)
            continue
        total = 0.0
        for k in range(min(len(ids), 6)):
            ctx = [ids[k - 1 - j] if k - 1 - j >= 0 else vocab.size for j in range(model.context)]
            s = model.q.astype(np.float64) @ sum(model.c[j].astype(np.float64) * model.r[c] for j, c in enumerate(ctx)) + model.b
            p = np.exp(s - s.max())
            p /= p.sum()
            total += np.log(p[ids[k]])
        if len(ids) <= 6:
            assert abs(total - r.logprob) < 1e-3 and abs(r.perplexity - np.exp(-total / len(ids))) < 1e-2


def test_noise_contrastive_estimation_learns_a_rule():
    rng = np.random.default_rng(0)
    word = np.zeros(20000, np.int32)
    for k in range(1, len(word)):
        word[k] = (word[k - 1] + 1) % 8 if rng.random() < 0.9 else rng.integers(8)
    ctx = L.contexts(word, np.array([0, len(word)]), 2, 8)
    count = np.bincount(word, minlength=8).astype(float)
    m = L.LogBilinear(8).start(count)
    before = m.logprob(ctx, word).mean()
    for _ in range(4):
        m.nce(ctx, word, count, rng)
    assert m.logprob(ctx, word).mean() > before + 0.6
    z = [np.exp(m.logprob(np.tile(ctx[5], (8, 1)), np.arange(8, dtype=np.int32))).sum()]
    np.testing.assert_allclose(z, 1, rtol=1e-4)


def test_every_position_is_trained_on(spark):
    df = spark.createDataFrame([(k, f"a{k} b{k}", "z") for k in range(200)], DOCS)
    vocab, model = L.train(df)
    first = vocab.ids(np.array([word_hash(f"a{k}") for k in range(200)], U))
    moved = np.abs(model.r - L.LogBilinear(vocab.size).start(vocab.count).r).max(1)
    # a context is moved only by the position after it, the start symbol's by the first ones
    assert (moved[first] > 1e-6).all() and moved[vocab.size] > 1e-6


def test_words_of_a_class_share_its_probability(spark):
    # 768 words stand 30 times each; the tail's stand once to five times
    tail = [f"t{k}" for k in range(600) for _ in range(1 + k % 5)]
    rows = [(k, " ".join(f"w{(7 * k + j) % L.TOP}" for j in range(L.TOP)) + " " + " ".join(tail[k::30]), "z") for k in range(30)]
    vocab, model = L.train(spark.createDataFrame(rows, DOCS))
    words = [f"t{k}" for k in range(600)] + ["neverseen"]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(words)] + [(None, "t4 t4 neverseen w3", "z"), (0, "t0", "z"), (999, None, "z")], DOCS)
    got = L.score(df, vocab, model)
    one = {r.doc_id: r.logprob for r in got.collect() if r.doc_id is not None}
    h = np.array([word_hash(t) for t in words], U)
    ids, start = vocab.ids(h), np.full((len(words), model.context), vocab.size, np.int32)
    assert (ids >= L.TOP).all()
    whole = model.logprob(start, ids)
    for k in range(len(words)):
        n = 1 + k % 5 if k < 600 else 1
        assert abs(one[k] - whole[k] - np.log(n / (vocab.count[ids[k]] + 1))) < 1e-6
    # a class's words and one unknown word have the class's whole probability
    own = np.flatnonzero(ids[:600] == ids[0])
    assert abs(sum(np.exp(one[k]) for k in own) + np.exp(whole[0]) / (vocab.count[ids[0]] + 1) - np.exp(whole[0])) < 1e-9
    # beyond the limit the counts are joined, with the same result
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    shuffled = sorted(L.score(df, vocab, model, limit=0).collect(), key=key)
    assert len(shuffled) == len(words) + 3
    for a, b in zip(sorted(got.collect(), key=key), shuffled):
        assert a[:2] == b[:2] and all(x == y or abs(x - y) < 1e-9 * max(1, abs(x)) for x, y in zip(a[2:], b[2:]))


def test_contexts_are_not_normalised_one_by_one_and_far_scores_stay_right(monkeypatch):
    done = []
    own = L.LogBilinear.normaliser
    monkeypatch.setattr(L.LogBilinear, "normaliser", lambda self, h: done.append(len(h)) or own(self, h))
    rng = np.random.default_rng(3)
    m = L.LogBilinear(L.TOP + L.TAIL).start(rng.integers(1, 10**6, L.TOP + L.TAIL))
    m.theta += rng.normal(0, 0.3, len(m.theta)).astype(np.float32)
    ctx, word = rng.integers(0, m.size + 1, (50000, 2), np.int32), rng.integers(0, m.size, 50000, np.int32)
    ctx[0], ctx[1, 1] = m.size, m.size

    def plain(n):
        s = (m.r.astype(np.float64)[ctx[:n]] * m.c.astype(np.float64)).sum(1) @ m.q.T.astype(np.float64) + m.b
        top = s.max(1)
        return s[np.arange(n), word[:n]] - top - np.log(np.exp(s - top[:, None]).sum(1))

    np.testing.assert_allclose(m.logprob(ctx, word)[:2000], plain(2000), atol=2e-5)
    # every distinct context of every batch went through here before
    assert not done
    # exponentials of parts so far apart have products of 0
    m.r *= 30
    m.q *= 30
    got = m.logprob(ctx[:2000], word[:2000])
    assert done and m.tables() is None and np.isfinite(got).all()
    np.testing.assert_allclose(got, plain(2000), rtol=1e-4, atol=1e-2)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert L.score(df, *L.train(df)).count() == 0
