"""Language-model scoring by a log-bilinear model.

A word's representation is predicted from the CONTEXT words before it as the
sum of their representations, each scaled by its place's own vector; the
prediction's product with every word's target vector, plus the word's bias,
are the scores. Scoring is normalised over the whole vocabulary: a score is a
sum of one part for each context word, so the sums of exponentials of all
contexts are one product of two matrices, made once by the driver, and a token
takes its parts and its normaliser from tables. Models that this doesn't suit
normalise each context of a batch once, by the log-sum-exp of its scores.

The vocabulary is all words of all documents, counted. The ``TOP`` most
frequent ones and ``TAIL`` hash classes of all others are what the model
scores; a word of a class has the class's probability times its own count over
the class's count plus one. The one is the share of a word that wasn't counted,
so the probabilities of a class's words and of one unknown word sum to the
class's. Words that stand once have the same share without being looked up;
the counts of the others are broadcast below ``BROADCAST_BYTES``, and joined to
the documents' words by a shuffle beyond. Training is noise-contrastive
estimation in numpy, noise from the words' counts over all documents to the
power 3/4. It is distributed: in each of ``ROUNDS`` rounds every partition
takes one position in ``ROUNDS`` of each of its documents (another one each
round), trains from the round's common parameters, and the parameters are
averaged with the tokens as weights, summed over shuffled shards first. So
every position of every document is trained on once. Biases begin at the
words' log frequencies, so an untrained model is the unigram one.

Defined results: tokens are folded words; text without words (null, empty)
has n_tokens 0, logprob 0 and null mean and perplexity; words before a text's
first are a start symbol; rows with equal or null ids are scored each by
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import BROADCAST_BYTES, checkpointed, small
from .textcore import U, HashIndex, Words, as_longs, blocks, flat, mix

TOP, TAIL, DIM, CONTEXT = 768, 256, 32, 2
ROUNDS, BATCH, NOISE, RATE = 3, 128, 32, 0.15
SCHEMA = "doc_id long, n_tokens long, logprob double, mean_logprob double, perplexity double"
#: Where the counts are joined: a row for each text, with n 0, and for each word of a class in it
_PAIRS = "row long, h long, n long, doc_id long, n_tokens long, logprob double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in blocks(*flat(batch.column(0)), size=4 << 20):
            h, n = np.unique(Words(data, off).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_longs(h)), pa.array(n.astype(np.int64))], ["h", "n"])


class Vocabulary:
    """Ids of words: a place among the most frequent, or after those a tail class; and every id's count.

    ``words`` has the count of every word that stands more than once; it stays on the driver.
    """

    def __init__(self, top: list[tuple[int, int]], tail: dict[int, int], classes: int, words: DataFrame | None = None):
        self.words = words
        self.top, self.classes = len(top), classes
        self.index = HashIndex(np.array([h for h, _ in top], np.int64).view(np.uint64) if top else np.zeros(0, np.uint64))
        self.size = self.top + classes
        self.count = np.array([n for _, n in top] + [max(0, tail.get(k, 0)) for k in range(classes)], np.float64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = self.index.find(h)
        return np.where(at >= 0, at, self.top + (h & U(self.classes - 1)).astype(np.int64)).astype(np.int32)


def vocabulary(docs: DataFrame, text_col: str = "text", top: int = TOP, classes: int = TAIL) -> Vocabulary:
    """From the counts of all words of all documents; ``classes`` is a power of two."""
    counts = checkpointed(docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    best = [(r["h"], r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(top).collect()]
    tail = {r["k"]: r["n"] for r in counts.groupBy(F.expr(f"int(h & {classes - 1})").alias("k")).agg(F.sum("n").alias("n")).collect()}
    for h, n in best:
        tail[h & (classes - 1)] -= n
    return Vocabulary(best, tail, classes, counts.where("n > 1"))


class LogBilinear:
    """The model; ``theta`` holds all parameters in one vector of float32."""

    def __init__(self, size: int, dim: int = DIM, context: int = CONTEXT, theta: np.ndarray | None = None):
        self.size, self.dim, self.context = size, dim, context
        shapes = [(size + 1, dim), (context, dim), (size, dim + 1)]
        self.theta = np.zeros(sum(int(np.prod(s)) for s in shapes), np.float32) if theta is None else theta.astype(np.float32).copy()
        cuts = np.cumsum([0] + [int(np.prod(s)) for s in shapes])
        #: context vectors (the last one the start symbol's), place scales, target vectors with biases as their last column
        self.r, self.c, self.t = (self.theta[a:z].reshape(s) for a, z, s in zip(cuts, cuts[1:], shapes))
        self.q, self.b = self.t[:, :dim], self.t[:, dim]

    def start(self, count: np.ndarray, seed: int = 7) -> LogBilinear:
        g = np.random.default_rng(seed)
        self.r[:] = g.normal(0, 0.1, self.r.shape)
        self.q[:] = g.normal(0, 0.1, self.q.shape)
        self.c[:] = 1.0
        self.b[:] = np.log((count + 0.5) / (count + 0.5).sum())
        return self

    def predict(self, ctx: np.ndarray) -> np.ndarray:
        """The contexts' predictions, and a 1 that takes the bias."""
        out = np.ones((len(ctx), self.dim + 1), np.float32)
        h = out[:, :-1]
        np.multiply(self.r[ctx[:, 0]], self.c[0], out=h)
        for k in range(1, self.context):
            h += self.r[ctx[:, k]] * self.c[k]
        return out

    def normaliser(self, h: np.ndarray) -> np.ndarray:
        """Log-sum-exp over the vocabulary for rows of predictions."""
        out = np.empty(len(h), np.float32)
        # no score is greater; where none can overflow, they needn't be lowered first
        most = np.sqrt((h * h).sum(1)) * np.sqrt((self.t * self.t).sum(1).max()) if len(h) else out
        for a in range(0, len(h), 512):
            s = h[a : a + 512] @ self.t.T
            if most[a : a + 512].max() < 60:
                out[a : a + 512] = np.log(np.exp(s, out=s).sum(1))
            else:
                top = s.max(1)
                s -= top[:, None]
                out[a : a + 512] = top + np.log(np.exp(s, out=s).sum(1))
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Of contexts of two words, each one's part in every word's score (the bias in the nearest's) and all contexts' normalisers.

        A score is the sum of two parts, so the normalisers' sums over the vocabulary are one product of matrices, of the
        parts' exponentials. None where a sum of these could vanish, or tables would be large.
        """
        if self.context != 2 or self.size > 4096:
            return None
        near, far = ((self.r * self.c[k]).astype(np.float64) @ self.q.T.astype(np.float64) for k in range(2))
        near += self.b
        top = [x.max(1, keepdims=True) for x in (near, far)]
        # beyond that the greatest product of two exponentials could be 0
        if not sum((t - x.min(1, keepdims=True)).max() for t, x in zip(top, (near, far))) < 600:
            return None
        z = np.exp(near - top[0]) @ np.exp(far - top[1]).T
        np.log(z, out=z)
        z += top[0]
        z += top[1].T
        return near.astype(np.float32), far.astype(np.float32), z.astype(np.float32)

    def logprob(self, ctx: np.ndarray, word: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Normalised log-probability of each word after its context; ``tables`` are this model's, if they are at hand."""
        out = np.empty(len(word), np.float64)
        if tables := tables or self.tables():
            near, far, z = (t.ravel() for t in tables)
            for a in range(0, len(word), 1 << 14):
                w, c = word[a : a + (1 << 14)].astype(np.int64), ctx[a : a + (1 << 14)].astype(np.int64)
                s = near.take(c[:, 0] * self.size + w)
                s += far.take(c[:, 1] * self.size + w)
                np.subtract(s, z.take(c[:, 0] * (self.size + 1) + c[:, 1]), out=out[a : a + (1 << 14)])
            return out
        key = ctx[:, 0].astype(np.int64)
        for k in range(1, self.context):
            key = key * (self.size + 1) + ctx[:, k]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        h = self.predict(ctx[first])
        z = self.normaliser(h)
        for a in range(0, len(word), 1 << 14):
            w, k = word[a : a + (1 << 14)], back[a : a + (1 << 14)]
            out[a : a + (1 << 14)] = np.einsum("nd,nd->n", h[k], self.t[w]) - z[k]
        return out

    def nce(self, ctx: np.ndarray, word: np.ndarray, count: np.ndarray, rng: np.random.Generator, rate: float = RATE, batch: int = BATCH, noise: int = NOISE) -> None:
        """One pass of noise-contrastive estimation, by Adagrad; a batch shares its noise words."""
        p = (count + 0.5) ** 0.75
        p /= p.sum()
        log_kp = np.log(noise * p).astype(np.float32)
        seen = LogBilinear(self.size, self.dim, self.context)
        seen.theta += 1.0
        order = rng.permutation(len(word))
        ctx, word = ctx[order], word[order]
        drawn = np.minimum(np.searchsorted(np.cumsum(p), rng.random((-(-len(word) // batch), noise))), self.size - 1).astype(word.dtype)
        log_word = log_kp[word]
        dim = self.dim
        for n, a in enumerate(range(0, len(word), batch)):
            c, w, x = ctx[a : a + batch], word[a : a + batch], drawn[n]
            rows = [self.r.take(c[:, k], axis=0) for k in range(self.context)]
            h = np.ones((len(c), dim + 1), np.float32)
            np.multiply(rows[0], self.c[0], out=h[:, :dim])
            for k in range(1, self.context):
                h[:, :dim] += rows[k] * self.c[k]
            tw, tx = self.t.take(w, axis=0), self.t.take(x, axis=0)
            s = np.einsum("nd,nd->n", h, tw) - log_word[a : a + batch]
            t = h @ tx.T - log_kp[x]
            # data tokens pull their words up by 1 - P(data), noise pushes words down by P(data)
            root = np.float32(len(c) ** 0.5)
            up = np.exp(s, out=s)
            up += 1
            up *= root
            up = np.reciprocal(up, out=up)[:, None]
            down = np.exp(np.negative(t, out=t), out=t)
            down += 1
            down *= -root
            np.reciprocal(down, out=down)
            gh = down @ tx
            gh += up * tw
            gh = np.ascontiguousarray(gh[:, :dim])
            g = np.empty((len(c) + noise, dim + 1), np.float32)
            np.multiply(up, h, out=g[: len(c)])
            np.matmul(down.T, h, out=g[len(c) :])
            self._step(self.t, seen.t, np.concatenate([w, x]), g, rate)
            g = np.empty((self.context, len(c), dim), np.float32)
            gc = np.empty_like(self.c)
            for k in range(self.context):
                np.multiply(gh, self.c[k], out=g[k])
                np.einsum("nd,nd->d", gh, rows[k], out=gc[k])
            self._step(self.r, seen.r, c.T.ravel(), g.reshape(-1, dim), rate)
            seen.c += gc * gc
            self.c += 0.1 * rate * gc / np.sqrt(seen.c)

    @staticmethod
    def _step(par: np.ndarray, acc: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float) -> None:
        """Adagrad on the rows ``at``, gradients of equal rows summed."""
        by = at.argsort(kind="stable")
        at = at.take(by)
        ends = np.ones(len(at), bool)
        np.not_equal(at[1:], at[:-1], out=ends[:-1])
        last = ends.nonzero()[0]
        # running sums, and what each row adds to them
        run = g.take(by, axis=0).cumsum(axis=0)
        rows, total = at.take(last), run.take(last, axis=0)
        total[1:] -= run.take(last[:-1], axis=0)
        new = acc.take(rows, axis=0)
        new += total * total
        acc[rows] = new
        total *= rate
        total /= np.sqrt(new)
        total += par.take(rows, axis=0)
        par[rows] = total


def contexts(ids: np.ndarray, ptr: np.ndarray, context: int, start: int) -> np.ndarray:
    """The ids before each token, nearest first."""
    since = np.arange(len(ids)) - np.repeat(ptr[:-1], np.diff(ptr))
    out = np.full((len(ids), context), start, np.int32)
    for k in range(1, context + 1):
        out[k:, k - 1] = ids[:-k] if k < len(ids) else ids[:0]
        out[since < k, k - 1] = start
    return out


def _train(sent, turn: int, rounds: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, theta = sent.value
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([turn, part])
        model = LogBilinear(vocab.size, theta=theta)
        n, held, size = 0, [], 0

        def learn() -> None:
            model.nce(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), vocab.count, rng)

        for batch in batches:
            for _, _, data, off in blocks(*flat(batch.column(0))):
                w = Words(data, off)
                ids = vocab.ids(w.hash)
                ctx = contexts(ids, w.ptr, model.context, vocab.size)
                place = np.arange(len(ids)) - np.repeat(w.ptr[:-1], np.diff(w.ptr))
                # the text's own first word says where its positions begin, so short texts take part as long ones do
                own = np.repeat((w.hash[np.minimum(w.ptr[:-1], len(ids) - 1)] >> U(20)).astype(np.int64) if len(ids) else w.ptr[:-1], np.diff(w.ptr))
                at = np.flatnonzero((place + own + turn) % rounds == 0)
                held.append((ctx[at], ids[at]))
                n, size = n + len(at), size + len(at)
            if size > 1 << 17:
                learn()
                held, size = [], 0
        if size:
            learn()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part % shards], pa.int32()), pa.array([float(n)]), pa.array([(model.theta.astype(np.float64) * n).tobytes()], pa.binary())], ["shard", "n", "theta"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0.0, None
    for batch in batches:
        for k, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x = np.frombuffer(raw, np.float64)
            n, total = n + k, x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["shard", "n", "theta"])


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, shards: int = 8) -> tuple[Vocabulary, LogBilinear]:
    """Vocabulary and model from all documents."""
    spark = docs.sparkSession
    vocab = vocabulary(docs, text_col)
    model = LogBilinear(vocab.size).start(vocab.count)
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    form = "shard int, n double, theta binary"
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((vocab, model.theta))
        n, total = 0.0, 0.0
        for r in texts.mapInArrow(_train(sent, turn, rounds, shards), form).repartition(shards, "shard").mapInArrow(_sum, form).toLocalIterator():
            n, total = n + r["n"], total + np.frombuffer(r["theta"], np.float64)
        if n:
            model = LogBilinear(vocab.size, theta=total / n)
        sent.unpersist()
    return vocab, model


def _score(sent, joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, theta, tables, words, counts = sent.value
        model = LogBilinear(vocab.size, theta=theta)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            held, size, done = [], 0, 0
            for i, j, data, off in blocks(*flat(batch.column(1))):
                w = Words(data, off)
                ids = vocab.ids(w.hash)
                tail = np.flatnonzero(ids >= vocab.top)
                h, share = as_longs(w.hash[tail]), np.zeros(len(ids))
                share[tail] = -np.log(vocab.count[ids[tail]] + 1)
                if len(words) and len(h):
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    share[tail] += np.log(np.where(words[at] == h, counts[at], 1))
                held.append((contexts(ids, w.ptr, model.context, vocab.size), ids, np.diff(w.ptr), share, h if joined else h[:0], w.row[tail] + i - done if joined else h[:0]))
                size += len(ids)
                if size > 1 << 20 or j == batch.num_rows:
                    ctx, ids, n, share, h, of = (np.concatenate(x) for x in zip(*held))
                    logp = model.logprob(ctx, ids, tables) + share if size else np.zeros(0)
                    total = np.zeros(len(n))
                    full = np.flatnonzero(n)
                    if len(full):
                        total[full] = np.add.reduceat(logp, (np.cumsum(n) - n)[full])
                    doc = batch.column(0).slice(done, j - done)
                    if joined:
                        rows = row + np.arange(len(n))
                        row += len(n)
                        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(as_longs(mix(rows))), pa.array(np.zeros(len(n), np.int64)), doc, pa.array(n), pa.array(total)], _names(_PAIRS))
                        order = np.lexsort((h, of))
                        h, of = h[order], of[order]
                        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else order
                        for a in range(0, len(new), 1 << 16):
                            k = new[a : a + (1 << 16)]
                            many = np.diff(np.append(new[a : a + (1 << 16) + 1], len(h)))[: len(k)]
                            yield pa.RecordBatch.from_arrays([pa.array(rows[of[k]]), pa.array(h[k]), pa.array(many), *(pa.nulls(len(k), t) for t in (pa.int64(), pa.int64(), pa.float64()))], _names(_PAIRS))
                    else:
                        mean = total / np.maximum(n, 1)
                        none = n == 0
                        yield pa.RecordBatch.from_arrays([doc, pa.array(n), pa.array(total), pa.array(mean, mask=none), pa.array(np.exp(-mean), mask=none)], _names(SCHEMA))
                    held, size, done = [], 0, j

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def score(docs: DataFrame, vocab: Vocabulary, model: LogBilinear, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_tokens, logprob (natural, summed), its mean and the perplexity, a row for each row."""
    joined = vocab.words is not None and not small(vocab.words, 16, limit)
    words = counts = np.zeros(0, np.int64)
    if vocab.words is not None and not joined:
        table = vocab.words.select("h", "n").toArrow()
        words, counts = table["h"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(words)
        words, counts = words[order], counts[order]
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model.theta, model.tables(), words, counts))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not joined:
        return texts.mapInArrow(_score(sent, False), SCHEMA)
    pairs = texts.mapInArrow(_score(sent, True), _PAIRS).join(vocab.words.select("h", F.col("n").alias("count")).hint("merge"), "h", "left")
    total = F.max("logprob") + F.sum(F.col("n") * F.log(F.coalesce("count", F.lit(1)).cast("double")))
    rows = pairs.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), total.alias("logprob"))
    mean = F.when(F.col("n_tokens") > 0, F.col("logprob") / F.col("n_tokens"))
    return rows.select("doc_id", "n_tokens", "logprob", mean.alias("mean_logprob"), F.exp(-mean).alias("perplexity"))
