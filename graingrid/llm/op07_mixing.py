"""Mixing documents to target weights with soft domain membership.

The labelled table (doc_id, quality, toxic) trains two logistic models in
numpy, on hashed distinct words and a few shape measures of whole texts, from
at most about ``sample_docs`` labelled documents (the sample's only bound,
drawn by the hash of doc_id). They give each document's posteriors of the
domains ``toxic``, ``high`` (quality 1, not toxic) and ``low``.

Rates r >= 0, one a document, are then fitted so that the expected tokens of
each domain, sum of r * tokens * posterior, match the targets: least squares
by projected gradient from r = 1, in coordinates of the domains whitened by
their second moments (which sets the step to 1). The gradient of a document
depends on it only through its posteriors, so an iteration is one distributed
sum of three numbers; the rate of a document follows from its posteriors and
the list of the domain multipliers so far, and nothing a document has is ever
gathered. Posteriors are checkpointed once for the iterations; the last pass
computes them again beside the text, so that no text is shuffled.

Defined results: tokens are words; null or empty texts have none, and get a
rate like others; a domain without mass can't meet its target and the others
do; without labels all posteriors are the even priors; ``copies`` is the rate
rounded up or down at random by the hash of doc_id, so that its mean is the
rate; rows with equal or null ids are rated each by itself, alike if their
texts are alike; of labels that repeat a doc_id the largest count;
of documents that repeat a labelled doc_id the smallest text trains; columns
of the input named like results (n_tokens, p_high, p_low, p_toxic, rate,
copies, in any case) are replaced, others carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed, unused
from .textcore import U, Words, blocks, flat

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
SAMPLE_DOCS, WIDTH_BITS, STEPS, TOLERANCE = 4000, 16, 60, 1e-4
_RESULT = ("n_tokens", "p_high", "p_low", "p_toxic", "rate", "copies")

_UPPER, _PUNCT, _SPACE, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _SPACE[[9, 10, 11, 12, 13, 32]] = _DIGIT[48:58] = True
for _r in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _PUNCT[slice(*_r)] = True
_PIPE = np.zeros(256, bool)
_PIPE[124] = True
SHAPES = 12


def features(data: np.ndarray, off: np.ndarray):
    """Of each text: distinct hashed words (places and where each text's begin), shape measures, word count."""
    w = Words(data, off)
    rows = len(off) - 1
    key = np.unique((w.row.astype(np.uint64) << U(WIDTH_BITS)) | (w.hash >> U(64 - WIDTH_BITS))).astype(np.int64)
    ptr = np.searchsorted(key, np.arange(rows + 1) << WIDTH_BITS)
    words, size = np.diff(w.ptr), np.maximum(np.diff(off), 1)

    def share(of: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(of[data])])
        return (c[off[1:]] - c[off[:-1]]) / size

    up, punct = share(_UPPER), share(_PUNCT)
    distinct = np.diff(ptr) / np.maximum(words, 1)
    steps = [up > 0.25, punct > 0.1, share(_PIPE) > 0.02, distinct < 0.3, distinct < 0.6]
    shape = np.stack([np.ones(rows), np.minimum(up * 4, 2), np.minimum(punct * 8, 4), share(_DIGIT) * 8, share(_SPACE) * 4, np.log1p(words) / 8, distinct * np.log1p(words) / 4, *(s.astype(float) for s in steps)], 1)
    return key & ((1 << WIDTH_BITS) - 1), ptr, shape, words


class Logistic:
    """Binary logistic regression on hashed words and shape measures."""

    def __init__(self) -> None:
        self.word, self.shape = np.zeros(1 << WIDTH_BITS, np.float64), np.zeros(SHAPES)

    def margin(self, key: np.ndarray, ptr: np.ndarray, shape: np.ndarray) -> np.ndarray:
        # sums of each row by itself: equal texts get equal margins wherever they stand
        rows = len(ptr) - 1
        return np.bincount(np.repeat(np.arange(rows), np.diff(ptr)), self.word[key], rows) + (shape * self.shape).sum(1)

    def fit(self, key, ptr, shape, y, steps: int = 300, rate: float = 0.1, l2: float = 1e-4, min_docs: int = 5, telling: float = 4.0) -> Logistic:
        """Adam on the whole sample; words in few documents, or that don't tell the classes apart by ``telling`` standard errors, could only be learnt by heart and are left out; the others are held down by ``l2``."""
        rows, per = len(y), np.repeat(np.arange(len(y)), np.diff(ptr))
        if not rows or y.min() == y.max():
            self.shape[0] = np.log((y.sum() + 1) / (rows - y.sum() + 1)) if rows else 0.0
            return self
        used, place, seen = np.unique(key, return_inverse=True, return_counts=True)
        # how far, in standard errors, the share of a word's documents that are positive is from that of all
        share, base = np.bincount(place, y[per], len(used)) / np.maximum(seen, 1), y.mean()
        often = (seen >= min_docs) & (np.abs(share - base) >= telling * np.sqrt(base * (1 - base) / np.maximum(seen, 1)))
        keep = often[place]
        used, place, per = used[often], (np.cumsum(often) - 1)[place[keep]], per[keep]
        ptr = np.searchsorted(per, np.arange(rows + 1))
        theta = np.zeros(len(used) + SHAPES)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pace = np.full(len(theta), rate)
        pace[: len(used)] *= 0.3
        for t in range(1, steps + 1):
            sums = np.concatenate([[0.0], np.cumsum(theta[place])])
            z = sums[ptr[1:]] - sums[ptr[:-1]] + shape @ theta[len(used) :]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / rows
            g = np.concatenate([np.bincount(place, err[per], len(used)), shape.T @ err])
            g[: len(used)] += l2 * theta[: len(used)]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.word[used], self.shape = theta[: len(used)], theta[len(used) :]
        return self


class Domains:
    """The two models and the domain posteriors they give."""

    def __init__(self, texts: list[str], quality: np.ndarray, toxic: np.ndarray):
        f = features(*flat(pa.array(texts, pa.large_string())))[:3]
        self.quality, self.toxic = Logistic().fit(*f, quality), Logistic().fit(*f, toxic)
        self.even = not len(texts)

    def posteriors(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts x domains, in the order of DOMAINS, and word counts."""
        key, ptr, shape, words = features(data, off)
        if self.even:
            return np.full((len(words), 3), 1 / 3), words
        q, t = (1 / (1 + np.exp(-np.clip(m.margin(key, ptr, shape), -30, 30))) for m in (self.quality, self.toxic))
        return np.stack([(1 - t) * q, (1 - t) * (1 - q), t], 1), words


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Domains:
    """The domain classifier from about ``sample_docs`` labelled documents at most."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("__id"), "quality", "toxic")
    n = known.count()
    rate = int(min(1.0, sample_docs / max(1, n)) * (1 << 30))
    known = known.where(F.pmod(F.xxhash64("__id", F.lit("mix")), F.lit(1 << 30)) < rate).groupBy("__id").agg(F.max("quality").alias("__q"), F.max("toxic").alias("__t"))
    # the sampled labels are bounded by sample_docs, and can be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(known), "__id").groupBy("__id").agg(F.min("__text"), F.first("__q"), F.first("__t")).collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return Domains([r[1] or "" for r in rows], np.array([float(r[2] > 0) for r in rows]), np.array([float(r[3] > 0) for r in rows]))


def _rates(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for v in moves:
        r = np.maximum(0.0, r - (p[:, 0] * v[0] + p[:, 1] * v[1] + p[:, 2] * v[2]))
    return r


def posteriors(docs: DataFrame, model: Domains, text_col: str = "text") -> DataFrame:
    """n_tokens, p_high, p_low, p_toxic of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in blocks(*flat(batch.column(0))):
                p, n = sent.value.posteriors(data, off)
                yield pa.RecordBatch.from_arrays([pa.array(n), *(pa.array(p[:, k].copy()) for k in range(3))], ["n_tokens", "p_high", "p_low", "p_toxic"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long, p_high double, p_low double, p_toxic double")


def _totals(moves: list[np.ndarray]):
    """Per partition: expected tokens by domain at the rates so far, and the weighted second moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, g, n = np.zeros(3), np.zeros((3, 3)), 0.0
        for b in batches:
            t = b.column(0).to_numpy().astype(np.float64)
            p = np.stack([b.column(k).to_numpy() for k in (1, 2, 3)], 1)
            s += (_rates(p, moves) * t) @ p
            g += (p * t[:, None]).T @ p
            n += t.sum()
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (*s, *g.ravel(), n)], [f"x{k}" for k in range(13)])

    return run


def fit_rates(weighted: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The domain multipliers of each step, from a (checkpointed) frame of tokens and posteriors."""
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in DOMAINS])
    want = want / want.sum() if want.sum() else np.full(3, 1 / 3)
    moves: list[np.ndarray] = []
    white = None
    for _ in range(steps):
        out = weighted.mapInArrow(_totals(moves), ", ".join(f"x{k} double" for k in range(13))).agg(*(F.sum(f"x{k}").alias(f"x{k}") for k in range(13))).first()
        x = np.array([v or 0.0 for v in out])
        if x[12] <= 0:
            break
        if white is None:
            white = np.linalg.pinv(x[3:12].reshape(3, 3) / x[12], rcond=1e-6, hermitian=True)
        gap = x[:3] / x[12] - want
        if np.abs(gap).max() < tolerance:
            break
        moves.append(white @ gap)
    return moves


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """All rows and columns of ``docs``, and n_tokens, p_high, p_low, p_toxic, rate and copies."""
    model = train(docs, labels, id_col, text_col, sample_docs)
    moves = fit_rates(checkpointed(posteriors(docs, model, text_col)), targets)
    sent = docs.sparkSession.sparkContext.broadcast((model, moves))
    docs = docs.select([c for c in docs.columns if c.lower() not in _RESULT])
    spin = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ready = docs.withColumn(unused(docs, "spin"), spin)
    place = ready.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, v = sent.value
        for batch in batches:
            for i, j, data, off in blocks(*flat(batch.column(place))):
                part = batch.slice(i, j - i)
                p, n = m.posteriors(data, off)
                r = _rates(p, v)
                copies = np.floor(r) + (part.column(part.num_columns - 1).to_numpy() < r - np.floor(r))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n), *(pa.array(p[:, k].copy()) for k in range(3)), pa.array(r), pa.array(copies.astype(np.int64))], [*part.schema.names[:-1], *_RESULT])

    ddl = docs.schema
    for c in _RESULT:
        ddl = ddl.add(c, "long" if c in ("n_tokens", "copies") else "double")
    return ready.mapInArrow(run, ddl)
