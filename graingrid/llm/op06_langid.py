"""Language identification by prediction with partial matching (PPM).

Each language has a context tree over folded UTF-8 bytes up to ``ORDER`` bytes
deep. In a context seen t times with q different next bytes, a byte seen c
times has probability c / (t + q), and the escape to the next shorter context
q / (t + q) (method C, without exclusions); contexts never seen cost nothing
to leave; below the empty context all 256 bytes are equal. The statistics are
frozen after training, so the code length of a byte is a function of it and
the ORDER bytes before it. Each language's exact code length of every trained
(ORDER+1)-gram is therefore put in one table, and only grams that no language
has seen are coded by walking down the orders. A text's code length in a
language is the sum over all its bytes; the shortest one names the language.

A text is rejected (``accepted`` false) if it has no word, or if even its best
language needs more than ``reject_bits`` bits a byte, far above what prose of
a known language takes, for the text as a whole and also for more than half of
its words each. The words decide because one long key or number can cost more
than the short, proper sentence around it.

Training draws whole documents of each label by the hash of doc_id, at a rate
that is expected to give ``sample_docs`` documents a language; this bound is
the sample's only limit, and everything else covers all documents.

Defined results: null or empty text has 0 bits, no language and isn't
accepted; ties go to the language that sorts first; null labels don't train;
an empty table gives an empty result; rows with equal ids are judged each by
itself; ``identify`` ignores other columns, ``keep_known`` carries them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import U, HashIndex, Words, blocks, flat, fold, _WORD

ORDER, SAMPLE_DOCS, REJECT_BITS = 4, 250, 5.5
SCHEMA = "doc_id long, language string, bits_per_byte double, margin_bits double, accepted boolean"


def _grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For every byte the (order + 1)-gram that ends there, its text preceded by newlines."""
    g = data.astype(np.uint64)
    ends = np.repeat(off[:-1], np.diff(off))
    since = np.arange(len(data)) - ends
    for k in range(1, order + 1):
        b = np.full(len(data), 10, np.uint64)
        b[k:] = data[:-k] if k < len(data) else data[:0]
        b[since < k] = 10
        g |= b << U(8 * k)
    return g


class PPM:
    """Frozen models of several languages, with their tables of code lengths in bits."""

    def __init__(self, texts: dict[str, Iterable[str]], order: int = ORDER):
        self.order, self.languages = order, sorted(texts)
        n = len(self.languages)
        seen = []
        for lang in self.languages:
            raw = [t.encode("utf-8", "replace") for t in texts[lang] if t]
            off = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
            seen.append(np.unique(_grams(fold(np.frombuffer(b"".join(raw), np.uint8)), off, order), return_counts=True))
        #: By number of context bytes: the grams, their index, each language's cost of the gram and of leaving the context.
        self.index, self.cost, self.ctx, self.leave = [], [], [], []
        below = np.full((256, n), 8.0)
        below_keys = np.arange(256, dtype=np.uint64)
        for k in range(order + 1):
            per = []
            for g, c in seen:
                key, at = np.unique(g & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
                per.append((key, np.bincount(at, c, len(key))))
            keys = np.unique(np.concatenate([p[0] for p in per])) if n else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> U(8))
            leave = np.zeros((len(contexts), n))
            cost = np.zeros((len(keys), n))
            # what the gram costs one order lower: every shorter gram of a seen gram is seen too, or is a plain byte
            short = keys & U((1 << 8 * k) - 1) if k else keys
            lower = below[np.searchsorted(below_keys, short)] if len(keys) else cost
            for j, (key, count) in enumerate(per):
                at = np.searchsorted(contexts, key >> U(8))
                total, kinds = np.bincount(at, count, len(contexts)), np.bincount(at, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    leave[:, j] = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                    hit = -np.log2(count / (total + kinds)[at])
                here = np.searchsorted(contexts, keys >> U(8))
                cost[:, j] = leave[here, j] + lower[:, j]
                cost[np.searchsorted(keys, key), j] = hit
            self.index.append(HashIndex(keys))
            self.cost.append(np.vstack([cost, np.zeros(n)]).astype(np.float32))
            self.ctx.append(HashIndex(contexts))
            self.leave.append(leave)
            below, below_keys = cost, keys

    def _coded(self, g: np.ndarray) -> np.ndarray:
        """Code lengths of grams that the full order hasn't seen."""
        out, todo = np.zeros((len(g), len(self.languages)), np.float64), np.arange(len(g))
        for k in range(self.order, -1, -1):
            at = self.ctx[k].find((g[todo] & U((1 << 8 * (k + 1)) - 1)) >> U(8))
            out[todo] += np.where(at[:, None] < 0, 0.0, self.leave[k][at])
            if not k:
                out[todo] += 8.0
                break
            at = self.index[k - 1].find(g[todo] & U((1 << 8 * k) - 1))
            known = at >= 0
            out[todo[known]] += self.cost[k - 1][at[known]]
            todo = todo[~known]
            if not len(todo):
                break
        return out

    def costs(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language, bytes x languages."""
        g = _grams(fold(data), off, self.order)
        at = self.index[-1].find(g)
        cost = self.cost[-1][at]
        new = np.flatnonzero(at < 0)
        if len(new):
            kinds, back = np.unique(g[new], return_inverse=True)
            cost[new] = self._coded(kinds)[back]
        return cost

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, texts x languages."""
        out = np.zeros((len(off) - 1, len(self.languages)))
        if not len(data) or not self.languages:
            return out
        cost = self.costs(data, off)
        full = np.flatnonzero(np.diff(off))
        out[full] = np.add.reduceat(cost, off[full], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> PPM:
    """Models of all labels in ``label_col``, each from about ``sample_docs`` whole documents."""
    label = F.nullif(F.trim(F.col(label_col).cast("string")), F.lit(""))
    counts = {r["l"]: r["n"] for r in docs.groupBy(label.alias("l")).agg(F.count(F.col(id_col)).alias("n")).where("l is not null").collect()}
    if not counts:
        return PPM({}, order)
    spin = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("ppm")), F.lit(1 << 30))
    take = [(label == lang) & (spin < int(min(1.0, sample_docs / max(1, n)) * (1 << 30))) for lang, n in counts.items()]
    any_of = take[0]
    for t in take[1:]:
        any_of = any_of | t
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in docs.where(any_of).select(label.alias("l"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if r["t"]:
            texts[r["l"]].append(r["t"])
    return PPM({lang: t for lang, t in texts.items() if t}, order)


def judge(model: PPM, data: np.ndarray, off: np.ndarray, reject_bits: float):
    """Language (or None), bits a byte, margin to the next language and acceptance of each text."""
    size = np.diff(off)
    words = np.add.reduceat(np.append(_WORD[fold(data)], False), np.minimum(off[:-1], len(data)), dtype=np.int64) * (size > 0)
    bits = model.bits(data, off)
    if not model.languages:
        none = np.zeros(len(size))
        return [None] * len(size), none, none, np.zeros(len(size), bool)
    order = np.sort(bits, axis=1)
    rate = order[:, 0] / np.maximum(size, 1)
    margin = order[:, 1] - order[:, 0] if len(model.languages) > 1 else np.zeros(len(size))
    known = (size > 0) & (words > 0)
    best = bits.argmin(1)
    ok = known & (rate <= reject_bits)
    for k in np.flatnonzero(known & ~ok):
        part = data[off[k] : off[k + 1]]
        ends = np.array([0, len(part)])
        w, cost = Words(part, ends), model.costs(part, ends)[:, best[k]]
        each = np.add.reduceat(np.append(cost, 0), np.stack([w.start, w.end], 1).ravel(), dtype=np.float64)[::2] / (w.end - w.start)
        ok[k] = 2 * np.count_nonzero(each <= reject_bits) >= len(each)
    return [model.languages[b] if k else None for b, k in zip(best, known)], rate, margin, ok


def _identify(model, reject_bits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i, j, data, off in blocks(*flat(batch.column(1))):
                lang, rate, margin, ok = judge(m, data, off, reject_bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(rate), pa.array(margin), pa.array(ok)], ["doc_id", "language", "bits_per_byte", "margin_bits", "accepted"])

    return run


def identify(docs: DataFrame, model: PPM, id_col: str = "doc_id", text_col: str = "text", reject_bits: float = REJECT_BITS) -> DataFrame:
    """doc_id, language, bits_per_byte of it, margin_bits to the next one, and accepted, a row for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_identify(sent, reject_bits), SCHEMA)


def keep_known(docs: DataFrame, model: PPM, text_col: str = "text", reject_bits: float = REJECT_BITS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is in a known language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for i, j, data, off in blocks(*flat(batch.column(place))):
                yield batch.slice(i, j - i).filter(pa.array(judge(m, data, off, reject_bits)[3]))

    return docs.mapInArrow(run, docs.schema)
