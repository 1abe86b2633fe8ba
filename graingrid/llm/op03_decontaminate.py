"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the words at its ones are
hashed, those at its zeros ignored, so a seed still matches where a word at a
zero was replaced. Every word position of every benchmark item and of every
document is hashed under every mask, and equal hashes join an item position to
a document position, that is to a diagonal. On each diagonal the item's words
are compared to the document's over the whole item; the aligned stretch with
the highest score (1 for an equal word, -``penalty`` for a replaced one) is
the overlap. An item leaks into a document if its overlap has at least
``min_words`` equal words, or if the whole item is there with at most a fifth
of its words replaced (none below the seeds' span), wherever they stand: each
way to replace a fifth of an item of the span or longer leaves a place where
one of the masks fits.

The documents are scanned once for each benchmark block of ``block_words``
words, which bounds what is broadcast however large the benchmark is; the
words' hashes, a seed table and a bit filter before it make a block. The text
of documents is never shuffled.

Defined results: null or empty texts never match; items of fewer than
``least_words`` words are ignored, for any sentence may hold them; of several
overlaps of a document and an item the one with most equal words, then the
first, is reported; repeated documents or items are each reported by their own
id; rows without doc_id are scanned but carry a null id; an empty benchmark
leaks nowhere; other columns are ignored, or carried by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import U, Words, blocks, flat, mix, ranges

MASKS = ("1101100011", "1010011101", "1110010011", "1001101011", "101111", "1110011")
MIN_WORDS, LEAST_WORDS, PENALTY, BLOCK_WORDS = 12, 5, 2, 4_000_000
SCHEMA = "doc_id long, item_id long, matched int, aligned int, doc_word int, item_word int"
_FILTER_BITS, _SPAN, _PAIRS, _CELLS = 22, max(map(len, MASKS)), 1 << 20, 1 << 20
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def _seeds(h: np.ndarray, stop: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under the mask of all positions whose span ends by ``stop`` (each word's text's end), and the positions."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.full(n, U(int(mask, 2) + 2**33 * len(mask)))
    for k, c in enumerate(mask):
        if c == "1":
            s += h[k : k + n] * _PLACES[k % 64]
    ok = np.flatnonzero(np.arange(n) + len(mask) <= stop[:n])
    return s[ok] * U(0x9E3779B97F4A7C15), ok


class Block:
    """Some benchmark items, ready for scanning."""

    def __init__(self, ids: list[int], texts: list[str | None], least_words: int = LEAST_WORDS):
        data, off = flat(pa.array(texts, pa.large_string()))
        w = Words(data, off)
        self.ids, self.hash, self.ptr = np.array(ids, np.int64), w.hash, w.ptr
        size = np.diff(w.ptr)
        stop = np.repeat(w.ptr[1:], size)
        span = max(map(len, MASKS))
        own = np.repeat(size, size)
        self.masks = list(MASKS) + ["1" * int(n) for n in np.unique(size[(size >= least_words) & (size < span)])]
        keys, at = [], []
        for m in self.masks:
            s, pos = _seeds(w.hash, stop, m)
            good = own[pos] == len(m) if "0" not in m else own[pos] >= span
            keys.append(s[good])
            at.append(pos[good])
        key, at = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(key, kind="stable")
        self.key, self.at = key[order], at[order]
        self.item = np.repeat(np.arange(len(size)), size)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.key >> U(64 - _FILTER_BITS)).astype(np.int64)] = True


def overlaps(block: Block, w: Words, min_words: int, penalty: int) -> dict[str, np.ndarray]:
    """The best overlap of each leaking (row, item), as arrays."""
    size = np.diff(w.ptr)
    stop = np.repeat(w.ptr[1:], size)
    row = w.row
    found = [np.zeros(0, np.int64)]
    length = np.diff(block.ptr)
    longest = int(length.max()) if len(length) else 0
    span = len(w.hash) + longest + 1
    for m in block.masks:
        s, pos = _seeds(w.hash, stop, m)
        k = np.flatnonzero(block.filter[(s >> U(64 - _FILTER_BITS)).astype(np.int64)])
        s, pos = s[k], pos[k]
        lo, hi = np.searchsorted(block.key, s), np.searchsorted(block.key, s, "right")
        # seeds that stand often in both are paired some million at a time, of which each diagonal stays once
        for part in np.split(np.arange(len(s)), np.searchsorted(np.cumsum(hi - lo), np.arange(_PAIRS, int((hi - lo).sum()), _PAIRS))):
            who, e = ranges(lo[part], hi[part])
            at = block.at[e]
            item, p = block.item[at], pos[part][who]
            found.append(np.unique((row[p] * len(length) + item) * span + p - (at - block.ptr[item]) + longest))
    hits = np.unique(np.concatenate(found))
    hits, diagonal = np.divmod(hits, span)
    hits = np.stack([*np.divmod(hits, len(length)), diagonal - longest], 1)
    out = [np.zeros((0, 6), np.int64)]
    # short items first, so that the comparisons of a part have at most twice the width they need, and a few million cells
    hits = hits[np.argsort(length[hits[:, 1]], kind="stable")]
    width = length[hits[:, 1]]
    cells = np.cumsum(width)
    cuts = np.concatenate([np.searchsorted(cells, np.arange(_CELLS, cells[-1], _CELLS)), np.searchsorted(width, 1 << np.arange(3, 40))]) if len(hits) else cells
    for part in np.split(hits, np.unique(cuts)):
        r, item, diag = part.T
        n = length[item]
        if not len(part):
            continue
        k = np.arange(n.max())
        at, it = diag[:, None] + k, block.ptr[item][:, None] + k
        inside = (k < n[:, None]) & (at >= w.ptr[r][:, None]) & (at < w.ptr[r + 1][:, None])
        same = inside & (w.hash[np.clip(at, 0, len(w.hash) - 1)] == block.hash[np.clip(it, 0, len(block.hash) - 1)])
        score = np.cumsum(np.where(same, 1, np.where(inside, -penalty, -(1 << 20))), axis=1)
        before = np.hstack([np.zeros((len(part), 1), np.int64), score[:, :-1]])
        low = np.minimum.accumulate(before, axis=1)
        end = (score - low).argmax(1)
        lines = np.arange(len(part))
        # the stretch begins after the last place up to its end where the lowest sum was reached
        start = np.where((before == low[lines, end][:, None]) & (k <= end[:, None]), k, -1).max(1)
        total = np.hstack([np.zeros((len(part), 1), np.int64), np.cumsum(same, axis=1)])
        matched, all_same = total[lines, end + 1] - total[lines, start], total[:, -1]
        whole = np.where(n < _SPAN, all_same == n, 5 * all_same >= 4 * n) & inside[lines, 0] & inside[lines, n - 1] & (matched < min_words)
        ok = (matched >= min_words) | whole
        matched = np.where(whole, all_same, matched)
        start, aligned = np.where(whole, 0, start), np.where(whole, n, end + 1 - start)
        out.append(np.stack([r, item, matched, aligned, diag + start - w.ptr[r], start], 1)[ok])
    best = np.concatenate(out)
    best = best[np.lexsort((best[:, 4], -best[:, 2], best[:, 1], best[:, 0]))]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:, :2] != best[:-1, :2]).any(1)
    best = best[new]
    return {"row": best[:, 0], "item": block.ids[best[:, 1]], "matched": best[:, 2], "aligned": best[:, 3], "doc_word": best[:, 4], "item_word": best[:, 5]}


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of at most about ``block_words`` words, one at a time on the driver."""
    ids, texts, n = [], [], 0
    for r in benchmark.where(F.col(id_col).isNotNull() & (F.trim(F.col(text_col)) != "")).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        n += 1 + len(r[1]) // 2
        if n >= block_words:
            yield Block(ids, texts, least_words)
            ids, texts, n = [], [], 0
    if ids:
        yield Block(ids, texts, least_words)


def _scan(block, place: int, min_words: int, penalty: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            for i, j, data, off in blocks(*flat(batch.column(1))):
                o = overlaps(b, Words(data, off), min_words, penalty)
                if len(o["row"]):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(o["row"] + i)), pa.array(o["item"]), *(pa.array(o[c].astype(np.int32)) for c in ("matched", "aligned", "doc_word", "item_word"))], ["doc_id", "item_id", "matched", "aligned", "doc_word", "item_word"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, penalty: int = PENALTY, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, matched and aligned words, and where the overlap begins, of every leak."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block in benchmark_blocks(benchmark, block_words=block_words, least_words=least_words):
        out = out.union(texts.mapInArrow(_scan(spark.sparkContext.broadcast(block), 1, min_words, penalty), SCHEMA))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, penalty: int = PENALTY, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, into which no benchmark item leaks."""
    place = docs.columns.index(text_col)

    def clean(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = block.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, j, data, off in blocks(*flat(batch.column(place))):
                    keep[overlaps(b, Words(data, off), min_words, penalty)["row"] + i] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in benchmark_blocks(benchmark, block_words=block_words, least_words=least_words):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
