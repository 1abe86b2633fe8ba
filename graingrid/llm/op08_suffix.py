"""Repeated passages by hash-compared suffix sorting.

A passage of at least ``min_words`` words that occurs twice, in two documents
or twice in one, is found as follows. A document's windows are all its runs of
min_words words; a repeat is a window that stands elsewhere, too.

1. Anchors. A window's anchor is the smallest of its GRAM-word hashes, so equal
   windows have equal anchors at equal places, and a document has an anchor
   about every 18 words. Anchors (hash, document, place) are shuffled by hash;
   those whose hash occurs once are dropped. Hashes that a map task sees twice
   itself leave it as one marker, so a hash with a third of all anchors doesn't
   fill a task.
2. Stretches. Documents with anchors left are read again, and each anchor sends
   the words of the windows whose anchor it is (about 67), as 64-bit hashes cut
   to 32 bits, to the shard of its hash. Of equal stretches only the earliest
   goes on: the others repeat it from end to end, in the map task already. A
   hash with very many anchors (``hot``) whose stretches differ is split: each
   of its windows goes to the shard of its own words.
3. Suffix sort. A shard keeps prefix polynomial hashes of its text, so that a
   binary search over lengths gives the common extension of two suffixes in
   logarithmic time, and with it their order. A bottom-up mergesort, all merges
   of a level at once and each by binary search of every suffix in the other
   run, sorts the suffixes of each anchor hash; a second sort over the reversed
   text orders them by what stands before. The extensions of neighbours,
   verified word by word against hash collisions, cut either order into runs
   that share so many words. Two windows at the same offset from their anchors
   are equal if they are in the same run of both orders, which makes the result
   exact: every window is compared to every other.
4. Spans of a document's repeated windows are merged; ``duplicate`` windows, of
   which an occurrence with a smaller (doc_id, place) exists, apart from first
   occurrences.

Defined results: words are compared folded and without punctuation (as 32-bit
hashes); null, empty and shorter texts have no passage; documents without id
are ignored; rows with equal ids and texts repeat each other; ``n_words`` is
the span's length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import BROADCAST_BYTES, checkpointed
from .textcore import U, Words, blocks, flat, mix, powers, ranges

MIN_WORDS, GRAM, HOT = 50, 16, 1 << 14
#: Anchors, and text bytes, that a map task looks at together.
_ANCHORS, _BYTES = 1 << 17, 4 << 20
SPANS = "doc_id long, start_word long, end_word long, n_words long, duplicate boolean"


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minima of every w consecutive values."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    size, cur = 1, h
    while 2 * size <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[w - size : w - size + n])


def anchors_of(h: np.ndarray, ptr: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of rows whose words begin at ptr: places in h, hashes, and the least and greatest offset from the begin of a window that has it."""
    n = len(h) - gram + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, np.zeros(0, np.uint64), none, none
    g = np.zeros(n, np.uint64)
    for k in range(gram):
        g = g * U(0x9E3779B97F4A7C15) + h[k : k + n]
    g = mix(g)
    size = np.diff(ptr)
    stop, begin = np.repeat(ptr[1:], size), np.repeat(ptr[:-1], size)
    w = min_words - gram + 1
    least = _window_min(g, w)
    if not len(least):
        return none, g[:0], none, none
    whole = np.flatnonzero(np.arange(len(least)) + min_words <= stop[: len(least)])
    # a place is an anchor if it holds the minimum of some whole window: the greatest of those it lies in is its own value
    low = np.zeros(len(least), np.uint64)
    low[whole] = least[whole]
    pad = np.zeros(w - 1, np.uint64)
    is_min = ~_window_min(~np.concatenate([pad, low, pad]), w) == g
    at = np.flatnonzero(is_min)
    # the windows of an anchor begin after the last smaller hash before it, and end before the next one
    own = g[at]
    before, after = np.full(len(at), w, np.int64), np.full(len(at), w, np.int64)
    for k in range(w - 1, 0, -1):
        before[(at >= k) & (g[np.maximum(at - k, 0)] < own)] = k
        after[(at + k < n) & (g[np.minimum(at + k, n - 1)] < own)] = k
    far = np.minimum(np.minimum(before - 1, w - 1), at - begin[at])
    near = np.maximum(np.maximum(w - after, 0), at + min_words - stop[at])
    ok = near <= far
    return at[ok], own[ok], near[ok], far[ok]


def _anchors(min_words: int, gram: int):
    """(key, row, place) of anchors: kind 0 alone in its batch, keyed by hash; of others, kind 2 each, keyed at random, and kind 1 their number."""

    def told(held: list) -> pa.RecordBatch:
        g, row, place = (np.concatenate(x) for x in zip(*held))
        kinds, back, n = np.unique(g, return_inverse=True, return_counts=True)
        twice = n > 1
        again = twice[back]
        spread = mix(row.astype(np.uint64) * U(31) + place.astype(np.uint64))
        key = np.concatenate([np.where(again, spread, g), kinds[twice]])
        zero = np.zeros(twice.sum(), np.int64)
        cols = [key.view(np.int64), np.concatenate([row, zero]), np.concatenate([place, n[twice]]).astype(np.int64), np.concatenate([2 * again, zero + 1]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "row", "place", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, off in blocks(*flat(batch.column(1))):
                w = Words(data, off)
                at, g, _, _ = anchors_of(w.hash, w.ptr, min_words, gram)
                if len(at):
                    row = np.searchsorted(w.ptr, at, "right") - 1
                    held.append((g, ids[row + i], at - w.ptr[row]))
                    n += len(at)
                if n >= _ANCHORS:
                    yield told(held)
                    held, n = [], 0
        if held:
            yield told(held)

    return run


def _repeated(hot: int):
    """Over anchors in the order of key: row and place of those whose hash occurs more than once, and the hashes of over ``hot`` with their numbers."""

    def told(key, row, place, kind) -> pa.RecordBatch:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lot = np.cumsum(new) - 1
        total = np.bincount(lot, np.where(kind == 1, place, kind == 0)).astype(np.int64)
        keep = (kind == 2) | (kind == 0) & (total[lot] > 1)
        many = np.flatnonzero(total > hot)
        none = np.zeros(len(many), np.int64)
        rows = [np.concatenate([row[keep], none]), np.concatenate([place[keep], none]).astype(np.int32), np.concatenate([np.zeros(keep.sum(), np.int64), key[new][many]]), np.concatenate([np.zeros(keep.sum(), np.int64), total[many]])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["row", "place", "hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last key of a batch may go on; once it repeats, what is held of it is told and kept as one marker
        rest = None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4)]
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield told(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
            kind = rest[3]
            total = int(rest[2][kind == 1].sum() + (kind == 0).sum())
            if total > 1 and len(kind) > 1:
                sure = kind != 1
                none = pa.array(np.zeros(sure.sum(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rest[1][sure]), pa.array(rest[2][sure].astype(np.int32)), none, none], ["row", "place", "hash", "n"])
                rest = [rest[0][:1], np.zeros(1, np.int64), np.array([total], np.int64), np.array([1], np.int32)]
        if rest is not None:
            yield told(*rest)

    return run


_STRETCH = "key long, hash long, row long, place int, far int, near int, kind int, words binary"


def _stretches(sent, min_words: int, gram: int):
    """Per document its wanted anchors' stretches: the words from ``far`` before the anchor to the end of the window that begins ``near`` before it.

    Of equal ones the earliest is kind 0, or 1 if it has copies; the copies are spans, kind 2, from ``place`` to ``far``.
    """

    def told(held: list) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        kept, spans = fold_equal(t)
        yield from kept.to_batches()
        if spans.num_rows:
            row, first, end = (spans.column(k) for k in range(3))
            n = spans.num_rows
            key = mix(row.to_numpy().astype(np.uint64) * U(31) + first.to_numpy().astype(np.uint64)).view(np.int64)
            zero = np.zeros(n, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key), row, first, end, pa.array(zero), pa.array(zero + 2), pa.nulls(n, pa.binary())], _names(_STRETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        held, n = [], 0
        for batch in batches:
            places = batch.column(2)
            cut, inner = places.offsets.to_numpy().astype(np.int64), places.values.to_numpy()
            ids = batch.column(0).to_numpy()
            for i, j, data, off in blocks(*flat(batch.column(1))):
                w = Words(data, off)
                at, g, near, far = anchors_of(w.hash, w.ptr, min_words, gram)
                row = np.searchsorted(w.ptr, at, "right") - 1
                mine, k = ranges(cut[i:j], cut[i + 1 : j + 1])
                wanted = np.isin(at, w.ptr[mine] + inner[k])
                at, g, near, far, row = at[wanted], g[wanted], near[wanted], far[wanted], row[wanted]
                key = g
                if len(hot) and (split := np.isin(g, hot)).any():
                    whole = ~split
                    who, o = ranges(near[split], far[split] + 1)
                    at, g, row = (np.concatenate([c[whole], c[split][who]]) for c in (at, g, row))
                    near, far = np.concatenate([near[whole], o]), np.concatenate([far[whole], o])
                    key = g.copy()
                    first = at[whole.sum() :] - o
                    own = np.zeros(len(o), np.uint64)
                    for q in range(min_words):
                        own = own * U(0x9E3779B97F4A7C15) + w.hash[first + q]
                    key[whole.sum() :] = mix(own)
                if not len(at):
                    continue
                lo, hi = at - far, at - near + min_words
                _, e = ranges(lo, hi)
                text = (w.hash >> U(32)).astype(np.uint32)[e]
                ends = np.concatenate([[0], np.cumsum(hi - lo)]) * 4
                words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
                cols = [pa.array(key.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids[row + i]), *(pa.array(c.astype(np.int32)) for c in (at - w.ptr[row], far, near, 0 * at)), words]
                held.append(pa.RecordBatch.from_arrays(cols, _names(_STRETCH)))
                n += len(text) * 4
                if n >= _BYTES:
                    yield from told(held)
                    held, n = [], 0
        if held:
            yield from told(held)

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Text:
    """Concatenated windows with prefix polynomial hashes; suffixes end with their window."""

    def __init__(self, words: np.ndarray, stop: np.ndarray):
        self.words, self.stop = words, stop
        with np.errstate(over="ignore"):
            n = len(words)
            self.pow = powers(n + 1)
            # sum of word * base**place; two spans are compared after scaling to a common place
            self.pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.astype(np.uint64)) * self.pow[:n])])

    def common(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> np.ndarray:
        """Lengths of the common extensions from a and b, by binary search over hashed lengths."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(stop_a - a, stop_b - b)
        first, second = np.minimum(a, b), np.maximum(a, b)
        shift = self.pow[second - first]
        with np.errstate(over="ignore"):
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    return lo
                mid = (lo[todo] + hi[todo] + 1) // 2
                f, s = first[todo], second[todo]
                same = (self.pre[f + mid] - self.pre[f]) * shift[todo] == self.pre[s + mid] - self.pre[s]
                lo[todo] = np.where(same, mid, lo[todo])
                hi[todo] = np.where(same, hi[todo], mid - 1)

    def less(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; equal ones by their own numbers."""
        n = self.common(a, b, stop_a, stop_b)
        end_a, end_b = a + n >= stop_a, b + n >= stop_b
        wa = self.words[np.minimum(a + n, len(self.words) - 1)].astype(np.int64)
        wb = self.words[np.minimum(b + n, len(self.words) - 1)].astype(np.int64)
        wa, wb = np.where(end_a, -1, wa), np.where(end_b, -1, wb)
        return (wa < wb) | ((wa == wb) & (place_a < place_b))

    def suffix_sort(self, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The order of the suffixes within their groups, which take the places from low to high.

        A bottom-up mergesort; the merges of a level, in all groups that are longer than its runs, are done at once.
        """
        order, width = np.arange(len(start)), 1
        pos = np.flatnonzero(high - low > width)
        while len(pos):
            g, stop = low[pos], high[pos]
            rel = pos - g
            run = rel // width
            lo = np.minimum(g + (run ^ 1) * width, stop)
            hi = np.minimum(lo + width, stop)
            base = lo.copy()
            own = order[pos]
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    break
                mid = (lo[todo] + hi[todo]) // 2
                x, y = order[mid], own[todo]
                before = self.less(start[x], start[y], self.stop[x], self.stop[y], x, y)
                lo[todo] = np.where(before, mid + 1, lo[todo])
                hi[todo] = np.where(before, hi[todo], mid)
            order[g + (run // 2) * 2 * width + (rel - run * width) + (lo - base)] = own
            width *= 2
            pos = pos[high[pos] - low[pos] > width]
        return order

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The lengths n cut to where the words from a and b really are equal."""
        out = n.copy()
        for at in range(0, len(n), 1 << 12):  # a chunk at a time, which bounds the memory
            part = slice(at, at + (1 << 12))
            who, k = ranges(np.zeros(len(n[part]), np.int64), n[part])
            bad = self.words[a[part][who] + k] != self.words[b[part][who] + k]
            np.minimum.at(out[part], who[bad], k[bad])
        return out


def _depths(text: Text, start: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sorted suffixes: their order, and how many words each shares with the one before it (-1 at the begin of a group)."""
    order = text.suffix_sort(start, low, high)
    shared = np.full(len(start), -1, np.int64)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    a, b = order[same], order[same - 1]
    shared[same] = text.verified(start[a], start[b], text.common(start[a], start[b], text.stop[a], text.stop[b]))
    return order, shared


def repeats(group: np.ndarray, words: np.ndarray, size: np.ndarray, far: np.ndarray, near: np.ndarray, rank: np.ndarray, copied: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches in a shard: (stretch, first word, end word, duplicate) of runs of repeated windows, relative to the anchor.

    ``group`` (key) must be sorted, and only stretches of the same one are compared; ``rank`` orders occurrences;
    all windows of a ``copied`` one repeat.
    """
    ends = np.cumsum(size)
    begins = ends - size
    n = len(size)
    right, at = Text(words, ends), begins + far
    # reversed text: what stands before an anchor, nearest word first
    left = Text(words[::-1].copy(), len(words) - begins)
    low, high = np.searchsorted(group, group), np.searchsorted(group, group, "right")
    r_order, r_shared = _depths(right, at, group, low, high)
    l_order, l_shared = _depths(left, len(words) - at, group, low, high)
    width = int(far.max()) + 1 if n else 0
    # repeated and duplicate windows by stretch and offset, with a false column on either side
    marks = np.zeros((2, n, width + 2), bool)
    r_run, l_run = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(width):
        sel = np.flatnonzero((near <= o) & (o <= far))
        if not len(sel):
            continue
        r_run[r_order] = np.cumsum(r_shared < min_words - o)
        l_run[l_order] = np.cumsum(l_shared < o)
        key = l_run[sel] * (n + 1) + r_run[sel]
        sort = np.lexsort((rank[sel], key))
        sel, key = sel[sort], key[sort]
        first = np.ones(len(sel), bool)
        first[1:] = key[1:] != key[:-1]
        last = np.ones(len(sel), bool)
        last[:-1] = first[1:]
        marks[0, sel, o + 1] = (first & (~last | copied[sel]))
        marks[1, sel, o + 1] = ~first
    out = []
    for flag, m in enumerate(marks):
        edge = m[:, 1:] != m[:, :-1]
        who, k = np.nonzero(edge)
        # edges come in pairs: a run of offsets from k to the next edge, less one
        out.append((who[::2], -(k[1::2] - 1), min_words - k[::2], np.full(len(who) // 2, bool(flag))))
    return tuple(np.concatenate(c) for c in zip(*out))


def fold_equal(t: pa.Table) -> tuple[pa.Table, pa.RecordBatch]:
    """The table with the earliest of each set of equal stretches, as kind 1 if it has copies, and the copies' spans.

    Equal stretches repeat each other from end to end, so only the earliest has to be sorted among the others.
    """
    key, row, place, far, near, kind = (t[c].to_numpy() for c in ("key", "row", "place", "far", "near", "kind"))
    col = t["words"].combine_chunks()
    size = pc.binary_length(col).to_numpy() // 4
    code = col.dictionary_encode().indices.to_numpy()
    order = np.lexsort((place, row, far, near, code, key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in (key, code, far, near)], axis=0)
    lot = np.cumsum(new) - 1
    many = np.bincount(lot) > 1
    lead = order[new]
    kind = kind.copy()
    # an earlier copy's mark stays with whichever is first now
    kind[lead] = many | (np.bincount(lot, kind[order] > 0) > 0) if len(order) else kind[lead]
    again = order[~new]
    first = place[again] - far[again]
    spans = _span_batch(row[again], first, first + size[again], np.ones(len(again), bool))
    kept = t.set_column(t.schema.get_field_index("kind"), "kind", pa.array(kind.astype(np.int32))).take(pa.array(np.sort(lead)))
    return kept, spans


def _span_batch(row: np.ndarray, first: np.ndarray, end: np.ndarray, dup: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(dup)], ["row", "first", "end", "duplicate"])


def _sort_shards(min_words: int):
    """Over stretches sorted by key: whole groups of distinct stretches, a few thousand at a time, which bounds the memory of a task."""

    def repeats_of(t: pa.Table) -> pa.RecordBatch:
        keys, row, place, far, near, kind = (t[c].to_numpy() for c in ("key", "row", "place", "far", "near", "kind"))
        # alone and without copies nothing repeats
        low, high = np.searchsorted(keys, keys), np.searchsorted(keys, keys, "right")
        some = np.flatnonzero((high - low > 1) | (kind > 0))
        if not len(some):
            return _span_batch(row[:0], row[:0], row[:0], kind[:0] > 0)
        keys, row, place, far, near, kind = (c[some] for c in (keys, row, place, far, near, kind))
        data, off = flat(t["words"].take(pa.array(some)))
        rank = np.empty(len(row), np.int64)
        rank[np.lexsort((place, row))] = np.arange(len(row))
        w, first, end, dup = repeats(keys, data.view(np.uint32), np.diff(off) // 4, far.astype(np.int64), near.astype(np.int64), rank, kind > 0, min_words)
        return _span_batch(row[w], place[w] + first, place[w] + end, dup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wait = [], 0, 1 << 12
        for b in batches:
            span = pc.equal(b["kind"], 2)
            if (done := b.filter(span)).num_rows:
                yield _span_batch(done["row"].to_numpy(), done["place"].to_numpy(), done["far"].to_numpy(), np.ones(done.num_rows, bool))
                b = b.filter(pc.invert(span))
            for at in range(0, b.num_rows, 1 << 12):
                held.append(b.slice(at, 1 << 12))
                n += held[-1].num_rows
                if n < wait:
                    continue
                t, spans = fold_equal(pa.Table.from_batches(held).combine_chunks())
                if spans.num_rows:
                    yield spans
                h = t["key"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if cut:
                    yield repeats_of(t.slice(0, cut).combine_chunks())
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
                wait = max(1 << 12, 2 * n)
        if n:
            t, spans = fold_equal(pa.Table.from_batches(held).combine_chunks())
            if spans.num_rows:
                yield spans
            yield repeats_of(t.combine_chunks())

    return run


def merge_spans(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of each row made one."""
    order = np.lexsort((first, row))
    row, first, end = row[order], first[order], end[order]
    if not len(row):
        return row, first, end
    base = (end.max() + 2) * np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(row), bool)
    new[1:] = first[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return row[at], first[at], np.maximum.reduceat(end, at)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans of each document; duplicates apart from first occurrences."""
    for batch in batches:
        firsts, ends, dups = (batch.column(k) for k in (1, 2, 3))
        row, k = ranges(*(firsts.offsets.to_numpy().astype(np.int64)[s] for s in (slice(None, -1), slice(1, None))))
        f, e, d = (c.values.to_numpy(zero_copy_only=False) for c in (firsts, ends, dups))
        out = []
        for flag in (False, True):
            m = d[k] == flag
            r, a, b = merge_spans(row[m], f[k[m]].astype(np.int64), e[k[m]].astype(np.int64))
            out.append((r, a, b, np.full(len(r), flag)))
        r, a, b, flag = (np.concatenate(c) for c in zip(*out))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(a), pa.array(b), pa.array(b - a), pa.array(flag)], [c.split()[0] for c in SPANS.split(", ")])


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The repeated spans of each document, in words, and whether an earlier occurrence exists.

    Spans with and without an earlier occurrence are merged apart, and can overlap where a passage repeats in part.
    """
    gram = min(gram, min_words)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    anchors = texts.mapInArrow(_anchors(min_words, gram), "key long, row long, place long, kind int")
    repeated = checkpointed(anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated(hot), "row long, place int, hash long, n long"))
    # the larger of ``hot`` and a millionth of all anchors, so that there are a million split hashes at most
    many = max(hot, repeated.count() >> 20)
    split = np.sort(np.array([r["hash"] for r in repeated.where(F.col("n") > many).select("hash").toLocalIterator()], np.int64).view(np.uint64))
    wanted = checkpointed(repeated.where("n = 0").groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("places")))
    size = wanted.agg(F.sum(F.size("places") * 4 + 40)).first()[0] or 0
    # below a checked size the places are broadcast and the texts don't move
    side = F.broadcast(wanted) if size <= broadcast_bytes else wanted
    sent = docs.sparkSession.sparkContext.broadcast(split)
    stretches = texts.join(side, "row").select("row", "text", "places").mapInArrow(_stretches(sent, min_words, gram), _STRETCH)
    found = stretches.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shards(min_words), "row long, first int, end int, duplicate boolean")
    spans = found.groupBy("row").agg(F.collect_list("first").alias("first"), F.collect_list("end").alias("end"), F.collect_list("duplicate").alias("dup"))
    return spans.mapInArrow(_merge, SPANS)


_CAPITALS = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF), *range(0x410, 0x430)))

#: The same from all windows of all documents.
ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT doc_id, w, unnest(range(len(w) - {MIN_WORDS} + 1)) AS s FROM t WHERE len(w) >= {MIN_WORDS}
), k AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s + 1, s + {MIN_WORDS}), ' ')) AS k FROM s
), r AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS duplicate, count(*) OVER (PARTITION BY k) AS n FROM k
), g AS (
  SELECT doc_id, s, duplicate, coalesce(s - lag(s) OVER (PARTITION BY doc_id, duplicate ORDER BY s) > {MIN_WORDS}, true)::INT AS new FROM r WHERE n > 1
), i AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, duplicate ORDER BY s) AS i FROM g
)
SELECT doc_id, min(s)::BIGINT AS start_word, (max(s) + {MIN_WORDS})::BIGINT AS end_word, (max(s) + {MIN_WORDS} - min(s))::BIGINT AS n_words, duplicate FROM i GROUP BY doc_id, duplicate, i
"""
