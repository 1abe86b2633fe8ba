"""SimHash near-duplicates with BK-trees.

Every text gets two 128-bit SimHash signatures, of its distinct words and of
its distinct word pairs. Two texts are near-duplicates when the word
signatures differ in at most ``radius`` bits and the pair signatures in at
most ``pair_radius``: the first is what the trees search, the second keeps
texts apart that merely share common words. Groups are the connected
components of that relation; the smallest doc_id of a group stays.

Search. Signatures are made distinct, so thousands of equal texts are one
point. Each point goes to ``tables`` shards, one a table, keyed by ``bits``
sampled signature bits, and every shard has a BK-tree: a child hangs from its
parent by the edge of their integer Hamming distance, and a query at distance
d from a node follows only edges from d - radius to d + radius. Trees of many
shards are built and searched together, level by level, in numpy. Where all
points together are below a checked size the packed points are broadcast and
whole tables are spread over tasks; beyond it each shard's points are shuffled
to one task, a shard after the other. Both ways give the same groups. Points
near the root of their tree are in its component, and are compared only to
those that aren't, which keeps a shard of near copies from taking quadratic
time. A shard of over ``block`` points is cut into blocks: points near its
pivot are members of one block each, the others come to all of them.

Shards are buckets of sampled bits, so recall is theirs: a pair that differs in
d of 128 bits shares no shard with a probability measured as 7 % at d = 20, 1 %
at 18, 0.2 % at 16 and under 0.1 % at 12. Trees are built where they are
searched: as sent, a tree would be several times as large as its points.

Defined results: a text without words (null, empty, only punctuation) is
never a duplicate; rows without doc_id are left alone; rows with equal doc_id
count as repeats of one document; ties go to the smallest doc_id; an empty
table gives no groups; other columns are carried or ignored, never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed, small, unused, without_ids
from .textcore import U, Words, as_longs, blocks, flat, mix, ranges

BITS, RADIUS, PAIR_RADIUS, TABLES, KEY_BITS = 128, 20, 32, 48, 16
#: Points beyond which a shard is cut into blocks; shards that large are at most TABLES / BLOCK times as many as points.
BLOCK = 1 << 17
POINTS = "id long, u0 long, u1 long, b0 long, b1 long"

_LANES = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _LANES[_b] = [(_b >> k) & 1 for k in range(8)]
_LANES = _LANES.view(np.uint64).ravel()
# every eight tables share out all bits, so that no bit counts more than another
_CHOSEN = np.concatenate([np.random.default_rng(1000 + t).permutation(BITS).reshape(-1, KEY_BITS) for t in range(TABLES * KEY_BITS // BITS)])


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs in row order, and where each row's begin."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(rows + 1))


def _simhash(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """128-bit signatures, rows x 2, of features whose rows begin at ptr; zeros for rows without any."""
    rows = len(ptr) - 1
    sums = np.zeros((rows, BITS), np.int32)
    size = np.diff(ptr)
    if len(h):
        with np.errstate(over="ignore"):
            wide = np.stack([mix(h), mix(h ^ U(0xD1B54A32D192ED03))], 1).view(np.uint8)
        parts = -(-size // 255)
        who, k = ranges(np.zeros(rows, np.int64), parts)
        lanes = np.add.reduceat(_LANES[wide], ptr[who] + 255 * k, axis=0)
        counts = lanes.view(np.uint8).astype(np.int32)
        full = np.flatnonzero(parts)
        sums[full] = np.add.reduceat(counts, (np.cumsum(parts) - parts)[full], axis=0)
    on = 2 * sums > size[:, None]
    return np.packbits(on, axis=1).view(np.uint64)


def signatures_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a block of texts, rows x 4, and their word counts."""
    w = Words(data, off)
    rows, row = len(off) - 1, w.row
    uni = _simhash(*_distinct(row, w.hash, rows))
    same = np.flatnonzero(row[1:] == row[:-1])
    with np.errstate(over="ignore"):
        pair = mix(w.hash[same] * U(3) + w.hash[same + 1])
    lone = np.flatnonzero(np.diff(w.ptr) == 1)
    row2 = np.concatenate([row[same], lone])
    pairs = _simhash(*_distinct(row2, np.concatenate([pair, w.hash[w.ptr[lone]]]), rows))
    return np.hstack([uni, pairs]), np.diff(w.ptr)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, off in blocks(*flat(batch.column(1))):
            sig, n = signatures_of(data, off)
            keep = pa.array(n > 0)
            s = as_longs(sig)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(s[:, k].copy()) for k in range(4))], ["id", "u0", "u1", "b0", "b1"]).filter(keep)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, u0, u1 (words), b0, b1 (word pairs) of each row that has an id and a word."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_sign, POINTS)


def keys_of(sig: np.ndarray) -> np.ndarray:
    """Shard keys, points x tables: the table's number above its sampled bits."""
    on = np.unpackbits(np.ascontiguousarray(sig[:, :2]).view(np.uint8), axis=1)
    weights = 1 << np.arange(KEY_BITS)
    return np.stack([on[:, c] @ weights + (t << KEY_BITS) for t, c in enumerate(_CHOSEN)], 1)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int32)


class Forest:
    """BK-trees of many shards in flat arrays. ``shard`` must be sorted."""

    def __init__(self, sig: np.ndarray, shard: np.ndarray):
        n = len(sig)
        self.sig, self.shard = sig, shard
        self.root = np.searchsorted(shard, shard)
        parent, edge, cur = np.full(n, -1, np.int64), np.zeros(n, np.int64), self.root.copy()
        todo = np.flatnonzero(self.root != np.arange(n))
        while len(todo):
            at = cur[todo]
            d = _hamming(sig[todo], sig[at]).astype(np.int64)
            slot = at * (BITS + 1) + d
            order = np.argsort(slot, kind="stable")
            slot, todo, at, d = slot[order], todo[order], at[order], d[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            child = todo[first]
            parent[child], edge[child] = at[first], d[first]
            cur[todo] = child[np.cumsum(first) - 1]
            todo = todo[~first]
        kids = np.flatnonzero(parent >= 0)
        key = parent[kids] * (BITS + 1) + edge[kids]
        order = np.argsort(key)
        self.kids, self.key = kids[order], key[order]

    def near(self, queries: np.ndarray, radius: int, others: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, node before query or one of ``others``, which are no queries; queries are places in the forest."""
        q, node = queries, self.root[queries]
        while len(q):
            d = _hamming(self.sig[q], self.sig[node])
            hit = (d <= radius) & (node < q if others is None else (node < q) | others[node])
            yield q[hit], node[hit]
            base = node * (BITS + 1)
            lo = np.searchsorted(self.key, base + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, base + np.minimum(d + radius, BITS), "right")
            who, k = ranges(lo, hi)
            q, node = q[who], self.kids[k]


def linked(ids: np.ndarray, sig: np.ndarray, shard: np.ndarray, radius: int, pair_radius: int, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smaller id of its component) that span the components within each shard.

    ``kind`` is given for blocks of split shards: 1 for what is near the shard's pivot, 2 for what isn't, 0 elsewhere.
    """
    order = np.argsort(shard, kind="stable") if kind is None else np.lexsort((kind == 2, shard))
    ids, sig, shard = ids[order], sig[order], shard[order]
    _, at, size = np.unique(shard, return_index=True, return_counts=True)
    many = np.repeat(size > 1, size)
    ids, sig, shard = ids[many], sig[many], shard[many]
    if not len(ids):
        return ids, ids
    forest = Forest(np.ascontiguousarray(sig[:, :2]), shard)
    # what is near its tree's root is in the root's component, and needn't be compared to others near the root
    root = forest.root
    core = (_hamming(forest.sig, forest.sig[root]) <= radius) & (_hamming(sig[:, 2:], sig[root, 2:]) <= pair_radius)
    if kind is not None:
        kind = kind[order][many]
        # in a block what is near the pivot comes first, so that its first is the root
        core = np.where(kind == 0, core, kind == 1)
    label = np.where(core, root, np.arange(len(ids)))
    _, size = np.unique(shard, return_counts=True)
    rest = np.flatnonzero(~core)
    load = np.cumsum(np.repeat(size, size)[rest])
    for chunk in np.split(rest, np.searchsorted(load, np.arange(1 << 19, load[-1], 1 << 19))) if len(rest) else ():
        for q, node in forest.near(chunk, radius, core):
            ok = _hamming(sig[q, 2:], sig[node, 2:]) <= pair_radius
            q, node = q[ok], node[ok]
            while len(q):
                a, b = label[q], label[node]
                off = a != b
                q, node, a, b = q[off], node[off], a[off], b[off]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
    out = label != np.arange(len(ids))
    a, b = ids[out], ids[label[out]]
    return np.maximum(a, b), np.minimum(a, b)


EDGES = "a long, b long"


def _edges_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _search_shards(radius: int, pair_radius: int):
    """Over points in the order of shards: whole shards or blocks, some tens of thousands of points at a time."""

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        kind = cols[6] if len(cols) > 6 else None
        return _edges_batch(*linked(cols[1], np.stack(cols[2:6], 1).view(np.uint64), cols[0], radius, pair_radius, kind))

    def run(batches):
        held, n, wait = [], 0, 1 << 16
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy() for c in b.columns])
                n += b.num_rows
            if n < wait:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last shard may go on
            if cut:
                yield found([c[:cut] for c in cols])
            held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
            wait = max(1 << 16, 2 * n)
        if n:
            yield found([np.concatenate(c) for c in zip(*held)])

    return run


def _to_shards(batches):
    for b in batches:
        if b.num_rows:
            s = np.stack([b.column(k).to_numpy() for k in range(1, 5)], 1)
            keys = keys_of(s.view(np.uint64))
            at = np.repeat(np.arange(b.num_rows), TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), *(pa.array(s[at, k]) for k in range(4))], ["shard", "id", "u0", "u1", "b0", "b1"])


def _to_blocks(sent, radius: int, pair_radius: int, block: int):
    """Points of large shards (shard, its size, its pivot) cut into blocks, and what links to the pivot.

    Near the pivot a point is in the pivot's component, and a member of one block; others are in every block. The shard of a
    block is a number of its own, below zero; ``kind`` 3 rows are edges from id to the pivot, in u0.
    """

    def run(batches):
        shards, sizes, pivots, ids_of = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            shard, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            s = np.stack([b.column(k).to_numpy() for k in range(2, 6)], 1)
            at = np.minimum(np.searchsorted(shards, shard), len(shards) - 1)
            hot = shards[at] == shard
            cold = np.flatnonzero(~hot)
            rows = [(shard[cold].astype(np.int64), ids[cold], s[cold], np.zeros(len(cold), np.int32))]
            k = np.flatnonzero(hot)
            if len(k):
                at, u = at[k], s[k].view(np.uint64)
                near = (_hamming(u[:, :2], pivots[at, :2]) <= radius) & (_hamming(u[:, 2:], pivots[at, 2:]) <= pair_radius)
                blocks_of = -(-sizes[at] // block)
                mine = (mix(ids[k].view(np.uint64)) % blocks_of.astype(np.uint64)).astype(np.int64)
                who, number = ranges(np.where(near, mine, 0), np.where(near, mine + 1, blocks_of))
                rows.append((-1 - (at[who].astype(np.int64) << 32) - number, ids[k][who], s[k][who], np.where(near[who], 1, 2).astype(np.int32)))
                linked_to = np.flatnonzero(near & (ids[k] != ids_of[at]))
                edge = np.zeros((len(linked_to), 4), np.int64)
                edge[:, 0] = ids_of[at[linked_to]]
                rows.append((mix(ids[k][linked_to].view(np.uint64)).view(np.int64) | (1 << 40), ids[k][linked_to], edge, np.full(len(linked_to), 3, np.int32)))
            shard, ids, s, kind = (np.concatenate(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids), *(pa.array(s[:, k].copy()) for k in range(4)), pa.array(kind)], ["shard", "id", "u0", "u1", "b0", "b1", "kind"])

    return run


def _shuffled_edges(points: DataFrame, radius: int, pair_radius: int, block: int) -> DataFrame:
    """Edges of all shards, each in one task, but large ones in blocks."""
    placed = points.mapInArrow(_to_shards, "shard int, " + POINTS)
    # what is counted is a number a shard, added up before it is shuffled; few shards are large
    large = placed.groupBy("shard").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "u0", "u1", "b0", "b1"), "id").alias("p")).where(F.col("n") > block)
    large = checkpointed(large.select("shard", "n", "p.*").orderBy("shard"))
    if large.isEmpty():
        return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search_shards(radius, pair_radius), EDGES)
    t = large.orderBy("shard").toArrow()
    pivots = np.stack([t[c].to_numpy() for c in ("u0", "u1", "b0", "b1")], 1).view(np.uint64)
    sent = points.sparkSession.sparkContext.broadcast((t["shard"].to_numpy(), t["n"].to_numpy(), pivots, t["id"].to_numpy()))
    cut = placed.mapInArrow(_to_blocks(sent, radius, pair_radius, block), "shard long, " + POINTS + ", kind int")
    edges = cut.where("kind = 3").select(F.greatest("id", "u0").alias("a"), F.least("id", "u0").alias("b"))
    return edges.union(cut.where("kind < 3").repartition("shard").sortWithinPartitions("shard").mapInArrow(_search_shards(radius, pair_radius), EDGES))


def _search_tables(points, radius: int, pair_radius: int):
    """Over the numbers of tables: builds the table's shard trees from the broadcast points and queries every point."""

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                ids, sig = points.value
                on = np.unpackbits(np.ascontiguousarray(sig[:, :2]).view(np.uint8), axis=1)
                yield _edges_batch(*linked(ids, sig, on[:, _CHOSEN[t]] @ (1 << np.arange(KEY_BITS)), radius, pair_radius))

    return run


def components(edges: DataFrame) -> DataFrame:
    """Columns id and root, the smallest id of its component, for all ids that aren't roots.

    Alternates large-star and small-star contraction, each round reliably checkpointed, until nothing moves.
    """
    least = Window.partitionBy("u")
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = both.withColumn("m", F.least("u", F.min("v").over(least))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_star = star.withColumn("m", F.min("v").over(least))
        edges = checkpointed(small_star.select("u", F.col("m").alias("v")).union(small_star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, pair_radius: int = PAIR_RADIUS, broadcast_bytes: int = 16 << 20, block: int = BLOCK) -> DataFrame:
    """doc_id and group_id, the smallest doc_id of the group, of every document in a group of two or more."""
    spark = docs.sparkSession
    sigs = checkpointed(signatures(docs, id_col, text_col))
    key = ["u0", "u1", "b0", "b1"]
    folded = checkpointed(sigs.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    points = folded.select("id", *key)
    if small(points, 40, broadcast_bytes):
        t = points.toArrow()
        sig = np.stack([t[c].to_numpy() for c in ("u0", "u1", "b0", "b1")], 1).view(np.uint64)
        sent = spark.sparkContext.broadcast((t["id"].to_numpy(), sig))
        edges = spark.range(0, TABLES, 1, TABLES).mapInArrow(_search_tables(sent, radius, pair_radius), EDGES)
    else:
        edges = _shuffled_edges(points, radius, pair_radius, block)
    merged = components(edges)
    # only points of groups are joined back to their documents
    grouped = folded.join(merged, "id", "left").where("n > 1 or root is not null").select(*key, F.coalesce("root", "id").alias("group_id"))
    grouped = checkpointed(grouped)
    rooted = sigs.join(F.broadcast(grouped) if small(grouped, 40) else grouped, key).select("id", "group_id")
    found = rooted.where("id <> group_id").distinct()
    roots = found.select(F.col("group_id").alias("id")).distinct().withColumn("group_id", F.col("id"))
    return found.union(roots).select(F.col("id").alias("doc_id"), "group_id").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs``, with its own columns, without all but the first document of each group.

    Of rows with equal doc_id, one stays (the first by the text of all its columns).
    """
    found = checkpointed(groups(docs, id_col, text_col, **params))
    extra = found.where("doc_id <> group_id").select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col)).distinct()
    left = without_ids(docs, checkpointed(extra), id_col)
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    again = checkpointed(again)
    if again.isEmpty():
        return left.select(docs.columns)
    mark = unused(left, "place")
    w = Window.partitionBy(id_col).orderBy(F.to_json(F.struct(*docs.columns)))
    one = left.join(again, id_col, "left_semi").withColumn(mark, F.row_number().over(w)).where(F.col(mark) == 1).drop(mark)
    return without_ids(left, again, id_col).select(docs.columns).union(one.select(docs.columns))
