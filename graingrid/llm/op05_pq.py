"""Near-duplicate embeddings by product quantisation over inverted lists.

Vectors are scaled to length one, and equal ones folded into one with a count:
only their hashes are shuffled for that. A coarse codebook of about sqrt(n)
centres cuts them into inverted lists; what is left after a vector's centre is
coded in ``SUBSPACES`` subspaces by 256 centres each. Both codebooks are
trained by Lloyd steps over ``SAMPLE`` * sqrt(n) vectors drawn by the hash of
the id; every vector is indexed. A vector is stored in its own list with its
code and the error of its code, and is a query in its own list and in all
others that probing calls for. In a list, a query's table of squared distances
to all subspace centres gives each member's asymmetric distance by lookups;
since the true distance differs from that by at most the member's own coding
error, members beyond threshold + error are passed over without loss, and the
others get the exact cosine.

Sufficient probes. Let q = m + e be a pair within the threshold, r the length
that e may have, and D the gap between q's squared distances to m's centre and
to its own. The gaps of both directions sum to at most 2 e (c_q - c_m), so one
of the two is at most r |c_q - c_m| cos(e, c_q - c_m). A query probes every
list whose gap is at most r |difference of centres| * ``sigmas`` / sqrt(dim):
with sigmas = sqrt(dim) no pair can be lost, and with the default of 3 a pair
is lost only if its difference points along the line of the two centres by
over three standard deviations of a random direction. There is no cap on the
probes, which are 3 on average on the larger check table.

A list is cut into blocks of about ``block`` members, each a task's work on
its own, and the members of one block and a batch of queries are all a task
holds, so a list with a third of all vectors is spread out. Pairs are not
written: a task sends each vector's number of links in it, and the links that
span the components. A pair that both directions find counts in one of them.

Defined results: one row for each usable id: ``rep_id``, the smallest id with
an equal vector; ``class_id``, the smallest id in its connected component of
cosine >= threshold; ``links``, the number of other ids at or above the
threshold, equal ones included. Rows with null id or vector, with null or
non-finite elements, of zero length or of another dimension than most rows are
left out; of rows with equal ids the first vector (by its elements) counts; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed, small
from .op10_simhash import components
from .textcore import mix

THRESHOLD, SIGMAS, SUBSPACES, CODES, STEPS, SAMPLE, BLOCK = 0.95, 3.0, 16, 256, 4, 32, 4096
SCHEMA = "vec_id long, rep_id long, class_id long, links long"
_ROWS = "id long, v array<float>, h0 long, h1 long"
_PLACED = "list int, block int, query boolean, id long, n long, home int, v array<float>, code binary, err float"
_FOUND = "a long, b long, links long"


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.float32).ravel()))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def _split(dim: int, subspaces: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def _unit(dim: int):
    """Usable vectors at length one, with two hashes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            top = np.abs(x).max(1) if len(x) else np.zeros(0)
            ok = np.isfinite(top) & (top > 0)
            x = x[ok] / top[ok, None]
            x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32) + np.float32(0)
            bits = x.view(np.uint32).astype(np.uint64)
            h = [mix((bits * mix(np.arange(1, dim + 1, dtype=np.uint64) + np.uint64(s))).sum(1, dtype=np.uint64)).view(np.int64) for s in (0, 1 << 40)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), _lists(x), pa.array(h[0]), pa.array(h[1])], _names(_ROWS))

    return run


def clean(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """id, unit vector v and its hashes, of the usable rows, reliably stored, and the dimension."""
    v = F.col(vec_col).cast("array<double>")
    rows = table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    dims = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return rows, 0
    rows = rows.where((F.size("v") == dims["d"]) & ~F.exists("v", lambda x: x.isNull()))
    rows = checkpointed(rows.mapInArrow(_unit(dims["d"]), _ROWS))
    again = checkpointed(rows.groupBy("id").count().where("count > 1").select("id"))
    if not again.isEmpty():
        first = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("v", "h0", "h1")).alias("s")).select("id", "s.v", "s.h0", "s.h1")
        rows = checkpointed(rows.join(again, "id", "left_anti").union(first))
    return rows, dims["d"]


def fold(rows: DataFrame) -> DataFrame:
    """Each row's rep_id, the smallest id with an equal vector, and n, the number of ids with it."""
    same = checkpointed(rows.groupBy("h0", "h1").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    side = F.broadcast(same) if small(same, 32) else same
    return rows.join(side, ["h0", "h1"], "left").select("id", "v", F.coalesce("rep", "id").alias("rep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("n"))


class Codebook:
    """Coarse centres and the centres of each subspace of what they leave."""

    def __init__(self, dim: int, subspaces: int = SUBSPACES):
        self.dim, self.parts = dim, _split(dim, subspaces)
        self.coarse = np.zeros((1, dim), np.float32)
        self.fine: list[np.ndarray] = []
        self.blocks = np.ones(1, np.int64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest list, code and coding error of each row."""
        near = _nearest(x, self.coarse)
        left = x - self.coarse[near]
        code = np.stack([_nearest(left[:, p], c) for p, c in zip(self.parts, self.fine)], 1)
        back = np.hstack([c[code[:, k]] for k, c in enumerate(self.fine)])
        return near, code.astype(np.uint8), np.sqrt(((left - back) ** 2).sum(1))

    def gap(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much further each row's squared distance to another list is, and the length between the two centres, the same to the last bit in every task."""
        a, b = self.coarse[own].astype(np.float64), self.coarse[other].astype(np.float64)
        between = b - a
        return np.einsum("ij,ij->i", between, a + b - 2 * x), np.sqrt(np.einsum("ij,ij->i", between, between))

    def probes(self, x: np.ndarray, own: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists a row must probe, its own not among them."""
        out = []
        size = (self.coarse * self.coarse).sum(1)
        for at in range(0, len(x), 1024):
            part, mine = x[at : at + 1024], own[at : at + 1024]
            d = size - 2 * (part @ self.coarse.T)
            least = d[np.arange(len(part)), mine]
            # distances between centres are at most the longest; the exact rule is applied to what that leaves
            between = np.sqrt(np.maximum(size[mine][:, None] + size - 2 * (self.coarse[mine] @ self.coarse.T), 0))
            q, j = np.nonzero(d - least[:, None] <= slack * between + 1e-4)
            keep = j != mine[q]
            q, j = q[keep], j[keep]
            g, length = self.gap(part[q], mine[q], j)
            keep = g <= slack * length
            out.append(np.stack([q[keep] + at, j[keep]]))
        return tuple(np.concatenate(out, 1)) if out else (np.zeros(0, np.int64),) * 2


def _sums(sent, dim: int, fine: bool):
    """Per partition: (codebook, centre, count, sum) of the rows nearest to each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, acc = sent.value, {}
        for b in batches:
            x = _matrix(b.column(0), dim)
            if fine:
                x = x - book.coarse[_nearest(x, book.coarse)]
            for k, (p, centres) in enumerate(zip(book.parts, book.fine) if fine else [(slice(None), book.coarse)]):
                at = _nearest(x[:, p], centres)
                n, s = acc.setdefault(k, (np.zeros(len(centres)), np.zeros(centres.shape)))
                n += np.bincount(at, minlength=len(centres))
                np.add.at(s, at, x[:, p])
        yield from _sum_rows([(k, c, n[c], s[c].tobytes()) for k, (n, s) in acc.items() for c in np.flatnonzero(n)])

    return run


def _sum_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64(), pa.binary()))], ["k", "c", "n", "s"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc: dict = {}
    for b in batches:
        for k, c, n, s in zip(*(col.to_pylist() for col in b.columns)):
            had = acc.get((k, c), (0.0, 0.0))
            acc[k, c] = (had[0] + n, had[1] + np.frombuffer(s))
    yield from _sum_rows([(k, c, n, s.tobytes()) for (k, c), (n, s) in acc.items()])


def train(rows: DataFrame, dim: int, n: int, subspaces: int = SUBSPACES, codes: int = CODES, steps: int = STEPS, sample: int = SAMPLE) -> Codebook:
    """Both codebooks, by ``steps`` Lloyd steps each over about ``sample`` * sqrt(n) of the rows, and at least as many as there are centres."""
    sc = rows.sparkSession.sparkContext
    book = Codebook(dim, subspaces)
    lists = max(1, min(n, round(n**0.5)))
    drawn = max(lists, codes, sample * lists)
    part = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, drawn / max(1, n)) * (1 << 30))).select("id", "v")
    part = checkpointed(part.coalesce(max(1, min(rows.rdd.getNumPartitions(), drawn >> 12))))
    start = part.orderBy(F.xxhash64("id"), "id").limit(max(lists, codes)).select("v").toArrow()
    first = _matrix(start["v"].combine_chunks() if start["v"].num_chunks != 1 else start["v"].chunk(0), dim)
    if not len(first):
        first = _matrix(rows.select("v").limit(1).toArrow()["v"].combine_chunks(), dim)
    book.coarse = np.unique(first[:lists], axis=0)
    form = "k int, c int, n double, s binary"
    for fine in (False, True):
        if fine:
            left = first - book.coarse[_nearest(first, book.coarse)]
            book.fine = [np.unique(left[:codes, p], axis=0) for p in book.parts]
        for _ in range(steps):
            sent = sc.broadcast(book)
            sums = part.select("v").mapInArrow(_sums(sent, dim, fine), form)
            for r in sums.repartition(8, "k", "c").mapInArrow(_add, form).toLocalIterator():
                (book.fine[r["k"]] if fine else book.coarse)[r["c"]] = np.frombuffer(r["s"]) / r["n"]
            sent.unpersist()
    return book


def _encode(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, code, err = sent.value.encode(_matrix(b.column(2), dim))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32)), b.column(2), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err.astype(np.float32))], ["id", "n", "home", "v", "code", "err"])

    return run


def _place(sent, dim: int, slack: float):
    """A row for each block of each list in which a vector is a member or a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, home, x = b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int64), _matrix(b.column(3), dim)
            q, j = book.probes(x, home, slack)
            q, j = np.concatenate([np.arange(len(x)), q]), np.concatenate([home, j])
            many = book.blocks[j]
            at = np.repeat(np.arange(len(q)), many)
            block = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            q, j = q[at], j[at]
            mine = (mix(ids.view(np.uint64)) % book.blocks[home].astype(np.uint64)).astype(np.int64)
            member = (j == home[q]) & (block == mine[q])
            # a vector is a query in its own block by being a member of it
            rows, keep = pa.array(q), pa.array(member)
            code = pa.compute.if_else(keep, b.column(4).take(rows), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(~member), *(b.column(k).take(rows) for k in (0, 1, 2, 3)), code, b.column(5).take(rows)], _names(_PLACED))

    return run


class Members:
    """The members of one block of a list."""

    def __init__(self, book: Codebook, which: int, ids, n, x, code, err):
        self.book, self.which, self.ids, self.n, self.x, self.code, self.err = book, which, ids, n, x, code, err

    def near(self, ids, home, x, threshold: float, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) places of the pairs at or above the threshold that this list is to count."""
        book, reach = self.book, np.sqrt(max(0.0, 2 - 2 * threshold))
        for at in range(0, len(x), 256):
            left = x[at : at + 256] - book.coarse[self.which]
            d = np.zeros((len(left), len(self.ids)), np.float32)
            for k, (p, c) in enumerate(zip(book.parts, book.fine)):
                table = ((left[:, p] ** 2).sum(1)[:, None] + (c * c).sum(1)) - 2 * (left[:, p] @ c.T)
                d += table[:, self.code[:, k]]
            q, m = np.nonzero(np.sqrt(np.maximum(d, 0)) <= reach + self.err + 1e-3)
            q += at
            other = (home[q] != self.which) | (ids[q] < self.ids[m])
            q, m = q[other], m[other]
            cos = np.einsum("ij,ij->i", x[q].astype(np.float64), self.x[m].astype(np.float64))
            ok = (cos >= threshold) & (ids[q] != self.ids[m])
            q, m = q[ok], m[ok]
            # a pair of two lists that the member's own probing finds as well counts where the query has the smaller id
            g, length = book.gap(self.x[m], np.full(len(m), self.which), home[q])
            once = (home[q] == self.which) | (g > slack * length) | (ids[q] < self.ids[m])
            yield q[once], m[once]


def _found(ids: np.ndarray, n: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], width: int) -> pa.RecordBatch:
    """Links of each place, and edges that span the components; places are members, then queries from ``width`` on."""
    label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for q, m in pairs:
        q = q + width
        np.add.at(links, q, n[m])
        np.add.at(links, m, n[q])
        while len(q):
            a, b = label[q], label[m]
            off = a != b
            q, m, a, b = q[off], m[off], a[off], b[off]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    at = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]]), pa.array(links[at])], _names(_FOUND))


def _search(sent, dim: int, threshold: float, slack: float):
    """Over rows in the order of list, block and query: holds a block's members, and queries a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, members = None, None

        def ready() -> Members:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            return Members(sent.value, key[0], t["id"].to_numpy(), t["n"].to_numpy(), _matrix(t["v"], dim), code, t["err"].to_numpy())

        def search(members: Members, own: bool, b: pa.RecordBatch | None) -> pa.RecordBatch:
            if own:
                pairs = members.near(members.ids, np.full(len(members.ids), members.which), members.x, threshold, slack)
                return _found(members.ids, members.n, pairs, 0)
            ids, n = b["id"].to_numpy(), b["n"].to_numpy()
            pairs = members.near(ids, b["home"].to_numpy().astype(np.int64), _matrix(b["v"], dim), threshold, slack)
            return _found(np.concatenate([members.ids, ids]), np.concatenate([members.n, n]), pairs, len(members.ids))

        for b in batches:
            if not b.num_rows:
                continue
            new = np.stack([b["list"].to_numpy(), b["block"].to_numpy(), b["query"].to_numpy(zero_copy_only=False)], 1).astype(np.int64)
            cuts = np.flatnonzero((new[1:] != new[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(new)]):
                part, at = b.slice(lo, hi - lo), tuple(new[lo, :2].tolist())
                if at != key:
                    if held:
                        yield search(ready(), True, None)
                    key, held, members = at, [], None
                if not new[lo, 2]:
                    held.append(part)
                    continue
                if members is None and held:
                    members, held = ready(), []
                    yield search(members, True, None)
                if members is not None:
                    yield search(members, False, part)
        if held:
            yield search(ready(), True, None)

    return run


def classes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, sigmas: float = SIGMAS, subspaces: int = SUBSPACES, codes: int = CODES, block: int = BLOCK) -> DataFrame:
    """vec_id, rep_id, class_id and links of every usable row."""
    spark = table.sparkSession
    rows, dim = clean(table, id_col, vec_col)
    if not dim or rows.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    folded = fold(rows)
    reps = folded.where("id = rep_id").select("id", "n", "v")
    book = train(rows, dim, rows.count(), subspaces, min(codes, CODES))
    coded = checkpointed(reps.mapInArrow(_encode(spark.sparkContext.broadcast(book), dim), "id long, n long, home int, v array<float>, code binary, err float"))
    # the lists' sizes, as many numbers as there are centres
    book.blocks = np.ones(len(book.coarse), np.int64)
    for r in coded.groupBy("home").count().toLocalIterator():
        book.blocks[r["home"]] = -(-r["count"] // block)
    sent = spark.sparkContext.broadcast(book)
    slack = float(np.sqrt(max(0.0, 2 - 2 * threshold)) * min(sigmas, dim**0.5) / dim**0.5)
    placed = coded.mapInArrow(_place(sent, dim, slack), _PLACED)
    found = checkpointed(placed.repartition("list", "block").sortWithinPartitions("list", "block", "query").mapInArrow(_search(sent, dim, threshold, slack), _FOUND).groupBy("a", "b").agg(F.sum("links").alias("links")))
    merged = components(found.where("a <> b").select("a", "b"))
    linked = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep_id")
    told = checkpointed(linked.join(merged.select(F.col("id").alias("rep_id"), "root"), "rep_id", "left"))
    out = folded.select("id", "rep_id", "n").join(F.broadcast(told) if small(told, 32) else told, "rep_id", "left")
    links = F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1
    return out.select(F.col("id").alias("vec_id"), "rep_id", F.coalesce("root", "rep_id").alias("class_id"), links.alias("links"))


#: The same by brute force.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.e = b.e AS same FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other
)
SELECT v.vec_id, (SELECT least(v.vec_id, coalesce(min(b), v.vec_id)) FROM pairs p WHERE p.a = v.vec_id AND p.same) AS rep_id,
  (SELECT min(other) FROM reach r WHERE r.id = v.vec_id) AS class_id, (SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS links
FROM v
"""
