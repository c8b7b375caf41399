"""Exact top-k search by inner product with two cover trees.

Data and queries are both indexed by balls in two levels. Above, at most ``pivots`` sampled
vectors cut either side into groups (one per nearest pivot), each with its centre and covering
radius. A query's k-th best score among a bounded sample of the data is a lower bound from the
start; the worst of a query group's bounds is compared with the largest inner product that any
two vectors of a query group and a data group can have,

    <q, d> <= <cq, cd> + |cq| rd + |cd| rq + rq rd,

and pairs of groups below it are pruned before any data move. Within a surviving pair each task
builds a cover tree over its queries and one over each chunk of data, whose levels shrink the
radius by ``base``: every point lies within a level's radius of its centre, and centres of a
level lie farther apart than that. Pairs of nodes are descended together and pruned by the same
bound against the queries' k-th scores found so far. Leaf pairs are multiplied in doubles, which
is exact where no partial sum can pass 2^53, else in 64-bit integers or larger ones.

A block of up to about ``block`` queries, whose tree is built once, meets the data in some shards:
as many as make all pairs of blocks and shards the session's number of shuffle partitions. The
data of a shard pass its query block in chunks, group after group, and only the block's k best
leave the task, so that what is given out grows with the queries alone. A vector is sent once to
each block that may want it, to meet some ten thousands of queries there. Of equal vectors only
those take part that can be in a result.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do
those of an unusual length. Zero vectors take part. Ids may repeat or be null (such a row is a
candidate, last of its ties); a query leaves out its own row only. A score that doesn't fit 64
bits comes out null, its rank is exact (products are then made in whole numbers of any size,
where both sides are that large). With k candidates or fewer all are returned. Empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written
from lexloom.llm.vectors import best, contenders, matrix, taking_part


#: Stands for a null id, which is last of its ties.
LAST_ID = 2**63 - 1


@dataclass
class Node:
    """A ball: centre, radius that covers all rows of it, and its children or, in a leaf, rows."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, base: float = 1.3, leaf: int = 64) -> Node:
    """Cover tree over ``points[rows]``, whose root is the first of them."""
    rows = np.arange(len(points)) if rows is None else rows
    far = np.sqrt(((points[rows] - points[rows[0]]) ** 2).sum(axis=1))
    return _grow(points, rows, far, float(far.max()), base, leaf)


def _grow(points: np.ndarray, rows: np.ndarray, far: np.ndarray, level: float, base: float, leaf: int) -> Node:
    """``rows[0]`` is the centre, ``far`` the distances from it, ``level`` the radius that covers them."""
    node = Node(points[rows[0]], float(far.max()), rows)
    level = min(level, node.radius)
    while len(rows) > leaf and level > 0:
        level /= base
        left, away, groups = rows, far, []
        while len(left):
            near = away <= level
            groups.append((left[near], away[near]))
            left = left[~near]
            if len(left):
                # The next centre is the first point that no centre covers; it is moved to the front of its own.
                away = np.sqrt(((points[left] - points[left[0]]) ** 2).sum(axis=1))
        if len(groups) > 1:
            # Balls of few points are gathered in one leaf: they prune no better than their parent.
            small = [g for g in groups if len(g[0]) < leaf // 8]
            node.children = [_grow(points, r, d, level, base, leaf) for r, d in groups if len(r) >= leaf // 8]
            if small:
                loose = np.concatenate([r for r, _ in small])
                for at in range(0, len(loose), leaf):
                    part = loose[at : at + leaf]
                    middle = points[part].mean(axis=0)
                    node.children.append(Node(middle, float(np.sqrt(((points[part] - middle) ** 2).sum(axis=1)).max()), part))
            return node
    return node


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def most(a: np.ndarray, ra, b: np.ndarray, rb) -> np.ndarray:
    """Upper bounds of the inner products of members of balls (rows of ``a`` by rows of ``b``)."""
    na, nb = np.linalg.norm(a, axis=1)[:, None], np.linalg.norm(b, axis=1)[None, :]
    ra, rb = np.asarray(ra)[:, None], np.asarray(rb)[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        bound = a @ b.T + na * rb + nb * ra + ra * rb
        bound = bound + 1e-9 * (na * nb + 1) + 1e-9 * np.abs(bound)
    return np.where(np.isnan(bound), np.inf, bound)


def _float(x: int) -> float:
    """A double no greater than ``x``."""
    try:
        return float(np.nextafter(float(x), -np.inf))
    except OverflowError:
        return np.finfo(float).max if x > 0 else -np.inf


def floor_of(scores: np.ndarray, limit: int) -> np.ndarray:
    """Scores as doubles, below them where doubles are not exact."""
    if scores.dtype == object:
        return np.array([x if isinstance(x, float) else _float(x) for x in scores])
    scores = scores.astype(np.float64)
    return scores if limit < 2**53 else np.nextafter(scores, -np.inf)


_whole = np.vectorize(int, otypes=[object])


def products(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Exact inner products of integer rows: doubles if ``limit`` allows, else 64-bit integers, else integers of any size."""
    if limit < 2**53:
        return a @ b.T
    if limit < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), object)
    here = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    return _whole(products(a, b, here)) if here < 2**63 else _whole(a) @ _whole(b).T


class DualSearch:
    """The k best of a block of queries, over chunks of data that pass by."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int, limit: int):
        self.q, self.rows, self.k, self.limit = queries, rows, k, limit
        self.bound = bound.astype(np.float64)  # the k-th score so far, at least
        kind = np.float64 if limit < 2**53 else np.int64 if limit < 2**63 else object
        n = len(queries)
        self.scores, self.ids, self.found = np.zeros((n, 0), kind), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        self.have = np.zeros((n, 0), bool)
        self.tree = cover_tree(queries, leaf=32) if n else None
        self.pruned = self.compared = 0

    def pass_by(self, data: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        if len(data) and self.tree:
            self.data, self.drows, self.dids = data, rows, ids
            self.hits: list[tuple[np.ndarray, ...]] = []
            self._visit(self.tree, [cover_tree(data)])
            self._keep()

    def _visit(self, q: Node, nodes: list[Node]) -> None:
        """Drop data nodes that no query of ``q`` can want; then go down in both trees."""
        while True:
            bound = most(q.centre[None], [q.radius], np.array([d.centre for d in nodes]), [d.radius for d in nodes])[0]
            wanted = bound >= self.bound[q.rows].min()
            self.pruned += int((~wanted).sum())
            order = np.argsort(-bound, kind="stable")
            nodes = [nodes[i] for i in order if wanted[i]]
            if not nodes:
                return
            if q.children:
                down = [c for d in nodes for c in (d.children or [d])]
                for child in q.children:
                    self._visit(child, down)
                return
            if not any(d.children for d in nodes):
                break
            nodes = [c for d in nodes for c in (d.children or [d])]
        for at in range(0, len(nodes), 8):  # the most promising leaves first: they raise the bound for the others
            worst = self.bound[q.rows].min()
            some = [d for d in nodes[at : at + 8] if most(q.centre[None], [q.radius], d.centre[None], [d.radius])[0, 0] >= worst]
            if some:
                self._compare(q, np.concatenate([d.rows for d in some]))

    def _compare(self, q: Node, at: np.ndarray) -> None:
        self.compared += len(q.rows) * len(at)
        scores = products(self.q[q.rows], self.data[at], self.limit)
        self_pair = self.rows[q.rows][:, None] == self.drows[at][None, :]
        good = (scores >= self.bound[q.rows][:, None]) & ~self_pair
        i, j = np.nonzero(good)
        self.hits.append((q.rows[i], at[j], scores[i, j]))
        if len(at) > self.k:
            masked = np.where(self_pair, -np.inf, scores)
            kth = floor_of(np.partition(masked, len(at) - self.k, axis=1)[:, len(at) - self.k], self.limit)
            self.bound[q.rows] = np.maximum(self.bound[q.rows], kth)

    def _keep(self) -> None:
        """Merge the chunk's hits into each query's best, ties to smaller ids."""
        if not self.hits:
            return
        q, at, score = (np.concatenate(x) for x in zip(*self.hits))
        old, _ = np.nonzero(self.have)
        q = np.r_[old, q]
        score, ids, rows = np.r_[self.scores[self.have], score], np.r_[self.ids[self.have], self.dids[at]], np.r_[self.found[self.have], self.drows[at]]
        order = np.lexsort((rows, ids, -score, q))
        q, score, ids, rows = q[order], score[order], ids[order], rows[order]
        first = np.r_[True, q[1:] != q[:-1]]
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        top = rank < self.k
        n, width = len(self.q), self.k
        self.scores, self.ids, self.found, self.have = np.zeros((n, width), score.dtype), np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool)
        where = q[top], rank[top]
        self.scores[where], self.ids[where], self.found[where], self.have[where] = score[top], ids[top], rows[top], True
        full = self.have[:, -1]
        self.bound[full] = np.maximum(self.bound[full], floor_of(self.scores[full, -1], self.limit))

    def results(self):
        i, j = np.nonzero(self.have)
        return i, self.found[i, j], self.ids[i, j], self.scores[i, j]


def _scaled(scale: float):
    """floor(scale * x) as a double; from 2^53 on a double is whole as it is."""

    def of(x):
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return of


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, pivots: int = 64, sample: int = 1024, block: int = 65_536, chunk: int = 8192, seed: int = 3) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = taking_part(vectors, _scaled(scale), nonzero=False)
    facts = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("largest"), F.max(F.size("v")).alias("width")).first()
    if facts.width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    limit = facts.width * int(facts.largest) ** 2
    wide = limit >= 2**63
    data = written(contenders(rows, k))
    few = data.orderBy(F.xxhash64("row", F.lit(seed))).limit(sample).collect()
    seen, seen_rows = np.array([r.v for r in few]), np.array([r.row for r in few])
    centres = seen[:pivots]

    def grouped(is_query: bool):
        """Nearest pivot and distance of each row, and for queries the k-th score in the sample."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column("v"))
                n = batch.num_rows
                near, far, bound = np.zeros(n, np.int32), np.zeros(n), np.full(n, -np.inf)
                if n:
                    apart = (centres**2).sum(axis=1) - 2 * v @ centres.T
                    near = apart.argmin(axis=1).astype(np.int32)
                    far = np.sqrt(((v - centres[near]) ** 2).sum(axis=1))
                    if is_query and len(seen) > k:
                        scores = np.where(batch.column("row").to_numpy()[:, None] == seen_rows, -np.inf, products(v, seen, limit))
                        bound = floor_of(np.partition(scores, len(seen) - k, axis=1)[:, len(seen) - k], limit)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far), pa.array(bound)], names=["row", "vec_id", "v", "group", "far", "bound"])

        return run

    schema = "row long, vec_id long, v array<double>, group int, far double, bound double"
    data_groups = written(data.mapInArrow(grouped(False), schema))
    query_groups = written(rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(grouped(True), schema))
    # At most `pivots` groups on either side: their balls are compared on the driver.
    ball = [F.count("*").alias("n"), F.max("far").alias("radius"), F.min("bound").alias("worst")]
    d = sorted(data_groups.groupBy("group").agg(*ball).collect())
    q = sorted(query_groups.groupBy("group").agg(*ball).collect())
    if not q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    upper = most(centres[[x.group for x in q]], [x.radius for x in q], centres[[x.group for x in d]], [x.radius for x in d])
    wanted = upper >= np.array([x.worst for x in q])[:, None]
    # Query groups are packed into blocks of about `block` queries, large ones split by hash.
    parts, blocks, room, at = {}, {}, block, 0
    for i, x in enumerate(q):
        n = -(-x.n // block)
        if n > 1 or x.n > room:
            at, room = at + 1, block
        blocks[x.group] = (at, n)
        parts[at] = wanted[i] | parts.get(at, False)
        for s in range(1, n):
            parts[at + s] = wanted[i]
        at, room = (at + n, block) if n > 1 else (at, room - x.n)
    names = {b: i for i, b in enumerate(sorted(parts))}
    # Data groups lie along a line that is cut into shards of equal numbers of rows.
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = -(-tasks // len(parts))
    before = np.r_[0, np.cumsum([x.n for x in d])]
    along = {x.group: (before[j] * shards / before[-1], x.n * shards / before[-1]) for j, x in enumerate(d)}
    of_data = {x.group: [names[b] * shards for b in parts if parts[b][j]] for j, x in enumerate(d)}
    held = [{s for j, x in enumerate(d) if parts[b][j] for s in range(int(along[x.group][0]), min(shards - 1, int(sum(along[x.group]))) + 1)} for b in sorted(parts)]

    def deal(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group, row = batch.column("group").to_pylist(), batch.column("row").to_pylist()
                i, where = [], []
                for at, (g, r) in enumerate(zip(group, row)):
                    if is_query:
                        first, n = blocks[g]
                        b = names[first + r % n]
                        where += [b * shards + s for s in held[b]]
                    else:
                        low, size = along[g]
                        spread = (r * 0x9E3779B97F4A7C15 & (2**64 - 1)) / 2**64
                        where += [b + min(shards - 1, int(low + spread * size)) for b in of_data[g]]
                    i += [at] * (len(where) - len(i))
                for s in range(0, len(i), 4096):
                    w = where[s : s + 4096]
                    part = batch.select(["row", "vec_id", "v", "bound"]).take(pa.array(i[s : s + 4096], pa.int64()))
                    order = batch.column("group").take(pa.array(i[s : s + 4096], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(w, pa.int32()), pa.array([not is_query] * len(w), pa.bool_()), order], names=["row", "vec_id", "v", "bound", "task", "side", "group"])

        return run

    schema = "row long, vec_id long, v array<double>, bound double, task int, side boolean, group int"
    both = query_groups.mapInArrow(deal(True), schema).unionByName(data_groups.mapInArrow(deal(False), schema))
    digits = len(str(limit)) + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's queries come first; the data of a shard then pass in chunks, group by group."""
        asking, waiting, named = [], [], set()  # named: rows whose id is LAST_ID in truth
        at_work: tuple[DualSearch, pa.Table] | None = None

        def flush() -> None:
            nonlocal at_work
            if at_work is None and asking:
                t = pa.Table.from_batches(asking)
                at_work = (DualSearch(matrix(t.column("v").combine_chunks()), t.column("row").to_numpy(), t.column("bound").to_numpy(), k, limit), t)
            if waiting and at_work:
                t = pa.Table.from_batches(waiting)
                ids = t.column("vec_id")
                rows_, known = t.column("row").to_numpy(), ids.is_valid().to_numpy()
                ids = ids.fill_null(LAST_ID).to_numpy()
                named.update(rows_[known & (ids == LAST_ID)].tolist())
                at_work[0].pass_by(matrix(t.column("v").combine_chunks()), rows_, ids)
            waiting.clear()

        for batch in batches:
            n = int((~batch.column("side").to_numpy(zero_copy_only=False)).sum())
            if n:
                asking.append(batch.slice(0, n))
            if n < batch.num_rows:
                waiting.append(batch.slice(n))
                if sum(x.num_rows for x in waiting) >= chunk:
                    flush()
        flush()
        if at_work:
            i, rows_, ids, scores = at_work[0].results()
            take, none = pa.array(i), np.array([i == LAST_ID and r not in named for i, r in zip(ids.tolist(), rows_.tolist())], dtype=bool)
            whole = [int(x) for x in scores]
            key = [str(x + 10**digits).zfill(digits + 1) for x in whole] if wide else [None] * len(whole)
            arrays = [at_work[1].column(c).combine_chunks().take(take) for c in ("row", "vec_id")]
            arrays += [pa.array(rows_), pa.array(ids, mask=none), pa.array([x if -(2**63) <= x < 2**63 else None for x in whole], pa.int64()), pa.array(key, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "query_id", "row", "vec_id", "score", "key"])

    found_schema = "query long, query_id long, row long, vec_id long, score long, key string"
    found = both.repartitionById(len(parts) * shards, "task").sortWithinPartitions("side", "group", "row").mapInArrow(search, found_schema)
    return best(found, k, "key" if wide else "score")
