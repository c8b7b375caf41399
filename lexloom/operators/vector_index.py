"""An inverted file of vectors: lists around trained centroids, searched with exact scores.

Centroids are trained on a bounded sample (``sample`` rows by hash) of unit vectors; every row is
indexed, in the list of its nearest centroid. A list with more than ``most`` rows is split again
around members of its own; what can't be parted that way (equal vectors) lies in chunks of about
``most`` rows, and a query visits all chunks of a list. How many lists a query visits is calibrated:
the fewest that find ``recall`` of the true neighbours of a bounded set of rows asked by brute force.

A search deals the chunks into groups, a task each. A query goes to a group once, however many of its
lists lie there, and of each group only its ``limit`` best rows come back.

Rows that are null, zero, of another length or hold null or non-finite numbers aren't indexed.
Added rows join the lists as they are; :func:`build` anew when lists have grown too long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import search

#: Centroids, at most: they go to every task.
MOST_LISTS = 65_536
#: Groups of chunks that a search is dealt into, at least, and rows in a group, about.
GROUPS, GROUP_ROWS = 24, 65_536
#: Products of rows and centroids that are held at once, about.
PRODUCTS = 1 << 22


@dataclass(frozen=True)
class VectorIndex:
    """``rows(list, chunk, key, v)``, centroids by list, chunks of each list, and how many lists a query visits."""

    rows: DataFrame
    centroids: np.ndarray
    chunks: np.ndarray
    probes: int


def _unit(vectors: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """(key, v): unit vectors in double precision, of rows that take part."""
    v = F.col("vector").cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), v.alias("v")).where("v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    if width is not None:
        rows = rows.where(F.size("v") == width)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("n", norm).where("n > 0").select("key", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _trained(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows, begun at evenly spaced ones; lists that lose all rows keep their centroid."""
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    step = max(1, PRODUCTS // len(c))
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + step] @ c.T).argmax(axis=1) for i in range(0, len(x), step)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def _ranked_lists(x: np.ndarray, centroids: np.ndarray, probes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of rows, by their first, with the ``probes`` nearest lists of each, the nearest first."""
    step = max(1, PRODUCTS // len(centroids))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ centroids.T
        top = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        yield at, np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)


def _nearest(rows: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """``rows`` with ``lists``, the ``probes`` nearest ones, the nearest first."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "lists array<int>"])
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, top in _ranked_lists(_matrix(whole.column("v")), centroids, probes) if whole.num_rows else ():
                batch = whole.slice(at, len(top))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(top.ravel(), pa.int32()), probes).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    return rows.mapInArrow(run, schema)


def _first(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n)


def build(vectors: DataFrame, path: str, key: str, list_rows: int = 256, most: int = 4096, sample: int = 32_768, recall: float = 0.95, limit: int = 10, trials: int = 128, seed: int = 5) -> VectorIndex:
    """Write an index of ``vectors(key, vector)`` and calibrate it for the ``limit`` nearest."""
    spark = vectors.sparkSession
    first = _unit(vectors, key).select(F.size("v").alias("n")).first()
    unit = _unit(vectors, key, first.n if first else 0)
    unit.write.mode("overwrite").parquet(f"{path}/unit")
    unit = spark.read.parquet(f"{path}/unit")
    n = unit.count()
    lists = min(MOST_LISTS, max(1, -(-n // list_rows)))
    some = _matrix(_first(unit, max(sample, lists), seed).select("v").toArrow().column("v").combine_chunks()) if n else np.zeros((0, 1))
    centroids = _trained(some, lists) if n else np.zeros((1, 1))
    placed = _nearest(unit, centroids).select(F.col("lists")[0].alias("list"), "key", "v")
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()} if n else {}
    large = {i: c for i, c in counts.items() if c > most}
    if large and len(centroids) < MOST_LISTS:  # around members of their own, by a hash
        rate = F.create_map(*[F.lit(x) for i, c in large.items() for x in (i, min(1.0, 2 / most))])[F.col("list")]
        chance = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
        more = placed.where(F.col("list").isin(list(large))).where(chance < rate).orderBy(F.xxhash64("key")).limit(MOST_LISTS - len(centroids)).select("v").toArrow().column("v").combine_chunks()
        if len(more):
            centroids = np.unique(np.concatenate([centroids, _matrix(more)]), axis=0)
            placed = _nearest(unit, centroids).select(F.col("lists")[0].alias("list"), "key", "v")
            counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    chunks = np.array([max(1, -(-counts.get(i, 0) // most)) for i in range(len(centroids))], np.int64)
    _write(placed, chunks, f"{path}/rows", "overwrite")
    made = VectorIndex(spark.read.parquet(f"{path}/rows"), centroids, chunks, len(centroids))
    few = _first(unit, trials, seed + 2).select("key", F.col("v").alias("vector")).persist()
    probes = _calibrated(made, unit, few, limit, recall) if n else 1
    few.unpersist()
    spark.createDataFrame([(json.dumps({"centroids": centroids.tolist(), "chunks": chunks.tolist(), "probes": probes}),)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return VectorIndex(made.rows, centroids, chunks, probes)


def _write(placed: DataFrame, chunks: np.ndarray, path: str, mode: str) -> None:
    several = [F.lit(int(x)) for i in np.flatnonzero(chunks > 1) for x in (i, chunks[i])]
    of_list = F.coalesce(F.create_map(*several)[F.col("list").cast("int")], F.lit(1)) if several else F.lit(1)
    chunk = F.pmod(F.xxhash64("key"), of_list).cast("int")
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.withColumn("chunk", chunk).repartition(n, "list", "chunk").sortWithinPartitions("list", "chunk", "key").write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    facts = json.loads(spark.read.parquet(f"{path}/facts").first().facts)
    return VectorIndex(spark.read.parquet(f"{path}/rows"), np.array(facts["centroids"]), np.array(facts["chunks"]), facts["probes"])


def add(vectors: DataFrame, path: str, key: str) -> VectorIndex:
    """Rows that come later, into the lists there are; keys are new."""
    made = load(vectors.sparkSession, path)
    unit = _unit(vectors, key, made.centroids.shape[1])
    _write(_nearest(unit, made.centroids).select(F.col("lists")[0].alias("list"), "key", "v"), made.chunks, f"{path}/rows", "append")
    return load(vectors.sparkSession, path)


def _calibrated(made: VectorIndex, unit: DataFrame, few: DataFrame, limit: int, recall: float) -> int:
    """The fewest lists whose rows hold ``recall`` of the true neighbours of all trial rows together."""
    truth = search.top_dense(unit.select("key", F.col("v").alias("vector")), few.withColumnRenamed("key", "query_id"), limit, "key")
    home = _nearest(unit.join(truth.select("key").distinct(), "key", "left_semi"), made.centroids).select("key", F.col("lists")[0].alias("list"))
    ranked = _nearest(few.select(F.col("key").alias("query_id"), F.col("vector").alias("v")), made.centroids, len(made.centroids)).select("query_id", "lists")
    found = truth.select("query_id", "key").join(home, "key").join(ranked, "query_id")
    needed = sorted(r.n for r in found.select(F.array_position("lists", F.col("list")).alias("n")).collect())  # trials x limit numbers
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) if needed else 1


def searched(made: VectorIndex, queries: DataFrame, limit: int, query: str = "query_id", key: str = "key", probes: int | None = None) -> DataFrame:
    """``(query, key, score, rank)``: of the rows in the lists nearest to each query the ``limit`` best by exact cosine."""
    return search.ranked(_found(made, queries, limit, query, probes).select(F.col("query").alias(query), F.col("key").alias(key), "score"), limit, query, key)


def rows_read(made: VectorIndex, queries: DataFrame, query: str = "query_id", probes: int | None = None) -> DataFrame:
    """``(query, read)``: how many rows each query is compared with, those of all lists that it visits."""
    counts, centroids = np.zeros(len(made.centroids), np.int64), made.centroids
    for r in made.rows.groupBy("list").count().collect():  # MOST_LISTS, at most
        counts[r["list"]] = r["count"]
    n = min(probes or made.probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, top in _ranked_lists(_matrix(whole.column("v")), centroids, n) if whole.num_rows else ():
                yield pa.RecordBatch.from_arrays([whole.column("key").slice(at, len(top)), pa.array(counts[top].sum(axis=1))], names=["key", "read"])

    asked = _unit(queries, query, centroids.shape[1])
    each = asked.mapInArrow(run, f"key {queries.schema[query].dataType.simpleString()}, read long")
    return each.where("read > 0").groupBy(F.col("key").alias(query)).agg(F.sum("read").alias("read"))


def _visits(made: VectorIndex, queries: DataFrame, query: str, probes: int, groups: int) -> DataFrame:
    """``(group, query, lists, v)``: each query once for each group that holds rows of lists it visits, with these lists.

    A chunk's group is list + chunk modulo ``groups``.
    """
    centroids, chunks = made.centroids, np.minimum(made.chunks, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, top in _ranked_lists(_matrix(whole.column("v")), centroids, probes) if whole.num_rows else ():
                batch, flat = whole.slice(at, len(top)), top.ravel()
                times = chunks[flat]
                place = np.repeat(np.arange(len(flat)), times)
                chunk = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
                to = place // probes * groups + (flat[place] + chunk) % groups
                order = np.lexsort((flat[place], to))
                lists, to = flat[place][order], to[order]
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                for low in range(0, len(starts), 4096):  # a query's vector goes out once for each of its groups
                    some = starts[low : low + 4096]
                    end = starts[low + 4096] if low + 4096 < len(starts) else len(to)
                    who = batch.take(pa.array(to[some] // groups))
                    held = pa.ListArray.from_arrays(pa.array(np.r_[some, end] - some[0], pa.int32()), pa.array(lists[some[0] : end], pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(to[some] % groups, pa.int32()), who.column("key"), held, who.column("v")], names=["group", "query", "lists", "v"])

    kind = queries.schema[query].dataType.simpleString()
    return _unit(queries, query, centroids.shape[1]).mapInArrow(run, f"group int, query {kind}, lists array<int>, v array<double>")


def _found(made: VectorIndex, queries: DataFrame, limit: int, query: str, probes: int | None) -> DataFrame:
    """``(query, key, score)``: of each group, the ``limit`` best of the rows that a query visits there."""
    kinds = {"query": queries.schema[query].dataType, "key": made.rows.schema["key"].dataType}
    groups = max(GROUPS, -(-made.rows.count() // GROUP_ROWS))
    visits = _visits(made, queries, query, min(probes or made.probes, len(made.centroids)), groups).withColumn("side", F.lit(1))
    rows = made.rows.select(F.pmod(F.col("list") + F.col("chunk"), F.lit(groups)).cast("int").alias("group"), "list", "key", "v", F.lit(0).alias("side"))
    both = rows.unionByName(visits, allowMissingColumns=True)
    dealt = both.repartitionById(groups, F.col("group")).sortWithinPartitions("group", "side", "list", "key")
    return dealt.mapInArrow(_compared(limit), f"query {kinds['query'].simpleString()}, key {kinds['key'].simpleString()}, score double")


def _compared(limit: int):
    """Rows of a group come first, by list and key, then the queries that visit it."""

    def best(x: np.ndarray, bounds: dict[int, tuple[int, int]], place: np.ndarray, asked: np.ndarray, lists: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the best rows of each query, and which these are; ``place`` is each row's by key."""
        scores, rows = np.full((len(asked), limit), -np.inf), np.full((len(asked), limit), -1)
        order = np.argsort(lists, kind="stable")
        edges = np.flatnonzero(np.r_[True, lists[order][1:] != lists[order][:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            low, high = bounds.get(int(lists[order[a]]), (0, 0))
            for s in range(a, b, 512):
                mine = who[order[s : min(s + 512, b)]]
                for r in range(low, high, 1024):
                    near = asked[mine] @ x[r : min(r + 1024, high)].T
                    i, j = np.nonzero(near >= scores[mine, -1:] - 1e-9)
                    found, j = near[i, j], j + r
                    new, kth = np.round(found, 9), np.round(scores[mine[i], -1], 9)
                    ok = (new > kth) | ((new == kth) & (place[j] < place[rows[mine[i], -1]]))
                    if not ok.any():
                        continue
                    i, j, found = i[ok], j[ok], found[ok]
                    some = np.unique(i)
                    every = np.concatenate([np.repeat(some, limit), i])
                    values, names = np.concatenate([scores[mine[some]].ravel(), found]), np.concatenate([rows[mine[some]].ravel(), j])
                    by = np.lexsort((place[names], -np.round(values, 9), every))
                    starts = np.flatnonzero(np.r_[True, every[by][1:] != every[by][:-1]])
                    kept = by[starts[:, None] + np.arange(limit)]
                    scores[mine[some]], rows[mine[some]] = values[kept], names[kept]
        return scores, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, data = None, [], None
        for whole in batches:
            code = whole.column("group").to_numpy().astype(np.int64) * 2 + whole.column("side").to_numpy()
            edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else np.zeros(1, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                group, side = divmod(int(code[a]), 2)
                if group != here:
                    here, held, data = group, [], None
                part = whole.slice(a, b - a)
                if side == 0:
                    held.append(part.select(["list", "key", "v"]))
                    continue
                if data is None:
                    if not held:
                        continue
                    lot = pa.Table.from_batches(held).combine_chunks()
                    held, keys = [], lot.column("key").combine_chunks()
                    place = np.empty(len(keys), np.int64)
                    place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
                    number = lot.column("list").to_numpy()
                    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
                    bounds = {int(number[i]): (i, j) for i, j in zip(first[:-1].tolist(), first[1:].tolist())}
                    data = _matrix(lot.column("v").combine_chunks()), bounds, place, keys
                lists = part.column("lists")
                sizes = np.diff(lists.offsets.to_numpy())
                scores, rows = best(*data[:3], _matrix(part.column("v")), lists.flatten().to_numpy(), np.repeat(np.arange(b - a), sizes))
                i, j = np.nonzero(rows >= 0)
                yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(i)), data[3].take(pa.array(rows[i, j])), pa.array(scores[i, j])], names=["query", "key", "score"])

    return run
