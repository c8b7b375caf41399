"""Retrieval over many queries at once: BM25, dense, fusion, grouping, reranking.

Tables are long, with explicit ranks. Scores are ranked as they are (to nine places, so that the
order in which a sum was taken can't decide) and rounded to six where they are given out; every
tie goes to the smaller key. A filter of the corpus is applied before anything is ranked.

The store's formulas are ours: idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a term scores
idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), as often as the query has it; N, df and
avgdl are those of the whole corpus. Fusion adds 1 / (k + rank), ranks from 1.

Queries are a stated set, asked against all rows in blocks: of BM25, by shards of documents
(:mod:`lexloom.operators.postings`); of vectors, a batch of rows is scored for a block of queries
by one matrix product. A few queries go to the rows where these lie; of many, each task holds a block
and reads all rows, packed, in the order of their keys. What leaves a task is about ``limit`` rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.postings import B, K1, Index, searched

RRF_K, HINT_BOOST = 60, 1.5
#: So many queries are sent to the rows; more are dealt into ``DEALT`` blocks or more, of ``BLOCK`` at most. Rows that are scored at once.
FEW, DEALT, BLOCK, ROWS = 1024, 24, 32_768, 1024


class _Best:
    """Which rows of batches that pass by can be among each query's ``limit`` best."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.top = limit, np.full((queries, limit), -np.inf)

    def of(self, scores: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``who``) of (rows x queries ``who``) scores; minus infinity and NaN never.

        Only what reaches a query's ``limit``-th best so far is looked at again.
        """
        least = self.top[who].min(axis=1)
        q, i = np.nonzero((scores >= least - 1e-8 * np.maximum(1, np.abs(least))).T & np.isfinite(scores.T))
        places, starts = np.unique(q, return_index=True)
        for at, some in zip(places, np.split(i, starts[1:])):
            both = np.concatenate([self.top[who[at]], scores[some, at]])
            self.top[who[at]] = np.partition(both, len(both) - self.limit)[len(both) - self.limit :]
        least = self.top[who].min(axis=1)
        kept = scores[i, q] >= (least - 1e-8 * np.maximum(1, np.abs(least)))[q]
        return i[kept], q[kept]


def _masks(laws: list[list[str] | None]) -> Callable[[str | None], np.ndarray | None]:
    """For a row's law, which queries' filters leave it out; None where no query has a filter."""
    wanted = [set(x) if x else None for x in laws]
    some, seen = any(w is not None for w in wanted), {}

    def out(law: str | None) -> np.ndarray | None:
        if not some:
            return None
        if law not in seen:
            seen[law] = np.array([w is not None and law not in w for w in wanted], dtype=bool)
        return seen[law]

    return out


def _filters(queries: DataFrame) -> Column:
    return F.col("laws") if "laws" in queries.columns else F.lit(None).cast("array<string>")


def top_bm25(index: Index, queries: DataFrame, limit: int, query: str = "query_id", key: str = "doc_id", allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query, key, score, rank) of each query's ``limit`` best rows that share a term with it.

    ``queries(query, text)`` may have ``laws``, a filter of each query's own; ``allowed(key)`` is
    one for all. Only postings that can matter are read: :mod:`lexloom.operators.postings`.
    """
    found = searched(index, queries, limit, query, allowed, k1, b).where("key is not null").select("query", "key", "score")
    return ranked(found.withColumnsRenamed({"query": query, "key": key}), limit, query, key)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def top_dense(vectors: DataFrame, queries: DataFrame, limit: int, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """(query, key, score, rank) of each query's ``limit`` best rows by exact cosine in double precision.

    ``vectors(key, vector)`` may have ``law``, ``queries(query, vector)`` may have ``laws``. Rows of
    another length than the query's, and those that are null or zero, have no score.
    """
    kinds = {"query": dict(queries.dtypes)[query], "key": dict(vectors.dtypes)[key]}
    schema = f"query {kinds['query']}, key {kinds['key']}, score double"
    law = F.col("law").cast("string") if "law" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col(key).alias("key"), law.alias("law"), F.col("vector").alias("v"))
    asked = _numbers(queries.select(F.col(query).alias("query"), _filters(queries).alias("laws"), F.col("vector").alias("v")))
    some = asked.limit(FEW + 1).collect()
    if len(some) > FEW:
        scored = _dealt(_numbers(rows), asked, asked.count(), limit, kinds, schema)
    else:
        scored = _sent(rows, some, limit, kinds, schema)
    return ranked(scored.withColumnsRenamed({"query": query, "key": key}), limit, query, key)


def _numbers(rows: DataFrame) -> DataFrame:
    """Rows whose ``v`` is there as a whole; floats stay such, all others are doubles."""
    return _cast(rows).where("v is not null and size(v) > 0 and not exists(v, x -> x is null)")


def _cast(rows: DataFrame) -> DataFrame:
    kind = "array<float>" if dict(rows.dtypes)["v"] == "array<float>" else "array<double>"
    return rows.withColumn("v", F.col("v").cast(kind))


def _sent(rows: DataFrame, some: list, limit: int, kinds: dict[str, str], schema: str) -> DataFrame:
    """Candidates of a few queries, from the tasks that read the rows.

    Which rows count is decided there: a condition on ``v`` would go below what computes it, which would run once more for each.
    """
    asked = {}
    for width in sorted({len(r.v) for r in some}):
        mine = sorted((r for r in some if len(r.v) == width), key=lambda r: str(r.query))
        asked[width] = np.array([r.v for r in mine], np.float64).reshape(len(mine), width), [r.query for r in mine], [r.laws for r in mine]
    return _cast(rows).mapInArrow(_cosines(asked, limit, kinds["query"]), schema)


def _dealt(rows: DataFrame, asked: DataFrame, n: int, limit: int, kinds: dict[str, str], schema: str) -> DataFrame:
    """Each query's best, where a task holds a block of queries and all rows pass by, packed and by ascending key."""
    blocks = max(-(-n // BLOCK), min(DEALT, -(-n // (FEW // 2))))
    packs = _packs(rows.repartitionByRange(DEALT, "key").sortWithinPartitions("key"), "key", kinds["key"], "law", "string")
    packs = packs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), F.col("ids")[0].alias("first"), "width", "v", F.col("ids").alias("keys"), F.col("law").alias("row_laws"))
    asking = _packs(asked.repartition(blocks), "query", kinds["query"], "laws", "array<string>")
    asking = asking.select(F.pmod("task", F.lit(blocks)).alias("block"), F.lit(0).alias("side"), "width", "v", F.col("ids").alias("queries"), F.col("laws").alias("query_laws"))
    both = packs.unionByName(asking, allowMissingColumns=True)
    return both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side", "first").mapInArrow(_passing(limit, _arrow(kinds["query"]), _arrow(kinds["key"])), schema)


def _packs(rows: DataFrame, key: str, kind: str, law: str, law_kind: str) -> DataFrame:
    """``(task, width, ids, law, v)``: ``ROWS`` rows or fewer of one width in order, their vectors as bytes of doubles or floats."""
    single = dict(rows.dtypes)["v"] == "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                some = whole.slice(at, ROWS)
                sizes = np.diff(some.column("v").offsets.to_numpy())
                for width in np.unique(sizes).tolist():
                    batch = some.filter(pa.array(sizes == width))
                    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64)
                    yield pa.RecordBatch.from_arrays([batch.column("task").slice(0, 1), pa.array([width], pa.int32()), one(batch.column(key)), one(batch.column(law)), pa.array([x.tobytes()], pa.binary())], names=["task", "width", "ids", law, "v"])

    kept = rows.select(F.spark_partition_id().alias("task"), key, law, "v")
    packed = kept.mapInArrow(run, f"task int, width int, ids array<{kind}>, {law} array<{law_kind}>, v binary")
    return packed if not single else packed.withColumn("width", -F.col("width"))  # a negative width says floats


def _unpacked(width: int, v: pa.Scalar, count: int) -> np.ndarray:
    """Unit rows in double precision; those without a direction are NaN."""
    x = np.frombuffer(v.as_buffer(), np.float32 if width < 0 else np.float64).astype(np.float64).reshape(count, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Held:
    """The best rows so far of a block of queries of one width, where rows come by ascending key.

    A later row of an equal score can't get in. Products of floats tell which rows can, by a margin
    above their error; these are scored in double precision.
    """

    def __init__(self, limit: int, ids: list[pa.Array], laws: list, units: np.ndarray):
        self.limit, self.ids, self.laws = limit, ids, _masks(laws)
        self.x, self.short = units, units.astype(np.float32)
        self.margin = (units.shape[1] + 8) * 2.0**-22
        self.scores = np.full((len(units), limit), -np.inf)
        self.keys = np.empty((len(units), limit), dtype=object)

    def take(self, units: np.ndarray, keys: np.ndarray, laws: list) -> None:
        short = units.astype(np.float32).T
        masks = [(i, m) for i, m in enumerate(map(self.laws, laws)) if m is not None]
        for low in range(0, len(self.x), 512):
            high = min(low + 512, len(self.x))
            near = self.short[low:high] @ short
            for i, m in masks:
                near[m[low:high], i] = -np.inf
            q, r = np.nonzero(near >= (self.scores[low:high, -1:] - self.margin).astype(np.float32))
            if not len(q):
                continue
            if len(q) * 16 > near.size:
                found = (self.x[low:high] @ units.T)[q, r]
            else:
                found = np.concatenate([np.einsum("ij,ij->i", self.x[low + q[s : s + 65_536]], units[r[s : s + 65_536]]) for s in range(0, len(q), 65_536)])
            q = q + low
            rounded = np.round(found, 9)
            ok = np.isfinite(found) & np.isfinite(near[q - low, r]) & (rounded > np.round(self.scores[q, -1], 9))
            if ok.any():
                self._merge(q[ok], found[ok], rounded[ok], keys[r[ok]])

    def _merge(self, q: np.ndarray, found: np.ndarray, rounded: np.ndarray, keys: np.ndarray) -> None:
        """Those held come first among equal scores, and new ones come by ascending key."""
        who = np.unique(q)
        every = np.concatenate([np.repeat(who, self.limit), q])
        scores = np.concatenate([self.scores[who].ravel(), found])
        names = np.concatenate([self.keys[who].ravel(), keys])
        order = np.lexsort((-np.concatenate([np.round(self.scores[who].ravel(), 9), rounded]), every))  # stable
        every = every[order]
        starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        best = order[starts[:, None] + np.arange(self.limit)]
        self.scores[who], self.keys[who] = scores[best], names[best]

    def given(self, query_type: pa.DataType, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids)
        for low in range(0, len(self.x), 4096):
            q, j = np.nonzero(np.isfinite(self.scores[low : low + 4096]))
            q = q + low
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)).cast(query_type), pa.array(self.keys[q, j].tolist(), key_type), pa.array(self.scores[q, j])], names=["query", "key", "score"])


def _passing(limit: int, query_type: pa.DataType, key_type: pa.DataType):
    """Packs come sorted by block and side, queries first, and rows by key: gives each query's best when its block ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, held = None, {}, {}

        def settle() -> Iterator[pa.RecordBatch]:
            for x in held.values():
                yield from x.given(query_type, key_type)

        with np.errstate(all="ignore"):
            for batch in batches:
                for i, (block, side, width) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "side", "width")))):
                    if block != here:
                        yield from settle()
                        here, waiting, held = block, {}, {}
                    v, size = batch.column("v")[i], abs(width)
                    if side == 0:
                        ids = batch.column("queries")[i].values
                        waiting.setdefault(size, []).append((ids, batch.column("query_laws")[i].as_py(), _unpacked(width, v, len(ids))))
                        continue
                    if size in waiting:
                        ids, laws, units = zip(*waiting.pop(size))
                        held[size] = _Held(limit, list(ids), [x for some in laws for x in some], np.concatenate(units))
                    if size in held:
                        keys = batch.column("keys")[i].values.to_pylist()
                        names = np.empty(len(keys), dtype=object)
                        names[:] = keys
                        held[size].take(_unpacked(width, v, len(keys)), names, batch.column("row_laws")[i].as_py())
            yield from settle()

    return run


def _cosines(asked: dict[int, tuple[np.ndarray, list, list]], limit: int, kind: str):
    """Vectors of queries, their ids and laws by width: what can be among each query's best of the rows that pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(invalid="ignore", divide="ignore"):
            here = {width: (x / np.linalg.norm(x, axis=1, keepdims=True), pa.array(ids, type=_arrow(kind)), _masks(laws), _Best(len(ids), limit)) for width, (x, ids, laws) in asked.items()}
            for whole in batches:
                for at in range(0, whole.num_rows, 2 * ROWS):
                    batch = whole.slice(at, 2 * ROWS)
                    sizes = pc.list_value_length(batch.column("v")).fill_null(-1).to_numpy(zero_copy_only=False)
                    for width, mine in here.items():
                        yield from _scored(batch if (sizes == width).all() else batch.filter(pa.array(sizes == width)), width, *mine)

    return run


def _scored(batch: pa.RecordBatch, width: int, asked: np.ndarray, ids: pa.Array, left_out: Callable, best: _Best) -> Iterator[pa.RecordBatch]:
    """Rows of one width against the queries of that width; the rows of a law only against those that it's open to."""
    if not batch.num_rows:
        return
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # null numbers are NaN
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    laws = batch.column("law").dictionary_encode("encode")
    codes = laws.indices.to_numpy(zero_copy_only=False)
    for code, law in enumerate(laws.dictionary.to_pylist()):
        out = left_out(law)
        who = np.arange(len(asked)) if out is None else np.flatnonzero(~out)
        rows = np.flatnonzero(codes == code)
        if not len(who):
            continue
        scores = v[rows] @ asked[who].T
        i, q = best.of(scores, who)
        if len(i):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[q])), batch.column("key").take(pa.array(rows[i])), pa.array(scores[i, q])], names=["query", "key", "score"])


def ranked(scores: DataFrame, limit: int | None, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Rank from 1 by descending score, ties to the smaller key; the limit reaches below the shuffle."""
    order = W.partitionBy(query).orderBy(F.desc(F.round("score", 9)), F.asc(key))
    out = scores.withColumn("rank", F.row_number().over(order))
    out = out if limit is None else out.where(F.col("rank") <= limit)
    return out.withColumn("score", F.round("score", 6))


def fuse(channels: dict[str, DataFrame], limit: int, k: int = RRF_K, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of ranked channels; a single channel keeps its own scores."""
    if len(channels) == 1:
        return next(iter(channels.values())).select(query, key, "score", "rank").where(F.col("rank") <= limit)
    union = reduce(DataFrame.unionByName, [c.select(query, key, (1.0 / (k + F.col("rank"))).alias("part")) for c in channels.values()])
    fused = union.groupBy(query, key).agg(F.round(F.sum("part"), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), F.asc(key)))).where(F.col("rank") <= limit)


def with_channels(fused: DataFrame, channels: dict[str, DataFrame], query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Each fused hit with its rank and score in each channel, null where it isn't in one."""
    for name, c in channels.items():
        fused = fused.join(c.select(query, key, F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score")), [query, key], "left")
    return fused


def group_to_parents(hits: DataFrame, chunks: DataFrame, hints: DataFrame | None = None, query: str = "query_id", boost: float = HINT_BOOST) -> DataFrame:
    """Hits of chunks to parents: best child's score, once boosted where a hint is in the name, the chunks hit.

    ``chunks(chunk_id, parent_id, name)``; ``hints(query, hint)`` may have ``pos``: of several that
    fit, the first by it is the parent's ``hint``. Order: score, number of chunks, then the first
    place in ``hits``.
    """
    joined = hits.join(chunks, "chunk_id")
    parents = joined.groupBy(query, "parent_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("chunk_id")).alias("hit_chunks"), F.min("rank").alias("first"), F.first("name").alias("name"))
    hint = F.lit(None).cast("string").alias("hint")
    if hints is not None:
        place = F.col("pos") if "pos" in hints.columns else F.lit(0)
        listed = hints.groupBy(query).agg(F.transform(F.array_sort(F.collect_set(F.struct(place.alias("pos"), "hint"))), lambda x: x["hint"]).alias("hints"))
        fits = F.element_at(F.filter("hints", lambda h: F.contains(F.col("name"), h)), 1)
        parents = parents.join(listed, query, "left").withColumn("hint", F.when(F.exists(F.coalesce("hints", F.array().cast("array<string>")), lambda h: F.contains(F.col("name"), h)), fits)).drop("hints")
        parents = parents.withColumn("score", F.when(F.col("hint").isNotNull(), F.col("score") * boost).otherwise(F.col("score")))
    else:
        parents = parents.select("*", hint)
    order = W.partitionBy(query).orderBy(F.desc("score"), F.desc(F.size("hit_chunks")), "first")
    return parents.withColumn("rank", F.row_number().over(order))


def best_of_channel(channel: DataFrame, chunks: DataFrame, query: str = "query_id") -> DataFrame:
    """Each parent's best rank in a channel and that chunk's score."""
    joined = channel.join(chunks.select("chunk_id", "parent_id"), "chunk_id")
    return joined.groupBy(query, "parent_id").agg(F.min("rank").alias("best_rank"), F.min_by("score", F.struct("rank", "chunk_id")).alias("best_score"))


def overlap_score(question: Column, passage: Column) -> Column:
    """The stand-in reranker: share of the question's distinct terms that the passage has."""
    q = F.array_distinct(T.terms(question))
    return F.size(F.array_intersect(q, T.terms(passage))) / F.greatest(F.size(q), F.lit(1))


def rerank(hits: DataFrame, question: str, passage: str, top_n: int = 0, score: Column | None = None, query: str = "query_id") -> DataFrame:
    """Replace the scores of the first ``top_n`` (0: all) and sort them; the tail keeps its order below.

    ``hits`` has ``rank``; ``score`` is a column of a model's scores, by default the overlap.
    """
    new = score if score is not None else overlap_score(F.col(question), F.col(passage))
    inside = F.lit(True) if top_n == 0 else F.col("rank") <= top_n
    out = hits.withColumn("inside", inside).withColumn("score", F.when(F.col("inside"), new).otherwise(F.col("score")))
    order = W.partitionBy(query).orderBy(F.desc("inside"), F.when(F.col("inside"), -F.round("score", 9)), "rank")
    out = out.withColumn("new_rank", F.row_number().over(order)).withColumn("score", F.when(F.col("inside"), F.round("score", 6)).otherwise(F.col("score")))
    return out.drop("inside", "rank").withColumnRenamed("new_rank", "rank")
