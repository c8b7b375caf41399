"""BM25 over an index of document shards, whose postings lie in blocks with bounds.

A shard is a run of documents of one task. For each of its terms it holds one row: the places of
the term's documents in the shard, ascending, their counts, and for each block of ``BLOCK`` of
them the largest impact tf (k1 + 1) / (tf + k1 (1 - b + b dl / mean)). A shard's head row holds
its documents' keys, lengths and laws. Terms are counted where the documents are read, so building
shuffles nothing; a shard ends at ``shard_tokens`` terms or ``shard_documents`` documents.

The mean length of the whole corpus isn't known while a shard is built: its bounds use the shard's
own. Where the corpus's is larger by a factor, no impact grows by more than that factor, so
bounds times max(1, mean / shard's mean) hold.

A search sends the shards' rows of the asked terms, with the queries' weights, to the task of their
shard and block of queries. There each query's terms are taken by descending bound. Whole lists are
read while a document without a score so far could still be among the ``limit`` best; then only
documents that can still be, and of a list only the blocks that hold one of them and whose bound
leaves it in reach. The k-th score found so far is kept from shard to shard of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.functions import text as T

K1, B = 1.2, 0.75
#: Postings in a block.
BLOCK = 64
#: After how many of its terms a query's leading documents are scored in full, and how many times ``limit`` of them.
_LOOKS, LEADING = (3, 8, 15), 3
#: Pairs of query and term in a block of queries, about.
PAIRS = 50_000
#: Rows of a table that is sent to all tasks, at most.
SMALL = 200_000


@dataclass(frozen=True)
class Index:
    """Shards, terms ``(term, df)``, the number of documents and their mean length.

    ``postings(shard, term, n, docs, tfs, bounds)``; ``heads(shard, keys, lengths, laws, mean)``,
    which may have ``dead``, places of documents that don't count any more.
    """

    postings: DataFrame
    heads: DataFrame
    terms: DataFrame
    documents: int
    mean_length: float
    shards: int = 1


def impacts(tf: np.ndarray, length: np.ndarray, mean: float, k1: float = K1, b: float = B) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(mean, 1e-9)))


def _shard(number: int, keys: pa.Array, laws: pa.Array, terms: pa.ListArray, names: list[str], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its head, then its terms in order."""
    lengths = np.diff(terms.offsets.to_numpy())
    mean = max(float(lengths.mean()), 1e-9)
    none = lambda t: pa.nulls(1, t)
    ints, floats = pa.list_(pa.int32()), pa.list_(pa.float64())
    one = lambda a, t: pa.array([a.to_pylist()], pa.list_(t))
    head = [pa.array([number], pa.int64()), none(pa.string()), none(pa.int32()), none(ints), none(ints), none(floats), one(keys, key_type), pa.array([lengths.tolist()], ints), one(laws, pa.string()), pa.array([mean])]
    yield pa.RecordBatch.from_arrays(head, names=names)
    encoded = terms.flatten().dictionary_encode()
    if not len(encoded):
        return
    order = pc.sort_indices(encoded.dictionary).to_numpy()  # by bytes of UTF-8
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pair, tf = np.unique(rank[encoded.indices.to_numpy()] * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    term, doc = np.divmod(pair, len(lengths))
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    sizes = np.diff(np.r_[starts, len(term)])
    impact = impacts(tf, lengths[doc], mean)
    blocks = -(-sizes // BLOCK)
    first_block = np.r_[0, np.cumsum(blocks)]
    at = np.repeat(starts, blocks) + (np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)) * BLOCK
    bounds = np.maximum.reduceat(impact, at) * (1 + 1e-12)
    offsets = np.r_[starts, len(term)]
    words = encoded.dictionary.take(pa.array(order))
    for low in range(0, len(starts), 8192):
        high = min(low + 8192, len(starts))
        lists = []
        for values, ends, kind in ((doc, offsets, pa.int32()), (tf, offsets, pa.int32()), (bounds, first_block, pa.float64())):
            inside = values[ends[low] : ends[high]]
            lists.append(pa.ListArray.from_arrays(pa.array(ends[low : high + 1] - ends[low], pa.int32()), pa.array(inside, kind)))
        m = high - low
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number), pa.int64()), words.slice(low, m), pa.array(sizes[low:high], pa.int32()), *lists, pa.nulls(m, pa.list_(key_type)), pa.nulls(m, ints), pa.nulls(m, pa.list_(pa.string())), pa.nulls(m, pa.float64())], names=names)


def shards(docs: DataFrame, key: str, text: str = "text", law: str | None = None, generation: int = 0, shard_tokens: int = 2_000_000, shard_documents: int = 65_536) -> DataFrame:
    """Heads (``term`` null) and postings of shards, each task's in order.

    Shards are numbered by generation, task and order, so numbers of other generations don't clash.
    """
    kind = docs.schema[key].dataType
    key_type = to_arrow_type(kind)
    listed = docs.select(F.col(key).alias("key"), (F.lit(None) if law is None else F.col(law)).cast("string").alias("law"), F.coalesce(T.terms(F.col(text)), F.array().cast("array<string>")).alias("ts"), F.spark_partition_id().alias("task"))
    schema = f"shard long, term string, n int, docs array<int>, tfs array<int>, bounds array<double>, keys array<{kind.simpleString()}>, lengths array<int>, laws array<string>, mean double"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tokens = rows = number = 0

        def done() -> Iterator[pa.RecordBatch]:
            lot = pa.Table.from_batches(held).combine_chunks()
            task = lot.column("task")[0].as_py()
            held.clear()
            keys, laws, terms = (lot.column(c).combine_chunks() for c in ("key", "law", "ts"))
            del lot
            yield from _shard(generation << 44 | task << 20 | number, keys, laws, terms, names, key_type)
            del keys, laws, terms
            pa.default_memory_pool().release_unused()  # else what a shard took stays with the worker

        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole.column("ts")).to_numpy())
            low = 0
            while low < whole.num_rows:  # as many rows as the shard still takes, one at least
                before = ends[low - 1] if low else 0
                high = min(int(np.searchsorted(ends, before + shard_tokens - tokens, "right")), low + shard_documents - rows, whole.num_rows)
                if high <= low and not held:
                    high = low + 1
                if high > low:
                    held.append(whole.slice(low, high - low))
                    tokens, rows, low = tokens + int(ends[high - 1] - before), rows + high - low, high
                if low < whole.num_rows:
                    yield from done()
                    held, tokens, rows, number = [], 0, 0, number + 1
        if held:
            yield from done()

    return listed.mapInArrow(run, schema)


def terms_of(written: DataFrame) -> DataFrame:
    """(term, df): in how many documents of written shards a term is."""
    return written.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))


def facts(written: DataFrame) -> tuple[int, int, int]:
    """How many documents, terms in them and shards there are in written shards."""
    words = F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    r = written.where("term is null").agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)).alias("n"), words.alias("words"), F.count("*").alias("shards")).first()
    return r.n, r.words or 0, r.shards


def index_of(written: DataFrame, terms: DataFrame | None = None, counts: tuple[int, float, int] | None = None) -> Index:
    """An index over written shards; its terms and lengths are computed where they aren't given."""
    posted = written.where("term is not null").select("shard", "term", "n", "docs", "tfs", "bounds")
    heads = written.where("term is null").select("shard", "keys", "lengths", "laws", "mean")
    if counts is None:
        documents, words, many = facts(written)
        counts = documents, words / max(1, documents), many
    return Index(posted, heads, terms if terms is not None else terms_of(written), *counts)


def _of_law(laws: list[str | None], wanted: list[list[str] | None]) -> list[np.ndarray | None]:
    """For each query, which of the shard's documents its filter lets through; None where it has none."""
    column, seen = np.array([x if x is not None else "\0" for x in laws], dtype=object), {}
    out = []
    for w in wanted:
        if not w:
            out.append(None)
            continue
        name = tuple(sorted(w))
        if name not in seen:
            seen[name] = np.isin(column, list(name))
        out.append(seen[name])
    return out


class _Shard:
    """One shard's rows for one block of queries."""

    def __init__(self, head: dict, average: float, k1: float, b: float, own_bounds: bool):
        self.lengths = np.asarray(head["lengths"].values, np.float64)
        self.norm = k1 * (1 - b + b * self.lengths / max(average, 1e-9))
        self.k1, self.bounded = k1, own_bounds
        self.grow = max(1.0, average / head["mean"].as_py())
        self.live = np.ones(len(self.lengths), dtype=bool)
        if head["dead"].is_valid:
            self.live[np.asarray(head["dead"].values, np.int64)] = False
        if head["open"].is_valid:
            some = np.zeros(len(self.lengths), dtype=bool)
            some[np.asarray(head["open"].values, np.int64)] = True
            self.live &= some
        self.lists: list[list] = []

    def add(self, docs: np.ndarray, tfs: np.ndarray, bounds: np.ndarray) -> int:
        bounds = bounds * self.grow if self.bounded else np.full(len(bounds), self.k1 + 1)
        self.lists.append([docs, tfs, bounds, float(bounds.max()), None])
        return len(self.lists) - 1

    def parts(self, t: int) -> np.ndarray:
        entry = self.lists[t]
        if entry[4] is None:
            docs, tf = entry[0], entry[1]
            entry[4] = tf * (self.k1 + 1) / (tf + self.norm[docs])
        return entry[4]

    def some_parts(self, t: int, at: np.ndarray) -> np.ndarray:
        docs, tfs, _, _, whole = self.lists[t]
        return whole[at] if whole is not None else tfs[at] * (self.k1 + 1) / (tfs[at] + self.norm[docs[at]])

    def best(self, terms: list[tuple[int, float]], limit: int, least: float, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read): all that can be among the ``limit`` best given that ``least`` is reached."""
        terms = sorted(terms, key=lambda x: -x[1] * self.lists[x[0]][3])
        reach = np.array([w * self.lists[t][3] for t, w in terms])
        rest = np.append(np.cumsum(reach[::-1])[::-1], 0.0)
        ok = self.live if allowed is None else self.live & allowed
        scores, read, j = np.zeros(len(ok)), 0, 0
        below = lambda x: x - 1e-8 * max(1.0, abs(x))
        while j < len(terms) and rest[j] >= below(least):
            t, w = terms[j]
            scores[self.lists[t][0]] += w * self.parts(t)
            read, j = read + len(self.lists[t][0]), j + 1
            if j in _LOOKS and j < len(terms):
                # The documents that lead by now are scored in full: their k-th score is one that counts.
                leading = np.flatnonzero(ok & (scores > 0))
                if len(leading) > LEADING * limit:
                    leading = np.sort(leading[np.argpartition(scores[leading], -LEADING * limit)[-LEADING * limit :]])
                full, more = self._completed(leading, scores[leading], terms[j:])
                least, read = max(least, _kth(full, limit)), read + more
        scores[~ok] = 0.0
        left = np.flatnonzero(scores > 0)
        if j < len(terms):
            least = max(least, _kth(scores[left], limit))
            left = left[scores[left] + rest[j] >= below(least)]
        for j in range(j, len(terms)):
            t, w = terms[j]
            docs, _, bounds, _, _ = self.lists[t]
            block = np.searchsorted(docs[::BLOCK], left, "right") - 1
            can = scores[left] + np.where(block >= 0, w * bounds[np.maximum(block, 0)], 0.0) + rest[j + 1] >= below(least)
            left, block = left[can], block[can]
            if not len(left):
                break
            read += min(len(docs), len(left))
            at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
            hit = docs[at] == left
            scores[left[hit]] += w * self.some_parts(t, at[hit])
            least = max(least, _kth(scores[left], limit))
            left = left[scores[left] + rest[j + 1] >= below(least)]
        if len(left) > limit:
            left = left[scores[left] >= below(_kth(scores[left], limit))]
        return left, scores[left], read


    def _completed(self, docs: np.ndarray, scores: np.ndarray, terms: list[tuple[int, float]]) -> tuple[np.ndarray, int]:
        """Scores with those of more terms added, and the postings in the blocks that were read for it."""
        scores, read = scores.copy(), 0
        for t, w in terms:
            places = self.lists[t][0]
            at = np.minimum(np.searchsorted(places, docs), len(places) - 1)
            hit = places[at] == docs
            scores[hit] += w * self.some_parts(t, at[hit])
            read += min(len(places), len(docs))
        return scores, read


def _kth(scores: np.ndarray, k: int) -> float:
    """The k-th largest positive score; minus infinity if there are fewer."""
    if len(scores) < k:
        return -np.inf
    x = np.partition(scores, len(scores) - k)[len(scores) - k]
    return float(x) if x > 0 else -np.inf


def searched(index: Index, queries: DataFrame, limit: int, query: str, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``(query, key, score)`` of rows that can be among a query's best, ``read`` and ``of`` null; and for
    each query and shard a row without ``key``: how many postings were ``read`` ``of`` those of its terms.
    """
    spark = queries.sparkSession
    kinds = {"query": queries.schema[query].dataType, "key": index.heads.schema["keys"].dataType.elementType}
    query_type, key_type = (to_arrow_type(kinds[c]) for c in ("query", "key"))
    laws = F.col("laws") if "laws" in queries.columns else F.lit(None).cast("array<string>")
    asked = queries.select(F.col(query).alias("query"), laws.alias("laws"), F.explode_outer(T.terms(F.col("text"))).alias("term")).where("term is not null").groupBy("query", "laws", "term").agg(F.count("*").alias("qtf"))
    pairs = asked.count()
    n = index.documents
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Blocks of PAIRS, or smaller ones where there are fewer shards than tasks.
    blocks = max(1, -(-pairs // PAIRS), min(-(-pairs // 1000), count // max(1, index.shards)))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    weighed = asked.select(block, "query", "laws", "term", "qtf")
    few = pairs <= SMALL
    small = F.broadcast if few else (lambda df: df)  # beyond that, adaptive execution decides
    known = index.terms.join(small(weighed.select("term").distinct()), "term", "left_semi")
    weighed = weighed.join(small(known) if few else known, "term").select("block", "query", "laws", "term", (F.col("qtf") * idf).alias("weight"))
    by_term = weighed.groupBy("block", "term").agg(F.collect_list(F.struct("query", "laws", "weight")).alias("asking"))
    posted = index.postings.join(small(by_term), "term").select("block", "shard", F.lit(1).alias("kind"), "docs", "tfs", "bounds", "asking")
    heads = index.heads
    if "dead" not in heads.columns:
        heads = heads.withColumn("dead", F.lit(None).cast("array<int>"))
    if allowed is None:
        heads = heads.withColumn("open", F.lit(None).cast("array<int>"))
    else:
        placed = heads.select("shard", F.posexplode("keys").alias("place", "key"))
        found = placed.join(allowed.select(F.col(allowed.columns[0]).alias("key")).distinct(), "key", "left_semi").groupBy("shard").agg(F.collect_list("place").alias("open"))
        heads = heads.join(found, "shard", "left").withColumn("open", F.coalesce("open", F.array().cast("array<int>")))
    asking_type = posted.schema["asking"].dataType.simpleString()
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    heads = heads.select(every, "shard", F.lit(0).alias("kind"), "keys", "lengths", "laws", "mean", "dead", "open")
    both = heads.unionByName(posted, allowMissingColumns=True).withColumn("asking", F.col("asking").cast(asking_type))
    dealt = both.repartition(count, "block", "shard").sortWithinPartitions("block", "shard", "kind")
    average, own = index.mean_length, (k1, b) == (K1, B)
    schema = f"query {kinds['query'].simpleString()}, key {kinds['key'].simpleString()}, score double, read long, of long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}  # the best scores of each query so far
        here, shard, keys, shard_laws = None, None, None, None
        queries_: dict = {}

        def settle() -> Iterator[pa.RecordBatch]:
            if shard is None or not queries_:
                return
            names = list(queries_)
            masks = _of_law(shard_laws.values.to_pylist(), [list(x[1]) if x[1] else None for x in names])
            who, where, values, reads, ofs = [], [], [], [], []
            for name, mask in zip(names, masks):
                top = least.get(name, np.zeros(0))
                found, scores, read = shard.best(queries_[name], limit, float(top[0]) if len(top) == limit else -np.inf, mask)
                least[name] = np.sort(np.concatenate([top, scores]))[-limit:]
                who.append(len(found))
                where.append(found)
                values.append(scores)
                reads.append(read)
                ofs.append(sum(len(shard.lists[t][0]) for t, _ in queries_[name]))
            ids = pa.array([x[0] for x in names], query_type)
            at, m = np.concatenate(where), len(names)
            total = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids.take(pa.array(np.repeat(np.arange(m), who))), ids]),
                    pa.concat_arrays([keys.values.take(pa.array(at)), pa.nulls(m, key_type)]),
                    pa.concat_arrays([pa.array(np.concatenate(values)), pa.nulls(m, pa.float64())]),
                    pa.concat_arrays([pa.nulls(total, pa.int64()), pa.array(reads, pa.int64())]),
                    pa.concat_arrays([pa.nulls(total, pa.int64()), pa.array(ofs, pa.int64())]),
                ],
                names=["query", "key", "score", "read", "of"],
            )

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            places = list(zip(columns["block"].to_pylist(), columns["shard"].to_pylist(), columns["kind"].to_pylist()))
            asking = columns["asking"]
            flat = asking.flatten()
            fields = [flat.field(c).to_pylist() for c in ("query", "laws", "weight")] if len(flat) else [[], [], []]
            ends = asking.offsets.to_numpy() - asking.offsets[0].as_py()
            lists = {c: (columns[c].flatten().to_numpy(), columns[c].offsets.to_numpy() - columns[c].offsets[0].as_py()) for c in ("docs", "tfs", "bounds")}
            for i, (block, number, kind) in enumerate(places):
                if (block, number) != here:
                    yield from settle()
                    if here is None or here[0] != block:
                        least = {}
                    here, queries_ = (block, number), {}
                if kind == 0:
                    shard = _Shard({c: columns[c][i] for c in ("lengths", "mean", "dead", "open")}, average, k1, b, own)
                    keys, shard_laws = columns["keys"][i], columns["laws"][i]
                    continue
                t = shard.add(*(values[e[i] : e[i + 1]] for values, e in (lists["docs"], lists["tfs"], lists["bounds"])))
                for at in range(ends[i], ends[i + 1]):
                    name = fields[0][at], tuple(fields[1][at]) if fields[1][at] is not None else None
                    queries_.setdefault(name, []).append((t, fields[2][at]))
        yield from settle()

    return dealt.mapInArrow(run, schema)
