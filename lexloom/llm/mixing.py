"""Mixing sources to target weights by a splitting tree over source block quotas.

Each document is cut into blocks of at most ``block_words`` words. A source's blocks lie in one
fixed random order, by a keyed hash; a source that is drawn more than once goes through that
order again. Its target says how many words are drawn; the draw that reaches the target is cut
there, so that each source's words come out exactly. The number of draws of each source is its
block quota. A binary tree over the output shards splits the quotas: at each node the left half
gets a multivariate hypergeometric share of them, down to single shards, so that every shard
gets its part of every source and all parts add up. Each shard draws its
quota of consecutive ranks of a source's order: disjoint, permuted blocks. What no shard's quota
reaches isn't drawn. Within a shard a second hash shuffles the draws.

The order of a source is held in ``cells`` hash ranges with running totals of words and blocks;
exact ranks need a sort within each cell only, so the hottest source is spread over all cells.

The driver holds the totals of each source and the quotas of each shard, never rows of documents.

Edge cases: a null text has size 0, and like an empty one it has no blocks, takes part in no
draw and comes out with ``taken`` 0. A null source is a source of its own, the last one. Rows
that repeat are documents of their own. Null ids are allowed. Old columns that clash with new
ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, slices, thrifty, words_in, written

#: Numbers in a table that is broadcast, at most.
SMALL = 1_000_000


def source_key(source: Column) -> Column:
    """A non-null key in the order of sources: by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: dict[str, int], weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> dict[str, float]:
    """Words to draw of each source: shares of the budget by weight, none above ``cap`` times its size."""
    keys = sorted(sizes)
    weight = {k: float(weights[i % len(weights)]) for i, k in enumerate(keys)}
    left, open_, out = budget * sum(sizes.values()), set(keys), {}
    while open_:
        total = sum(weight[k] for k in keys if k in open_)
        share = {k: left * weight[k] / total if total else 0.0 for k in keys if k in open_}
        over = [k for k in share if share[k] > cap * sizes[k]]
        if not over:
            out |= share
            break
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
            open_.discard(k)
    return {k: out[k] for k in keys}


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric draw by inversion, of counts past numpy's bound; exact but for the far tails' rounding."""
    low, high, total = max(0, n - bad), min(good, n), good + bad
    mean = n * good / total
    reach = 14 * np.sqrt(mean * (bad / total) * ((total - n) / max(1, total - 1))) + 60
    k = np.arange(max(low, int(mean - reach)), min(high, int(mean + reach)) + 1)
    a = k[:-1].astype(float)
    log = np.r_[0.0, np.cumsum(np.log(good - a) + np.log(n - a) - np.log(a + 1) - np.log(bad - n + a + 1))]
    chance = np.cumsum(np.exp(log - log.max()))
    return int(k[np.searchsorted(chance, rng.random() * chance[-1], side="right")])


def _take(rng: np.random.Generator, pool: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n`` from ``pool``."""
    if pool.sum() < 10**9:
        return rng.multivariate_hypergeometric(pool, n, method="marginals")
    out, total = np.zeros_like(pool), int(pool.sum())
    for i, have in enumerate(pool.tolist()):
        out[i] = _hypergeometric(rng, have, total - have, n) if have and n else 0
        n, total = n - int(out[i]), total - have
    return out


def shard_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Block quotas (shards x sources) that add up to ``quotas``; shards differ by one block at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while stack:
        low, high, pool = stack.pop()
        if high - low == 1:
            out[low] = pool
            continue
        middle, total = (low + high) // 2, int(pool.sum())
        size = total // (high - low)
        extra = total - size * (high - low)
        left = _take(rng, pool, size * (middle - low) + min(extra, middle - low))
        stack += [(low, middle, left), (middle, high, pool - left)]
    return out


def draws(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, block_words: int = 4096, shards: int = 64, cells: int = 4096, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(documents with ``row, size, source_size, target``; draws ``row, block, first, words, epoch, shard, place``).

    ``first`` is the block's first word in its document (from 0), ``words`` how many of it the
    draw takes, ``place`` its hash position in the shard. ``row`` names a row of this call.
    """
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")).withColumn("row", F.monotonically_increasing_id()).withColumn("key", source_key(F.col("source"))))
    blocks = (
        sized.where("size > 0")
        .select("row", "doc_id", "key", "size", "mark", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_words).cast("int"))).alias("block"))
        .withColumn("first", F.col("block").cast("long") * block_words)
        .withColumn("w", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("first")))
        .withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "mark", "block"))
        .withColumn("cell", F.pmod("u", F.lit(cells)).cast("int"))
    )
    per_cell = blocks.groupBy("key", "cell").agg(F.sum("w").alias("cell_words"), F.count("*").alias("cell_blocks"))
    before = W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    per_cell = written(per_cell.withColumn("words_before", F.coalesce(F.sum("cell_words").over(before), F.lit(0))).withColumn("blocks_before", F.coalesce(F.sum("cell_blocks").over(before), F.lit(0))))
    have = {r.key: (r.words, r.blocks) for r in per_cell.groupBy("key").agg(F.sum("cell_words").alias("words"), F.sum("cell_blocks").alias("blocks")).collect()}
    sizes = {r.key: have.get(r.key, (0, 0))[0] for r in sized.select("key").distinct().collect()}
    goal = targets(sizes, weights, budget, cap)
    facts = [(k, sizes[k], goal[k], min(round(goal[k]), round(cap * sizes[k])), have.get(k, (0, 0))[1]) for k in sizes]
    per_source = spark.createDataFrame(facts, "key string, source_size long, target double, quota long, blocks long")
    if len(facts) <= SMALL:  # else the joins by source are left to adaptive execution
        per_source = F.broadcast(per_source)

    inside = W.partitionBy("key", "cell").orderBy("u", "doc_id", "size", "mark", "block").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        blocks.withColumn("words_in_cell", F.coalesce(F.sum("w").over(inside), F.lit(0)))
        .withColumn("rank_in_cell", F.coalesce(F.count("*").over(inside), F.lit(0)))
        .join(per_cell.select("key", "cell", "words_before", "blocks_before"), ["key", "cell"])
        .join(per_source, "key")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("quota") / F.col("source_size")).cast("int") - 1))))
        .withColumn("start", F.col("words_before") + F.col("words_in_cell") + F.col("epoch") * F.col("source_size"))
        .withColumn("rank", F.col("blocks_before") + F.col("rank_in_cell") + F.col("epoch") * F.col("blocks"))
        .withColumn("words", F.least(F.col("w"), F.col("quota") - F.col("start")))
    )
    # How many draws each source has: whole rounds, and the blocks of the last one that begin before its quota.
    cut = {}
    last = per_cell.join(per_source, "key").withColumn("rest", F.col("quota") % F.col("source_size"))
    edge = last.where("words_before < rest and rest < words_before + cell_words").select("key", "cell")
    if len(facts) <= SMALL:  # one cell of each source at most
        edge = F.broadcast(edge)
    inner = placed.where("words > 0").join(edge, ["key", "cell"])
    for r in inner.groupBy("key").agg(F.max("rank").alias("rank")).collect():
        cut[r.key] = r.rank + 1
    whole = {r.key: r.n for r in last.where("words_before + cell_words <= rest").groupBy("key").agg(F.max(F.col("blocks_before") + F.col("cell_blocks")).alias("n")).collect()}
    order = sorted(sizes)
    quotas = []
    for k, size, _, quota, n in sorted(facts):
        rounds = quota // size if size else 0
        quotas.append(max(cut.get(k, 0), rounds * n + whole.get(k, 0)))
    split = shard_quotas(quotas, shards, seed)
    ends = np.cumsum(split, axis=0)
    bounds = spark.createDataFrame([(k, ends[:, i].tolist()) for i, k in enumerate(order)], "key string, ends array<bigint>")
    if len(order) * shards <= SMALL:
        bounds = F.broadcast(bounds)
    drawn = (
        placed.join(bounds, "key")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
        .where(F.col("shard") < shards)  # a rank past every shard's quota is drawn by none
        .withColumn("place", F.xxhash64(F.lit(seed + 1), "u", "epoch"))
        .select("row", "doc_id", "block", "first", "words", "epoch", "shard", "place")
    )
    return sized.join(per_source.select("key", "source_size", "target"), "key"), drawn


_WORDS = re.compile(WORD)


def cut_out(text: str, size: int, drawn: Sequence[tuple[int, int]]) -> str:
    """The words [first, first + n) of each draw, runs that touch as they stand; all of them: the text itself."""
    drawn = sorted(drawn)
    if sum(n for _, n in drawn) == size:
        return text
    spans = [m.span() for m in _WORDS.finditer(text)]
    runs: list[list[int]] = []
    for first, n in drawn:
        if runs and runs[-1][1] == first:
            runs[-1][1] += n
        else:
            runs.append([first, first + n])
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)


def drawn_documents(docs: DataFrame, shards: int = 64, places: bool = False, **options) -> DataFrame:
    """The mix itself: a row for each time that a document is drawn, with the words drawn of it.

    Rows lie by shard, and in each shard in the order of their places; ``places`` adds the columns
    ``shard`` and ``place``. Blocks of a document that fall to several shards make a row in each.
    Columns are those of ``docs``; ``n_chars``, if there, is the new text's length. A document drawn
    in full twice comes out twice. Rows that are equal in id, source and text share their draws.
    Texts travel to their shards compressed by zstd, one by one.
    """
    facts, drawn = draws(docs, shards=shards, **options)
    keyed = facts.select("row", "doc_id", "key", "size", "mark")
    per = drawn.drop("doc_id").join(keyed, "row").groupBy("doc_id", "key", "mark", "size").agg(F.collect_list(F.struct("row", "epoch", "shard", "place", "first", "words")).alias("__drawn"))
    per = per.select(F.struct("doc_id", "key", "mark").alias("__k"), F.col("size").alias("__size"), "__drawn")
    # Equal types down to what may be null: a cast in the join would shuffle the texts once more.
    key = F.struct("doc_id", source_key(F.col("source")).alias("key"), F.xxhash64("text").alias("mark")).cast(per.schema["__k"].dataType)
    left = docs.withColumn("__k", key).dropDuplicates(["__k"])
    names = docs.columns
    types = {c: docs.schema[c].dataType.simpleString() for c in names}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "__shard int, __place bigint"])
    packed_schema = ", ".join([*(f"`{c}` {'binary' if c == 'text' else t}" for c, t in types.items()), "__shard int, __place bigint, __bytes bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, sizes, lists = (batch.column(c).to_pylist() for c in ("text", "__size", "__drawn"))
                at, out, shard, place = [], [], [], []
                for i, (text, size, drawn_) in enumerate(zip(texts, sizes, lists)):
                    times: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
                    first: dict[tuple[int, int, int], int] = {}
                    for d in drawn_:
                        key = d["row"], d["epoch"], d["shard"]
                        times.setdefault(key, []).append((d["first"], d["words"]))
                        first[key] = min(first.get(key, d["place"]), d["place"])
                    for key in sorted(times):
                        at.append(i)
                        out.append(cut_out(text, size, times[key]))
                        shard.append(key[2])
                        place.append(first[key])
                raw = [t.encode() for t in out]
                new = {"text": pa.array([codec.compress(b, asbytes=True) for b in raw], pa.binary()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
                columns = [new[c] if c in new else batch.column(c).take(pa.array(at, pa.int64())) for c in names]
                where = [pa.array(shard, pa.int32()), pa.array(place, pa.int64()), pa.array([len(b) for b in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *where], names=[*names, "__shard", "__place", "__bytes"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for whole in batches:
            for batch in slices(whole, "__bytes"):
                packed, sizes = batch.column("text").to_pylist(), batch.column("__bytes").to_pylist()
                texts = pa.array([codec.decompress(b, n, asbytes=True) for b, n in zip(packed, sizes)], pa.binary()).cast(pa.string())
                columns = [texts if c == "text" else batch.column(c) for c in [*names, "__shard", "__place"]]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "__shard", "__place"])

    # A struct is never null, and null fields of two structs are equal.
    joined = left.join(per, left["__k"] == per["__k"]).select(*[left[f"`{c}`"] for c in names], "__size", "__drawn")
    # Places are spread evenly, so equal lengths of (shard, place) make equal partitions.
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = (F.col("__shard") + F.col("__place") / F.lit(2.0**64) + 0.5) / shards
    packed = joined.mapInArrow(thrifty(run), packed_schema)
    dealt = packed.repartitionById(n, F.least(F.lit(n - 1), F.floor(share * n).cast("int"))).sortWithinPartitions("__shard", "__place").mapInArrow(thrifty(unpack), schema)
    out = [F.col(f"`{c}`") for c in names if not places or c not in ("shard", "place")]
    return dealt.select(*out, *[F.col(f"__{c}").alias(c) for c in ("shard", "place") if places])


def mix(docs: DataFrame, **options) -> DataFrame:
    """Each document with its size, its source's size and target, the words that the shards draw of it, and how many do."""
    facts, drawn = draws(docs, **options)
    taken = drawn.groupBy("row").agg(F.sum("words").alias("taken"), F.size(F.collect_set("shard")).alias("shards"))
    return facts.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit(0)).alias("shards"))
