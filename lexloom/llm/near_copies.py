"""Near copies: documents whose sets of word shingles have a Jaccard similarity of ``least`` or more.

Candidates come from SimHash: fingerprints that differ in ``TAU`` bits or fewer, found by the
generalised pigeonhole principle (:mod:`lexloom.llm.simhash`). At a similarity of 0.8 two fingerprints
differ in 9.7 bits on average, so more candidates come from ``BANDS`` independent keys of ``ROWS``
smallest hashes each: two sets of similarity J share a key with probability 1 - (1 - J^ROWS)^BANDS,
which is 0.999993 at J = 0.8. Every link of either is then verified on the whole sets of both texts, so
that no pair below ``least`` links.

Texts of equal sets are one node. In each bucket (documents that share a key) all nodes are
compared with the smallest one, which takes rows in proportion to the bucket. Only buckets whose
nodes are still in several components are then searched within a task, texts and all: low bytes
of all smallest hashes tell pairs apart that are far below ``least``, the others are verified
there, and only links that join two components leave the task.

Edge cases: a null text and one without words have the empty set and are copies of one another.
A text of fewer words than a shingle has is one shingle. Repeated and null ids are allowed. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import components, mix64, slices, thrifty, written
from lexloom.llm.simhash import first_of_each, links, majority, shingle_hashes

BANDS, ROWS, TAU = 30, 5, 3
_RNG = np.random.default_rng(8)
_FLIP, _TIMES = (_RNG.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)
#: A pair is verified where its share of equal low bytes is at most this much below ``least`` (six standard deviations).
SLACK = 0.2


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text, shingle), dtype=np.uint64))


def smallest(hashes: np.ndarray) -> np.ndarray:
    """For each of BANDS x ROWS hash functions, its least value on a set that isn't empty."""
    short, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(short), 1024):
        least = np.minimum(least, ((short[at : at + 1024] ^ _FLIP) * _TIMES).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
    return keys


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signed(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """``doc_id, mark`` (the text's hash), ``node`` (its set's hash), ``fp`` (its fingerprint), ``keys`` of its bands, and ``low`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys, low = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), [], []
            for i, value in enumerate(batch.column("__bytes")):
                every = np.array(shingle_hashes(value.as_py() or b"", shingle), dtype=np.uint64)
                hashes, fps[i] = np.unique(every), majority(every)
                least = smallest(hashes) if len(hashes) else np.zeros(0, np.uint32)
                nodes[i] = xxhash.xxh3_64_intdigest(hashes.tobytes())
                keys.append(band_keys(least).view(np.int64) if len(hashes) else [])
                low.append((least & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=["doc_id", "mark", "node", "fp", "keys", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), F.col(f"`{text}`").cast("binary").alias("__bytes")).mapInArrow(thrifty(run), f"doc_id {kind}, mark bigint, node bigint, fp bigint, keys array<bigint>, low binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``texts(node, text)`` have a similarity of ``least`` or more."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None  # one hub's set serves many pairs
        for whole in batches:
            for batch in slices(whole, "one"):
                keep = np.zeros(batch.num_rows, dtype=bool)
                for i, (b, one, other) in enumerate(zip(batch.column("b").to_pylist(), batch.column("one"), batch.column("other"))):
                    if held is None or held[0] != b:
                        held = b, shingle_set(other.as_py(), shingle)
                    keep[i] = jaccard(shingle_set(one.as_py(), shingle), held[1]) >= least
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return sides.select("a", "b", "one", "other").mapInArrow(thrifty(run), "a bigint, b bigint")


def _open_links(least: float, shingle: int):
    """Rows ``key, node, root, hub, low, text`` come sorted by key; gives links that join roots in a bucket, each verified.

    A pair that is joined by then isn't compared, so what a bucket gives grows with its nodes.
    """

    def settle(lot: pa.Table) -> pa.RecordBatch:
        key, node, root, hub = (lot.column(c).to_numpy() for c in ("key", "node", "root", "hub"))
        low = np.frombuffer(b"".join(lot.column("low").to_pylist()), np.uint8).reshape(len(key), -1)
        text, sets, out = lot.column("text"), {}, []

        def of(i: int) -> np.ndarray:
            if node[i] not in sets:
                sets[node[i]] = shingle_set(text[i].as_py(), shingle)
            return sets[node[i]]

        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for start, end in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
            group = root[start:end].copy()
            for i in range(start, end - 1):
                if node[i] == hub[i]:
                    continue
                rest = np.arange(i + 1, end)
                rest = rest[(group[rest - start] != group[i - start]) & (node[rest] != hub[i])]
                rest = rest[(low[rest] == low[i]).mean(axis=1) >= least - SLACK]
                for j in rest.tolist():
                    if group[j - start] != group[i - start] and jaccard(of(i), of(j)) >= least:
                        out.append((max(node[i], node[j]), min(node[i], node[j])))
                        group[group == group[j - start]] = group[i - start]
            sets.clear()
        found = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 4_096:
                lot = pa.Table.from_batches(held)
                key = lot.column("key").to_numpy()
                other = np.flatnonzero(key != key[-1])
                if len(other):
                    yield settle(lot.slice(0, other[-1] + 1))
                    held = lot.slice(other[-1] + 1).to_batches()
        if sum(x.num_rows for x in held):
            yield settle(pa.Table.from_batches(held))

    return run


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates ``(a, b)``, a > b, of ``nodes(node, fp)``: each with the first of its fingerprint, and firsts of fingerprints that link."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    same = nodes.join(firsts.where("n > 1"), "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(firsts.select("fp"), TAU).distinct()
    sides = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("one")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("other")), "b")
    return same.unionByName(sides.select(F.greatest("one", "other").alias("a"), F.least("one", "other").alias("b"))).distinct()


def near_copies(docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Each row's ``doc_id``, ``mark`` (``xxhash64`` of its text) and ``root``, which names its component."""
    marked = written(signed(docs, text, shingle))
    nodes = written(marked.groupBy("node").agg(F.min("mark").alias("mark"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("low").alias("low")))
    keys = nodes.select("node", F.explode("keys").alias("key"))
    hubs = written(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    members = written(keys.join(hubs, "key"))
    printed = written(by_fingerprint(nodes.where("size(keys) > 0").select("node", "fp")))

    # Texts of nodes that share a bucket or nearly a fingerprint at all; of texts with one mark, any.
    met = members.select("node").unionByName(printed.select(F.explode(F.array("a", "b")).alias("node")))
    asked = met.distinct().join(nodes.select("node", "mark"), "node")
    bytes_ = docs.select(F.xxhash64(text).alias("mark"), F.col(f"`{text}`").cast("binary").alias("text"))
    texts = written(bytes_.join(asked, "mark").groupBy("node").agg(F.first("text").alias("text")))

    star = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    edges = written(verified(star.unionByName(printed).distinct(), texts, least, shingle))
    roots = components(edges)
    rooted = members.where("n > 2").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low_root"), F.max("root").alias("high_root")).where("low_root <> high_root").select("key")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = rooted.join(several, "key", "left_semi").join(nodes.select("node", "low"), "node").join(texts, "node").select("key", "node", "root", "hub", "low", "text")
    more = written(left.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(thrifty(_open_links(least, shingle)), "a bigint, b bigint").distinct())
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    rooted = nodes.select("node").join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return marked.select("doc_id", "mark", "node").join(rooted, "node").select("doc_id", "mark", "root")


def one_of_each(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row of each component of near copies: that with the smallest id, and of equal ids the first text."""
    return first_of_each(docs, near_copies(docs, text, **options), text)
