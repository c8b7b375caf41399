"""Sharding of documents into ranges of sampled splitters, near equal in bytes, equal texts together.

A row's key is (hash of the text, hash of the id, hash of the row), so that equal texts lie side by
side. A row's size is its text's bytes plus 1.

Plan.
1. One scan writes the keys and sizes, without texts. Their sums by text are the groups.
2. A sample of groups is drawn with a chance in proportion to size (by a hash, so reruns draw the
   same); quantiles of the sample are splitters, and a group as heavy as a range is a range of its
   own. The ranges are counted exactly over all rows.
3. Overfull ranges (in bytes or in rows) are subdivided until none is left: ranges of several
   texts by a sample of their groups, one text's rows by equal parts of the ids' hashes, equal
   ids' rows by those of the rows'. The driver holds the ranges, in proportion to ``shards *
   fine``, and ``per_range`` samples for each.
4. Ranges are dealt to shards. A text that is overfull but no larger than a shard goes whole to
   the emptiest shard, the largest first; all other ranges fill the shards in the order of keys,
   each up to an equal part of the bytes. A text larger than a shard is spread over several.
5. Each range is sorted in a task of its own; a row's slot is its place in the range after the
   rows of its shard's earlier ranges. So slots have no gaps, and no task holds a whole shard.

Sizes of shards differ by about a range, 1 / ``fine`` of a shard, or by what a document or a group
that may not be parted has more.

Edge cases: a null text is empty: size 1, CRC 0. Null ids
are equal ids. Rows that repeat lie side by side in any order. Hash collisions put unequal texts
together, nothing else. Old columns that clash with new ones are replaced. Very long texts are
hashed and counted whole by Spark. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import discard, thrifty, written

_KEY = ("__text", "__id", "__row")
_SIGN = 1 << 63
_LEAST, _MOST = -_SIGN, _SIGN - 1


@dataclass(frozen=True)
class Plan:
    """Ranges begin at the least key and at each of ``splitters``; each has its shard, and that shard's rows in earlier ranges."""

    splitters: list[tuple[int, int, int]]
    shard: np.ndarray
    first_slot: np.ndarray


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """Keys as byte strings that compare alike."""
    rows = np.stack([c.view(np.uint64) ^ np.uint64(_SIGN) for c in columns], axis=1).astype(">u8")
    return np.ascontiguousarray(rows).view("S24").ravel()


def in_ranges(rows: DataFrame, splitters: list[tuple[int, int, int]], **by_range: np.ndarray) -> DataFrame:
    """``rows`` with ``__range``, the number of splitters at or below their key, and columns of numbers that hang on it."""
    borders = _packed([np.array(c, np.int64) for c in zip(*splitters)]) if splitters else np.zeros(0, "S24")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "__range int", *(f"{c} long" for c in by_range)])
    names = [*rows.columns, "__range", *by_range]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(borders, _packed([batch.column(c).to_numpy() for c in _KEY]), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), *(pa.array(v[at], pa.int64()) for v in by_range.values())], names=names)

    return rows.mapInArrow(thrifty(run), schema)


def keyed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``size`` and the three parts of the key; the last one names a row of this scan."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return docs.withColumns({"size": size, "__text": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "__id": F.xxhash64(key), "__row": F.xxhash64(F.monotonically_increasing_id())})


def _quantiles(sample: list[tuple[int, float]], least: float) -> set[tuple[int, int, int]]:
    """Splitters between groups, each range of about ``least``; a group as heavy as that stands alone."""
    out, held = set(), 0.0
    for text, weight in sorted(sample):
        if weight >= least or held + weight > least:
            out.add((text, _LEAST, _LEAST))
            held = 0.0
        held += weight
        if weight >= least and text < _MOST:
            out.add((text + 1, _LEAST, _LEAST))
            held = 0.0
    return out


def _equal_parts(low: int, high: int, n: int) -> set[int]:
    """Borders that part [low, high] into about ``n`` equal parts, one at least."""
    return {low + (high - low) * i // n for i in range(1, n)} - {low} or {high}


def split(rows: DataFrame, ranges: int, per_range: int = 16, seed: int = 11) -> tuple[list[tuple[int, int, int]], list]:
    """Splitters of keyed ``rows`` into about ``ranges`` ranges, none overfull, and the counts of each range in order.

    A range is overfull if it has several rows that can be parted, and over twice its share of all
    bytes or of all rows.
    """
    groups = written(rows.groupBy("__text").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    if not total.rows:
        return [], [None]
    least = 1.0 / ranges
    # Bytes and rows count alike, so that a range of many small texts is no small one.
    weight = (F.col("bytes") / float(total.bytes) + F.col("rows") / float(total.rows)) / 2
    weighed = groups.select("__text", F.lit(_LEAST).alias("__id"), F.lit(_LEAST).alias("__row"), weight.alias("weight"))

    def sample(of: DataFrame, rate: float, turn: int) -> list[tuple[int, float]]:
        chance = F.pmod(F.xxhash64(F.lit(seed + turn), "__text"), F.lit(1 << 40)) / float(1 << 40)
        return [(r[0], max(r[1], 1 / rate)) for r in of.where(chance < F.col("weight") * rate).select("__text", "weight").collect()]

    borders, turn = _quantiles(sample(weighed, per_range * ranges, 0), least), 0
    while True:
        splitters, turn = sorted(borders), turn + 1
        ends = [f(c).alias(f"{name}{c}") for c in _KEY for name, f in (("low", F.min), ("high", F.max))]
        counted = in_ranges(rows.select("size", *_KEY), splitters).groupBy("__range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *ends)
        found = {r["__range"]: r for r in counted.collect()}  # a row for each range
        share = {i: max(r.bytes / total.bytes, r.rows / total.rows) for i, r in found.items()}
        over = [i for i, r in found.items() if share[i] > 2 * least and any(r[f"low{c}"] < r[f"high{c}"] for c in _KEY)]
        if not over:
            discard(groups)
            return splitters, [found.get(i) for i in range(len(splitters) + 1)]
        several = [i for i in over if found[i]["low__text"] < found[i]["high__text"]]
        if several:
            inside = in_ranges(weighed, splitters).where(F.col("__range").isin(several))
            borders |= _quantiles(sample(inside, per_range * ranges * 2**turn, turn), least / 2)
        known = [b[0] for b in sorted(borders)]
        for i in over:
            r, n = found[i], int(share[i] / least) + 2
            if i in several:
                if bisect_right(known, r["low__text"]) == bisect_right(known, r["high__text"]):  # the sample had none
                    borders |= {(x, _LEAST, _LEAST) for x in _equal_parts(r["low__text"], r["high__text"], n)}
            elif r["low__id"] < r["high__id"]:
                borders |= {(r["low__text"], x, _LEAST) for x in _equal_parts(r["low__id"], r["high__id"], n)}
            else:
                borders |= {(r["low__text"], r["low__id"], x) for x in _equal_parts(r["low__row"], r["high__row"], n)}


def _level(loads: list[int], more: int) -> float:
    """The level to which ``more`` fills all loads below it."""
    low, filled = sorted(loads), 0
    for n, load in enumerate(low):
        if n and filled + n * (load - low[n - 1]) >= more:
            return low[n - 1] + (more - filled) / n
        filled += n * (load - low[n - 1]) if n else 0
    return low[-1] + (more - filled) / len(low)


def deal(counts: list, shards: int) -> tuple[list[int], list[int]]:
    """The shard of each range, and how many rows of it lie in earlier ranges."""
    total = sum(r.bytes for r in counts if r)
    groups: dict[int, list[int]] = {}
    for i, r in enumerate(counts):
        if r and r["low__text"] == r["high__text"]:
            groups.setdefault(r["low__text"], []).append(i)
    weight = {text: sum(counts[i].bytes for i in at) for text, at in groups.items()}
    usual = total / max(1, len(counts))
    # Parted texts, and ranges of one large text; of those too large for a shard only single rows stay whole.
    whole = [t for t, at in groups.items() if (len(at) > 1 or weight[t] > usual) and (weight[t] <= total / shards or sum(counts[i].rows for i in at) == 1)]
    shard, loads = [0] * len(counts), [0] * shards
    emptiest = [(0, s) for s in range(shards)]
    for text in sorted(whole, key=lambda t: (-weight[t], t)):
        load, s = heapq.heappop(emptiest)
        for i in groups[text]:
            shard[i] = s
        loads[s] = load + weight[text]
        heapq.heappush(emptiest, (loads[s], s))
    placed = {i for t in whole for i in groups[t]}
    rest = [i for i, r in enumerate(counts) if r and i not in placed]
    level = _level(loads, sum(counts[i].bytes for i in rest))
    ends = np.cumsum([max(0.0, level - load) for load in loads])
    before = 0
    for i in rest:
        shard[i] = min(shards - 1, int(np.searchsorted(ends, before + counts[i].bytes / 2, "right")))
        before += counts[i].bytes
    first, held = [0] * len(counts), [0] * shards
    for i, r in enumerate(counts):
        if r:
            first[i] = held[shard[i]]
            held[shard[i]] += r.rows
    return shard, first


def plan(rows: DataFrame, shards: int = 16, fine: int = 128, **options) -> Plan:
    """The plan of keyed rows, ``fine`` ranges for each shard."""
    splitters, counts = split(rows, shards * fine, **options)
    shard, first = deal(counts, shards)
    return Plan(splitters, np.array(shard, np.int64), np.array(first, np.int64))


def place(rows: DataFrame, made: Plan) -> DataFrame:
    """Keyed rows, the very ones of the plan, with ``shard`` and ``slot`` in place of their keys."""
    ranged = in_ranges(rows.drop("shard", "slot"), made.splitters, __shard=made.shard, __first=made.first_slot)
    slot = F.col("__first") + F.row_number().over(W.partitionBy("__range").orderBy(*_KEY)) - 1
    return ranged.withColumns({"shard": F.col("__shard").cast("int"), "slot": slot}).drop(*_KEY, "__range", "__shard", "__first")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", **options) -> DataFrame:
    """``docs``, written once with their keys, with ``size``, ``shard`` and ``slot``."""
    rows = written(keyed(docs, key))
    return place(rows, plan(rows, shards, **options))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """The documents as Parquet, a folder for each shard, its files in the order of slots."""
    shard(docs, shards, **options).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """Size, CRC-32, shard and slot of each document; texts are read once and not carried."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    rows = written(keyed(docs).select("doc_id", "size", crc, *_KEY))
    out = place(rows, plan(rows, shards, **options))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
