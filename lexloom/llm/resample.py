"""Importance resampling of documents towards a target corpus, with exact distributed selection.

Features are runs of words of a lower-cased text, hashed into ``buckets``. A bucket's gain says how
much more frequent it is in the target than in the documents, as a floored logarithm times 1000;
a document's weight is the floored mean of its features' gains. To the weight comes Gumbel noise
from a hash of the document's id, so that the highest scores are a draw without replacement.

Plan.
1. One pass over each corpus counts features by bucket: an array in each task, summed by bucket.
   The gains, an array of ``buckets`` numbers, go to all tasks.
2. A second pass over the documents looks the gains of their features up in that array, and a
   table of numbers (no texts) is written.
3. Radix selection finds the key of rank k exactly: of the composite key (score descending, id,
   hash of the text, row) one digit of ``bits`` bits at a time, counting the digits of those rows
   only that agree with the digits found before. A count is a partial aggregation of at most
   2 ** ``bits`` groups. Digits in which no row differs are passed over, and the search
   ends where a digit's rows are all drawn.
4. Rows up to that key are range-partitioned and sorted, and get their ranks from the counts of the
   partitions before; the others join them by union, so nothing else is shuffled. The last
   component is unique, so that no key is ever split or too large for a task.

Edge cases: a null or empty text has no features, weight 0, and isn't eligible (unless ``least``
is 0). A null id is hashed as an empty string and comes after all others of its score. Rows that
repeat are documents of their own. Very long texts are taken in stretches. Old columns that clash
with new ones are replaced. Without target texts gains compare with nothing seen; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import flat, slices, thrifty, written

#: Bytes of a word: digits, letters (in lower case by then), and all from 0x80 on.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Features longer than this are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """CRC-32 of each [first, last), all of them a byte further at a time."""
    size = last - first
    order = np.argsort(-size, kind="stable")
    out = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    long = int(np.searchsorted(-size[order], -_LONG))  # those of more bytes come first
    begin, sizes = first[order], size[order]
    held = memoryview(np.ascontiguousarray(raw))
    for i in range(long):
        out[i] = zlib.crc32(held[int(begin[i]) : int(begin[i] + sizes[i])]) ^ 0xFFFFFFFF
    for step in range(int(sizes[long]) if long < len(sizes) else 0):
        some = slice(long, int(np.searchsorted(-sizes, -step)))  # features of more than ``step`` bytes
        out[some] = _CRC[(out[some] ^ raw[begin[some] + step]) & np.uint32(255)] ^ (out[some] >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out ^ np.uint32(0xFFFFFFFF)
    return back


def _words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end) of each word of texts laid end to end, which are lower-cased."""
    inside = _IN_WORD[raw]
    cuts = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return np.searchsorted(ends, first, "right") - 1, first, last


def _joined(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words alone, each with one space before it, and their new places."""
    size = last - first
    end = np.cumsum(size + 1)
    begin = end - size
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[at + np.repeat(begin, size)] = raw[at + np.repeat(first, size)]
    return out, begin, end


def _stretches(raw: np.ndarray, ends: np.ndarray, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts as they are; a long one alone in pieces of about ``stretch`` bytes that end after no part of a word."""
    if len(ends) != 2 or len(raw) <= stretch:
        yield _LOWER[raw], ends
        return
    low = 0
    while low < len(raw):
        high = min(low + stretch, len(raw))
        while high < len(raw) and _IN_WORD[_LOWER[raw[high]]]:
            more = np.flatnonzero(~_IN_WORD[_LOWER[raw[high : high + 4096]]])
            high = high + int(more[0]) if len(more) else min(high + 4096, len(raw))
            if len(more):
                break
        yield _LOWER[raw[low:high]], np.array([0, high - low])
        low = high


def feature_buckets(raw: np.ndarray, ends: np.ndarray, longest: int = 1, buckets: int = 10_000, stretch: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each feature, its bucket, words of each text), in lots that add up.

    Features are all runs of 1 to ``longest`` words of a text. A long text alone comes in several
    lots; runs across their border come with the later one.
    """
    carried = np.zeros(0, np.uint8)  # the last words of the piece before, each after a space
    texts = len(ends) - 1
    for piece, bounds in _stretches(raw, ends, stretch):
        owner, first, last = _words(piece, bounds)
        words = np.bincount(owner, minlength=texts)
        piece, first, last = _joined(piece, first, last)
        old = 0
        if len(carried):
            piece = np.concatenate([carried, piece])
            starts = np.flatnonzero(carried == 0x20) + 1
            old = len(starts)
            first, last = np.concatenate([starts, first + len(carried)]), np.concatenate([np.append(starts[1:] - 1, len(carried)), last + len(carried)])
            owner = np.concatenate([np.zeros(old, owner.dtype), owner])
        who, found = [], []
        for run in range(1, longest + 1):
            begin = np.arange(max(0, old - run + 1), len(first) - run + 1)
            begin = begin[owner[begin] == owner[begin + run - 1]]
            who.append(owner[begin])
            found.append((crc32(piece, first[begin], last[begin + run - 1]) % buckets).astype(np.int64))
        yield np.concatenate(who), np.concatenate(found), words
        if longest > 1 and texts == 1 and len(first):
            carried = piece[first[max(0, len(first) - longest + 1)] - 1 :]


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket's features occur in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for _, found, _ in feature_buckets(*flat(batch.column("text")), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = texts.select(F.col(text).alias("text")).mapInArrow(thrifty(run), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over its share of the documents."""
    n = len(seen)
    all_seen, all_wanted = float(seen.sum() + n), float(wanted.sum() + n)
    ratio = (wanted + 1.0) * all_seen / ((seen + 1.0) * all_wanted)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``n_features`` and the floored mean ``weight`` of their gains."""
    kept = [c for c in docs.columns if c not in ("text", "n_words", "n_features", "weight")]
    buckets = len(gain)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "n_words long, n_features long, weight long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, count, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
                for who, found, new in feature_buckets(*flat(batch.column("text")), longest, buckets):
                    words += new
                    count += np.bincount(who, minlength=batch.num_rows)
                    sums = np.cumsum(np.append(0, gain[found][np.argsort(who, kind="stable")]))
                    upto = np.append(0, np.cumsum(np.bincount(who, minlength=batch.num_rows)))
                    total += sums[upto[1:]] - sums[upto[:-1]]
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(words), pa.array(count), pa.array(weight)], names=[*kept, "n_words", "n_features", "weight"])

    return docs.mapInArrow(thrifty(run), schema)


def noise(seed: int, key: str) -> Column:
    """Gumbel noise times 1000, floored, by the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, key: list[str], k: int, bits: int = 12) -> tuple[int, ...] | None:
    """The k-th smallest composite key (from 1) of non-null long columns; None if there are fewer rows, or k is 0.

    Where all rows that agree with the digits found so far are among the k smallest, the largest
    key with these digits is returned in its place: the same rows are at or below it.
    """
    ends = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}{i}") for i, c in enumerate(key) for name, f in (("low", F.min), ("high", F.max))]).first()
    if not 0 < k <= ends.n:
        return None
    found: list[int] = []
    left, need, sign = rows, k, 1 << 63
    for i, c in enumerate(key):
        low, high = ends[f"low{i}"] + sign, ends[f"high{i}"] + sign  # as unsigned numbers, in the same order
        width = (low ^ high).bit_length()
        value, unsigned = low >> width, F.col(c).bitwiseXOR(F.lit(-sign))
        while width:
            step = min(bits, width)
            width -= step
            digit = F.shiftrightunsigned(unsigned, width).bitwiseAND(F.lit((1 << step) - 1))
            counts = sorted(tuple(r) for r in left.groupBy(digit).count().collect())  # at most 2 ** bits of them
            for d, n in counts:
                if need <= n:
                    break
                need -= n
            left, value = left.where(digit == d), value << step | d
            if need == n:
                return (*found, ((value + 1 << width) - 1) - sign, *[sign - 1] * (len(key) - i - 1))
        found.append(value - sign)
    return tuple(found)


def _upto(key: list[str], bound: tuple[int, ...]) -> Column:
    """Whether a composite key is at or below the bound."""
    out = F.lit(True)
    for c, value in reversed(list(zip(key, bound))):
        out = (F.col(c) < value) | ((F.col(c) == value) & out)
    return out


def range_ranked(rows: DataFrame, key: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of a unique key, by range partitions and their counts."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = 1 << 33  # places of a partition, as monotonically_increasing_id counts them
    placed = written(rows.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("__place", F.monotonically_increasing_id()))
    counts = {r.part: r.n for r in placed.groupBy(F.floor(F.col("__place") / inner).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [0] * (max(counts, default=-1) + 1), 0
    for part in range(len(before)):
        before[part] = total
        total += counts.get(part, 0)
    base = F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), F.floor(F.col("__place") / inner).cast("int"))
    return placed.withColumn("rank", base + F.col("__place") % inner + 1).drop("__place")


_KEY = ["__down", "__no_id", "__id", "__mark", "__row"]


def score(docs: DataFrame, targets: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, key: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with ``n_words, n_features, weight, score``; written."""
    gain = gains(bucket_counts(docs, "text", longest, buckets), bucket_counts(targets, "text", longest, buckets))
    kept = [c for c in docs.columns if c not in ("n_words", "n_features", "weight", "score", "rank")]
    weighed = weigh(docs.select(*[f"`{c}`" for c in kept], F.xxhash64("text").alias("__mark")), gain, longest)
    scored = weighed.withColumn("score", F.col("weight") + noise(seed, key))
    identified = scored.withColumns({"__down": -F.col("score"), "__no_id": F.col(key).isNull().cast("long"), "__id": F.coalesce(F.col(key).cast("long"), F.lit(0)), "__row": F.monotonically_increasing_id()})
    return written(identified)


def resample(docs: DataFrame, targets: DataFrame, share: float = 10.0, least: int = 20, **options) -> DataFrame:
    """Every document without its text, with ``n_features, weight, score`` and, if it is drawn, its ``rank``.

    Of the N documents of ``least`` words or more, floor(share * N / 100) are drawn, those of the
    highest scores, ties to the smaller id. ``targets`` has a column ``text``.
    """
    scored = score(docs, targets, **options)
    eligible = scored.where(F.col("n_words") >= least)
    bound = kth_key(eligible, _KEY, math.floor(share * eligible.count() / 100))
    names = [*_KEY, "n_words"]
    if bound is None:
        return scored.withColumn("rank", F.lit(None).cast("long")).drop(*names)
    drawn = (F.col("n_words") >= least) & _upto(_KEY, bound)
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return range_ranked(scored.where(drawn), _KEY).unionByName(rest).drop(*names)


def drawn_documents(docs: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The documents drawn, whole, with ``weight``, ``score`` and ``rank``; ids must be there and differ to tell rows apart."""
    found = resample(docs.select("doc_id", "text"), targets, **options).where("rank is not null").select("doc_id", "weight", "score", "rank")
    return docs.drop("weight", "score", "rank").join(found, "doc_id")
