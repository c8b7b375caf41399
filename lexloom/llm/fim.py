"""Fill-in-middle transformation, cut by a sparse checkpoint index.

A text is n units: runs of white space with the word after them, and white space at its end. Two
of the n + 1 places between units, drawn by a hash of the document's id, part it into prefix,
middle and suffix.

Plan. One map over the rows, without any shuffle. While the units of a batch are counted, every
``every``-th unit leaves a checkpoint: its number, and how many bytes and code points lie before
its end. Neither units nor their places are kept. A cut is found by binary search of the
checkpoints and a short scan on from there. Texts are counted in stretches of ``stretch`` bytes,
so scratch arrays don't grow with a text; batches are taken some megabytes at a time.

Edge cases: a null text is empty. An empty text has no units; it and a text that holds a sentinel
are left plain. A null id is hashed as an empty string. Rows that repeat give equal rows. Old
columns that clash with new ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexloom.llm.common import flat, slices, thrifty

SENTINELS = ("<P>", "<S>", "<M>")
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Checkpoints:
    """Of the texts of a batch laid end to end: every ``every``-th unit, and where texts begin.

    ``bytes_`` and ``points`` lie before the end of unit ``i * every``; ``units_before`` and
    ``points_before`` before each text, and before the end of all.
    """

    every: int
    bytes_: np.ndarray
    points: np.ndarray
    units_before: np.ndarray
    points_before: np.ndarray


def _unit_ends(raw: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places in [low, high) of last bytes of units."""
    white = _WHITE[raw[low : high + 1]]
    last = ~white[: high - low]
    last[: len(white) - 1] &= white[1:]
    closing = ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, high, "right")] - 1
    last[closing[closing >= low] - low] = True  # of texts, whatever comes next
    return np.flatnonzero(last) + low


def _starts(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (raw & 0xC0) != 0x80


def count_units(raw: np.ndarray, ends: np.ndarray, every: int = 64, stretch: int = 1 << 20) -> Checkpoints:
    """Count units and code points in one pass, leaving checkpoints."""
    bytes_, points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    units_before, points_before = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    units = seen = 0
    for low in range(0, len(raw), stretch):
        high = min(low + stretch, len(raw))
        last = _unit_ends(raw, ends, low, high)
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(_starts(raw[low:high]))])
        texts = slice(np.searchsorted(ends, low), np.searchsorted(ends, high))
        units_before[texts] = units + np.searchsorted(last, ends[texts])
        points_before[texts] = seen + before[ends[texts] - low]
        marked = last[-(units + 1) % every :: every] + 1
        bytes_.append(marked)
        points.append(seen + before[marked - low])
        units, seen = units + len(last), seen + int(before[-1])
    rest = slice(np.searchsorted(ends, len(raw)), None)
    units_before[rest], points_before[rest] = units, seen
    return Checkpoints(every, np.concatenate(bytes_), np.concatenate(points), units_before, points_before)


def locate(raw: np.ndarray, ends: np.ndarray, index: Checkpoints, unit: int) -> tuple[int, int]:
    """(bytes, code points) before the end of a unit, numbered through all texts from 1; 0 is the start."""
    numbers = range(0, len(index.bytes_) * index.every, index.every)
    low, high = 0, len(numbers)  # binary search of the last checkpoint that isn't past the unit
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if numbers[middle] <= unit else (low, middle)
    at, points, need, step = int(index.bytes_[low]), int(index.points[low]), unit - numbers[low], 1024
    while need:
        last = _unit_ends(raw, ends, at, min(at + step, len(raw)))
        to = int(last[need - 1]) + 1 if len(last) >= need else min(at + step, len(raw))
        points += int(np.count_nonzero(_starts(raw[at:to])))
        need, at, step = max(0, need - len(last)), to, 2 * step
    return at, points


def _drawn(seed: int, key: str) -> list[Column]:
    """The first four 8-digit groups of the hash of an id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    a, b, c = sentinels
    for x in sentinels:
        for y in sentinels:
            if not x or (x != y and x in y) or any(x.endswith(y[:n]) for n in range(1, min(len(x), len(y)))):
                raise ValueError(f"sentinels may neither be empty nor overlap: {x!r}, {y!r}")
    return a, b, c


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, sentinels: Sequence[str] = SENTINELS, every: int = 64, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of those to suffix, prefix, middle.
    Lengths are in code points, null where the text is plain.
    """
    before, after, between = _checked(sentinels)
    kept = [c for c in docs.columns if c not in _NEW]
    h1, h2, h3, h4 = _drawn(seed, key)
    text = F.coalesce("text", F.lit(""))
    holds = F.contains(text, F.lit(before)) | F.contains(text, F.lit(after)) | F.contains(text, F.lit(between))
    form = F.when((text == "") | holds | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    fed = docs.select(*[F.col(f"`{c}`") for c in kept], form.alias("__form"), h1.alias("__one"), h2.alias("__two"))
    new = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    schema = StructType([docs.schema[c] for c in kept] + new)
    p, s, m = (x.encode() for x in (before, after, between))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, ends = flat(batch.column("text"))
                index = count_units(raw, ends, every)
                n = np.diff(index.units_before)
                one, two = (batch.column(c).to_numpy() % (n + 1) for c in ("__one", "__two"))
                firsts, seconds = np.minimum(one, two).tolist(), np.maximum(one, two).tolist()
                held, forms = memoryview(raw), batch.column("__form").to_pylist()
                prefixes, middles, out = [], [], []
                for i, kind in enumerate(forms):
                    low, high = int(ends[i]), int(ends[i + 1])
                    if kind == "plain":
                        prefixes.append(None)
                        middles.append(None)
                        out.append(bytes(held[low:high]))
                        continue
                    base = int(index.units_before[i])
                    start = (low, int(index.points_before[i]))
                    first = locate(raw, ends, index, base + firsts[i]) if firsts[i] else start
                    second = first if seconds[i] == firsts[i] else locate(raw, ends, index, base + seconds[i])
                    prefix, middle, suffix = held[low : first[0]], held[first[0] : second[0]], held[second[0] : high]
                    prefixes.append(first[1] - start[1])
                    middles.append(second[1] - first[1])
                    out.append(b"".join((s, suffix, p, prefix, m, middle) if kind == "spm" else (p, prefix, s, suffix, m, middle)))
                made = [pa.array(n, pa.int64()), batch.column("__form"), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *_NEW])

    return fed.mapInArrow(thrifty(run), schema)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, "|".join(re.escape(x) for x in _checked(sentinels)), -1)  # nothing, then the three parts in the form's order
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def digests(docs: DataFrame, **options) -> DataFrame:
    """Hashes of each document's output and of the text rebuilt from it, in place of the texts."""
    made = transform(docs, **options)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
