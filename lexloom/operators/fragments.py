"""Longest parts that texts and names share: a suffix automaton of many names, one walk over each text.

The names are a dimension table. They go to the tasks in shards of at most about ``shard_chars``
characters; there a shard is one suffix automaton whose states know their names as a set of bits,
ordered by position. A text is walked once for each shard, character by character; no text is
compared with a single name, and texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the names in one automaton, about. Its states' sets take at most states times names bits.
SHARD_CHARS = 30_000


class Automaton:
    """All parts of ``names``. State 0 is the empty part; ``bits`` of a state are the names that hold its parts.

    After each name stands its number, a symbol that no text has: no part runs over two names.
    """

    def __init__(self, names: Sequence[str]) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.bits = [-1], [0], [0]
        last = 0
        for n, name in enumerate(names):
            for symbol in (*name, n):
                last = self._grown(last, symbol, 1 << n)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.bits[self.link[v]] |= self.bits[v]

    def _state(self, length: int, moves: dict, link: int, bits: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.bits.append(bits)
        return len(self.link) - 1

    def _grown(self, last: int, symbol, bit: int) -> int:
        new = self._state(self.length[last] + 1, {}, 0, bit)
        v = last
        while v >= 0 and symbol not in self.next[v]:
            self.next[v][symbol] = new
            v = self.link[v]
        if v >= 0:
            to = self.next[v][symbol]
            if self.length[to] > self.length[v] + 1:
                short = self._state(self.length[v] + 1, dict(self.next[to]), self.link[to], 0)
                while v >= 0 and self.next[v].get(symbol) == to:
                    self.next[v][symbol] = short
                    v = self.link[v]
                self.link[to] = short
                to = short
            self.link[new] = to
        return new

    def walked(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(state, length, end) after each character: the longest part that ends there."""
        v = n = 0
        for i, c in enumerate(text):
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield v, n, i + 1

    def shared(self, text: str, least: int) -> list[tuple[str, int]]:
        """(part, first name) for each part that is the longest one, and the earliest in the text, for some name."""
        met: dict[int, tuple[int, int]] = {}  # state: its longest part in the text, and where that begins
        for v, n, end in self.walked(text):
            if n < least:
                continue
            if v not in met or met[v][0] < n:
                met[v] = (n, end - n)
            u = self.link[v]
            # The shorter parts that end here; where one is known at its whole length, so are those after it.
            while u > 0 and self.length[u] >= least and met.get(u, (0,))[0] < self.length[u]:
                met[u] = (self.length[u], end - self.length[u])
                u = self.link[u]
        found, open_ = [], self.bits[0]
        for v, (n, start) in sorted(met.items(), key=lambda x: (-x[1][0], x[1][1])):
            mine = self.bits[v] & open_
            if mine:
                found.append((text[start : start + n], (mine & -mine).bit_length() - 1))
                open_ ^= mine
                if not open_:
                    break
        return found


def hints(texts: DataFrame, names: DataFrame, key: str, text: str = "text", least: int = 2, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(key, hint, pos): the longest part of ``least`` characters or more that a text and a name share.

    ``names(pos, name)``, ``pos`` a whole number. Of several longest parts the earliest of the text counts; a hint that
    several names give has the first one's ``pos``. Null and empty names and texts give none, and
    texts of one key are taken together. Rows go out by the names' longest parts, not by the names.
    """
    known = names.where("name <> ''").groupBy("name").agg(F.min("pos").alias("pos"))
    size = known.agg(F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-size // shard_chars))
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''")
    found = None
    for s in range(shards):
        mine = known if shards == 1 else known.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == s)
        listed = sorted((r.pos, r.name) for r in mine.withColumn("pos", F.col("pos").cast("long")).collect())  # about shard_chars characters
        part = rows.mapInArrow(_hinted(listed, least), f"key {kind}, hint string, pos long")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("key", "hint").agg(F.min("pos").cast(names.schema["pos"].dataType).alias("pos")).withColumnRenamed("key", key)


def _hinted(names: list[tuple], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([n for _, n in names])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = [(i, hint, names[first][0]) for i, t in enumerate(batch.column("text").to_pylist()) for hint, first in automaton.shared(t, least)]
                rows, parts, pos = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(parts, pa.string()), pa.array(pos, pa.int64())], names=["key", "hint", "pos"])

    return run


def longest_part(a: str, b: str) -> str:
    """The longest part of both, the earliest of ``a`` among several."""
    if len(b) <= len(a):
        n, end = max(((n, -end) for _, n, end in Automaton([b]).walked(a)), default=(0, 0))
        return a[-end - n : -end] if n else ""
    # The automaton is that of the shorter text; its longest parts are then looked up for the earliest.
    walked = [(n, end) for _, n, end in Automaton([a]).walked(b)]
    n = max((n for n, _ in walked), default=0)
    return a[(start := min(a.index(p) for p in {b[e - n : e] for m, e in walked if m == n})) :][:n] if n else ""


def shared_part(a: Column, b: Column) -> Column:
    """The longest part of two texts, the earliest of ``a``; empty where they share none, null where one is null.

    Time and memory grow with the two lengths, not with their product.
    """

    @F.pandas_udf("string")
    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else longest_part(p, q) for p, q in zip(x, y)], dtype=object)

    return both(a, b)


def overlaps(cases: DataFrame, gold: DataFrame, case: str, question: str = "question", text: str = "text") -> DataFrame:
    """(case, overlap, part): the longest part that a question shares with any of its gold texts.

    ``cases(case, question)``, ``gold(case, text)``. The longest, then the first by code points. A case
    without gold has a null overlap: it was asked nothing.
    """
    each = cases.join(gold.select(case, F.col(text).alias("__text")), case, "left")
    each = each.select(case, shared_part(F.col(question), F.col("__text")).alias("part"))
    best = F.min(F.when(F.col("part").isNotNull(), F.struct((-F.length("part")).alias("n"), "part")))
    return each.groupBy(case).agg(best.alias("b")).select(case, (-F.col("b.n")).alias("overlap"), F.col("b.part").alias("part"))
