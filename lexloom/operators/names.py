"""Many names in many texts: one automaton of the names, one pass over each text.

The names are a dimension table. They are sent to the tasks in shards of at most about
``shard_chars`` characters, each an Aho-Corasick automaton there; texts are not shuffled, and are
read once for each shard. What comes out grows with the occurrences, not with texts times names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the names in one automaton, about.
SHARD_CHARS = 2_000_000


def occurrences(texts: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``(key, name, low, high)``: each place of each distinct name, from 1, and the place after its end.

    Null and empty names are nowhere, null texts hold none; occurrences may overlap.
    """
    known = names.select(F.col(name).alias("name")).where("name <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-size // shard_chars))
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    found = None
    for s in range(shards):
        mine = known if shards == 1 else known.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == s)
        listed = [r.name for r in mine.collect()]  # about shard_chars characters
        part = rows.mapInArrow(_finder(listed), f"key {kind}, name string, low int, high int")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("key", key)


def _finder(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for n in names:
            automaton.add_word(n, n)
        if names:
            automaton.make_automaton()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, hits, ends = [], [], []
                for i, t in enumerate(batch.column("text").to_pylist() if names else []):
                    for end, n in automaton.iter(t):
                        rows.append(i)
                        hits.append(n)
                        ends.append(end)
                low = [e - len(n) + 2 for e, n in zip(ends, hits)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(hits, pa.string()), pa.array(low, pa.int32()), pa.array([e + 2 for e in ends], pa.int32())], names=["key", "name", "low", "high"])

    return run


def substrings(value: Column) -> Column:
    """All distinct parts of a short string."""
    n = F.length(value)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: value.substr(i, m)))))
