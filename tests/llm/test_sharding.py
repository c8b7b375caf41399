import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

from pyspark.sql import functions as F

from lexloom.llm import sharding
from lexloom.llm.common import written


def check(got, rows, shards, slack):
    """The laws: every row once, gapless slots, near equal bytes, equal texts together unless too large."""
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), crc(t)) for i, t in rows)
    slots, loads, homes, total = defaultdict(list), Counter(), defaultdict(set), 0
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        homes[r.text_crc32].add(r.shard)
        total += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = Counter()
    for _, t in rows:
        weight[crc(t)] += size(t)
    assert all(len(homes[c]) == 1 for c, w in weight.items() if w <= total / shards)
    largest = max(size(t) for _, t in rows)
    for s in range(shards):
        assert loads[s] <= max(largest, total / shards * (1 + slack)), (s, loads[s], total / shards)
        assert loads[s] >= total / shards * (1 - slack) or largest > total / shards


def corpus(n=3000):
    draw = random.Random(5)
    rows = [(i, f"text {i} " + "é" * draw.randrange(1, 80)) for i in range(n)]
    rows += [(n + i, "copied text " * 3) for i in range(300)] + [(2 * n + i, f"pair {i // 2}") for i in range(200)]
    return rows


def test_laws(spark):
    rows = corpus() + [(None, "no id"), (None, None), (5, ""), (7, None), (9001, "long " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as shard", "map(1, 2) as slot", "3 as size")
    got = sharding.digests(docs, fine=64).collect()
    check(got, rows, 16, 0.04)
    again = sharding.digests(docs.repartition(5), fine=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_hot_groups_are_spread(spark):
    """A third of all rows is one text, another sixth one row many times, and many texts are null."""
    rows = corpus(1000) + [(10_000 + i, "hot " * 30) for i in range(2000)] + [(None, "the same row " * 9)] * 900 + [(20_000 + i, None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.digests(docs, fine=32).collect()
    check(got, rows, 16, 0.08)
    rows_ = written(sharding.keyed(docs))
    splitters, counts = sharding.split(rows_, 16 * 32)
    assert all(r is None or r.rows <= 2 * len(rows) / 512 + 1 for r in counts)
    assert any(i != sharding._LEAST for _, i, _ in splitters) and any(x != sharding._LEAST for _, _, x in splitters)


def test_one_text_many_rows_and_few_rows(spark):
    for rows in ([(i, "equal") for i in range(500)], [(1, "only")], [(i, "x" * i) for i in range(3)]):
        got = sharding.digests(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, fine=16).collect()
        assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(t) + 1) for i, t in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if len(rows) == 500:
            assert all(115 <= len(s) <= 135 for s in slots.values())
    assert sharding.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overfull_ranges_are_subdivided_whatever_the_sample(spark):
    rows = written(sharding.keyed(spark.createDataFrame(corpus(500), "doc_id long, text string")))
    splitters, counts = sharding.split(rows, 64, per_range=1)
    total = sum(r.bytes for r in counts if r)
    assert all(r is None or r.rows == 1 or r.bytes <= total / 32 + 400 for r in counts)
    assert sum(r.rows for r in counts if r) == 1000


def test_written_shards_hold_the_documents(spark, tmp_path):
    docs = spark.createDataFrame(corpus(200), "doc_id long, text string").withColumn("extra", F.lit("e"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3, fine=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "extra").collect())) == sorted(map(tuple, docs.collect()))
    sizes = Counter(r.shard for r in back.collect())
    assert set(sizes) == {0, 1, 2}
    assert {(r.shard, r.slot) for r in back.collect()} == {(s, i) for s, n in sizes.items() for i in range(n)}


def test_dealing_fills_to_one_level():
    assert sharding._level([0, 0, 0], 9) == 3 and sharding._level([5, 0, 0], 4) == 2 and sharding._level([5, 0, 1], 20) == 26 / 3
    row = lambda b, low, high, n=5: type("R", (SimpleNamespace,), {"__getitem__": lambda s, k: getattr(s, k)})(bytes=b, rows=n, low__text=low, high__text=high)
    shard, first = sharding.deal([row(10, 0, 1), row(30, 2, 2), None, row(10, 3, 4), row(10, 5, 6)], 2)
    assert shard[0] == shard[3] == shard[4] != shard[1] and first == [0, 0, 0, 5, 10]
