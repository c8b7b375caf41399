import re

import numpy as np

from lexloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(docs, **kw):
    return sorted(map(tuple, mixing.mix(docs, **kw).collect()), key=str)


def test_targets_fill_up_to_the_cap():
    sizes = {"0a": 10, "0b": 1000, "0c": 1000}
    goal = mixing.targets(sizes)
    assert goal["0a"] == 20 and abs(sum(goal.values()) - 1.5 * 2010) < 1e-6
    assert abs(goal["0c"] / goal["0b"] - 2) < 0.01 or goal["0c"] == 2000
    assert mixing.targets({}) == {} and mixing.targets({"0a": 0}) == {"0a": 0.0}


def test_quotas_add_up():
    split = mixing.shard_quotas([1000, 3, 0, 77], 7, 5)
    assert split.sum(axis=0).tolist() == [1000, 3, 0, 77] and np.ptp(split.sum(axis=1)) <= 1
    assert (split == mixing.shard_quotas([1000, 3, 0, 77], 7, 5)).all()


def test_mix_against_plain_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "big" if i % 3 else f"s{i % 5}") for i in range(400)]
    rows += [(400, "word " * 3000, None), (401, None, "s1"), (402, "", "s1"), (7, "same row", "s2"), (7, "same row", "s2"), (None, "a\tb\x0bc\x0cd　e", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as taken", "3 as shard")
    got = mixing.mix(docs, block_words=100, cells=16, shards=5).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    keyed = {("1" if s is None else "0" + s): n for s, n in sizes.items()}
    goal = mixing.targets(keyed)
    for s, n in sizes.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {n} and len({r.target for r in mine}) == 1
        assert abs(mine[0].target - goal["1" if s is None else "0" + s]) < 1e-6
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 + 1e-6
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert rows_of(docs.repartition(3), block_words=100, cells=16) == rows_of(docs, block_words=100, cells=16)


def test_another_seed_draws_other_blocks_and_the_same_sums(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    one, other = (mixing.mix(docs, block_words=20, cells=8, shards=6, seed=s).collect() for s in (20, 21))
    taken = lambda rows: {r.doc_id: r.taken for r in rows}
    sums = lambda rows: {s: sum(r.taken for r in rows if r.source == s) for s in ("s0", "s1", "s2")}
    assert taken(one) != taken(other) and sums(one) == sums(other)
    facts, drawn = mixing.draws(docs, block_words=20, cells=8, shards=6)
    per = {}
    for r in drawn.join(facts.select("row", "doc_id"), "row").select("row", drawn["doc_id"], "shard", "words").collect():
        per.setdefault(r.doc_id, {}).setdefault(r.shard, []).append(r.words)
    assert all(sum(map(sum, per.get(r.doc_id, {}).values())) == r.taken and len(per.get(r.doc_id, {})) == r.shards for r in one)


def test_shards_hold_disjoint_draws(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    _, drawn = mixing.draws(docs, block_words=20, cells=8, shards=6)
    got = drawn.collect()
    assert len({(r.row, r.block, r.epoch) for r in got}) == len(got)
    per_shard = np.bincount([r.shard for r in got], minlength=6)
    assert len(per_shard) == 6 and np.ptp(per_shard) <= 1


def test_documents_lie_by_shard_in_shuffled_order(spark):
    rows = [(i, f"d{i} " + "w " * (i % 50 + 1), f"s{i % 3}") for i in range(300)] + [(None, "no id " * 30, None), (7, None, "s1"), (500, "long " * 90, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block_words": 60, "cells": 8, "shards": 6}
    facts, drawn = mixing.draws(docs, **options)
    want = {}
    for r in drawn.join(facts.select("row", "source"), "row").collect():
        want.setdefault((r.doc_id, r.epoch, r.shard), []).append(r)
    got = mixing.drawn_documents(docs, places=True, **options).collect()
    assert [(r.shard, r.place) for r in got] == sorted((min(x.shard for x in w), min(x.place for x in w)) for w in want.values())
    assert sorted((str(r.doc_id), r.shard, len(WORD.findall(r.text))) for r in got) == sorted((str(k[0]), k[2], sum(x.words for x in w)) for k, w in want.items())
    plain = [r.doc_id for r in mixing.drawn_documents(docs, **options).collect()]
    assert plain == [r.doc_id for r in got] and None in plain
    assert sum(a == b for a, b in zip(plain, plain[1:])) < 10


def test_large_pools_are_drawn_exactly():
    rng = np.random.default_rng(4)
    small = [mixing._hypergeometric(rng, 30, 20, 10) for _ in range(4000)]
    assert abs(np.mean(small) - 6) < 0.1 and abs(np.var(small) - 10 * 0.6 * 0.4 * 40 / 49) < 0.2
    assert mixing._hypergeometric(rng, 5, 0, 5) == 5 and mixing._hypergeometric(rng, 0, 9, 4) == 0
    split = mixing.shard_quotas([3 * 10**9, 10, 0, 10**9], 4, 5)
    assert split.sum(axis=0).tolist() == [3 * 10**9, 10, 0, 10**9] and np.ptp(split.sum(axis=1)) <= 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
