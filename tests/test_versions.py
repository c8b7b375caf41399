"""Signatures of versions against a plain comparison of bags of rows."""

import random
from collections import Counter, defaultdict

import pytest

from lexloom.sources import versions

SCHEMA = "id string, v int, tags array<string>, m map<string,int>"


def bags(rows):
    out = defaultdict(Counter)
    for k, *v in rows:
        out[k][repr(v)] += 1
    return out


def plain(old, new):
    a, b = bags(old), bags(new)
    state = lambda k: "missing" if not b[k] else "extra" if not a[k] else "changed"
    return {(k, state(k), a[k].total(), b[k].total()) for k in {*a, *b} if a[k] != b[k]}


@pytest.fixture
def signed(spark, tmp_path):
    def run(rows, name, like=None, **more):
        versions.sign(spark.createDataFrame(rows, SCHEMA), "id", f"{tmp_path}/{name}", like and f"{tmp_path}/{like}", **more)
        return f"{tmp_path}/{name}"

    return run


def test_bags_of_rows(spark, signed):
    rng = random.Random(3)
    old = [(rng.choice([None, *map(str, range(300))]), rng.choice([None, 1, 2]), rng.choice([None, [], ["a", None], [None, "a"], ["a"]]), {"x": 1}) for _ in range(900)]
    new = [(k, v, t, m) for k, v, t, m in old if rng.random() > 0.02] + [("new", 1, None, None), (None, 7, [], {})]
    new = [(k, 9, t, m) if rng.random() < 0.02 else (k, v, t, m) for k, v, t, m in new]
    rng.shuffle(new)
    a, b = signed(old, "a", rows_per_leaf=20), signed(new, "b", "a")
    got = {tuple(r) for r in versions.differences(spark, a, b, "id").collect()}
    assert got == plain(old, new)
    assert 0 < len(versions.odd_leaves(spark, a, b)) < 64
    row = versions.verdict(spark, a, b, "id").first()
    assert row.verdict == ("count" if len(old) != len(new) else "position") and row.first_key is None and row.position == 1


def test_nulls_are_told_apart(spark, signed):
    old = [("1", None, ["a", None], None), ("2", 1, [], None)]
    new = [("1", None, [None, "a"], None), ("2", 1, None, None)]
    a, b = signed(old, "a"), signed(new, "b", "a")
    assert {r.id for r in versions.differences(spark, a, b, "id").collect()} == {"1", "2"}


def test_only_odd_leaves_are_read(spark, signed):
    old = [(str(i), i, None, None) for i in range(2000)]
    new = [(k, -1 if k == "77" else v, t, m) for k, v, t, m in old]
    a, b = signed(old, "a", rows_per_leaf=50), signed(new, "b", "a")
    odd = versions.odd_leaves(spark, a, b)
    assert len(odd) == 1
    found = versions.differences(spark, a, b, "id")
    assert [tuple(r) for r in found.collect()] == [("77", "changed", 1, 1)]
    scans = [line for line in found._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]
    assert scans and all("PartitionFilters: []" not in line for line in scans)
    row = versions.verdict(spark, a, b, "id").first()
    assert (row.verdict, row.first_key, row.position) == ("position", "77", 1 + sum(str(i) < "77" for i in range(2000)))


def test_same_swapped_and_empty(spark, signed):
    old = [("1", 1, None, None), ("2", 2, None, None)]
    a, same, swapped, none = signed(old, "a"), signed(old[::-1], "s", "a"), signed([("1", 2, None, None), ("2", 1, None, None)], "w", "a"), signed([], "n", "a")
    assert versions.verdict(spark, a, same, "id").first().verdict == "same"
    assert versions.differences(spark, a, same, "id").count() == 0
    assert versions.differences(spark, a, swapped, "id").count() == 2
    assert {(r.id, r.state) for r in versions.differences(spark, a, none, "id").collect()} == {("1", "missing"), ("2", "missing")}
    after = signed(old, "x", "n")
    assert {(r.id, r.state) for r in versions.differences(spark, none, after, "id").collect()} == {("1", "extra"), ("2", "extra")}
    assert versions.verdict(spark, none, none, "id").first().verdict == "same"


def test_bytes_only(spark, tmp_path):
    for name, line in (("a", '{"v":1}'), ("b", '{"v": 1}')):
        rows = spark.createDataFrame([("1", 1, line)], "id string, v int, line string")
        versions.sign(rows, "id", f"{tmp_path}/{name}", f"{tmp_path}/a" if name == "b" else None, raw="line")
    assert versions.verdict(spark, f"{tmp_path}/a", f"{tmp_path}/b", "id").first().verdict == "bytes"


def test_other_leaves_are_an_error(spark, signed):
    rows = [(str(i), i, None, None) for i in range(100)]
    with pytest.raises(ValueError):
        versions.odd_leaves(spark, signed(rows, "a", rows_per_leaf=10), signed(rows, "b"))
