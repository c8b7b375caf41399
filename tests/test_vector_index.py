import numpy as np
import pytest

from lexloom.operators import search, vector_index


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(5000 + i, [1.0] * 16) for i in range(600)]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None] * 8), (9004, [1.0])]
    return spark.createDataFrame(rows, "id long, vector array<double>").persist()


def test_recall_and_reads(spark, table, tmp_path):
    made = vector_index.build(table, str(tmp_path), "id", list_rows=64, most=128, sample=1000, limit=5)
    asked = table.where("id < 1500 and id % 15 = 0").withColumnRenamed("id", "query_id")
    true = {(r.query_id, r.id): r.score for r in search.top_dense(table, asked, 5, "id").collect()}
    got = {(r.query_id, r.id): r.score for r in vector_index.searched(made, asked, 5, key="id").collect()}
    assert len(true) == 500 and len(true.keys() & got.keys()) >= 0.9 * len(true)
    assert all(abs(got[k] - true[k]) < 1e-6 for k in true.keys() & got.keys())
    read = [r.read for r in vector_index.rows_read(made, asked).collect()]
    assert len(read) == 100 and np.mean(read) < 2100 / 3
    everywhere = {(r.query_id, r.id) for r in vector_index.searched(made, asked, 5, key="id", probes=len(made.centroids)).collect()}
    assert everywhere == true.keys()  # all lists: exact
    assert made.rows.count() == 2100 and made.chunks.max() >= 4  # equal vectors lie in chunks
    largest = made.rows.groupBy("list", "chunk").count().agg({"count": "max"}).first()[0]
    assert largest < 3 * 128


def test_added_rows_are_found(spark, table, tmp_path):
    path = str(tmp_path)
    vector_index.build(table.where("id < 1000"), path, "id", list_rows=64, limit=5)
    made = vector_index.add(table.where("id >= 1000 and id < 1500"), path, "id")
    assert made.rows.count() == 1500
    asked = table.where("id >= 1400 and id < 1500").withColumnRenamed("id", "query_id")
    got = {r.query_id for r in vector_index.searched(made, asked, 1, key="id").collect() if r.id == r.query_id}
    assert len(got) == 100


def test_empty(spark, table, tmp_path):
    made = vector_index.build(table.where("id >= 9000 and id < 9004"), str(tmp_path), "id")
    assert vector_index.searched(made, table.limit(3).withColumnRenamed("id", "query_id"), 5).count() == 0


def test_a_query_goes_to_a_group_once(spark, table, tmp_path):
    """What is shuffled grows with queries and groups, not with the lists that a query visits; equal rows don't all come back."""
    made = vector_index.build(table, str(tmp_path), "id", list_rows=8, limit=5)
    asked = table.withColumnRenamed("id", "query_id")
    everywhere, groups = len(made.centroids), vector_index.GROUPS
    assert everywhere > 5 * groups
    sent = vector_index._visits(made, asked, "query_id", everywhere, groups)
    assert sent.count() == 2100 * groups
    assert sent.groupBy("query").agg({"lists": "count"}).where(f"`count(lists)` <> {groups}").count() == 0
    found = vector_index._found(made, asked, 5, "query_id", everywhere)
    assert found.groupBy("query").count().agg({"count": "max"}).first()[0] <= 5 * groups
    true = {(r.query_id, r.rank): r.id for r in search.top_dense(table.where("id < 9000"), asked, 5, "id").collect()}
    assert {(r.query_id, r.rank): r.id for r in vector_index.searched(made, asked, 5, key="id", probes=everywhere).collect()} == true
