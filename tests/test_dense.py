import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import search
from lexloom.plans import retrieval


def brute(x, names, limit, allowed=lambda q, r: True):
    with np.errstate(all="ignore"):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    out = {}
    for q, name in enumerate(names):
        rows = [(-scores[q, r], names[r]) for r in range(len(x)) if np.isfinite(scores[q, r]) and allowed(q, r)]
        for rank, (s, key) in enumerate(sorted(rows)[:limit], 1):
            out[name, rank] = key, round(-s, 6)
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_queries_are_dealt_and_find_what_brute_force_finds(spark, monkeypatch, kind):
    monkeypatch.setattr(search, "ROWS", 64)
    monkeypatch.setattr(search, "FEW", 100)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8)).astype(np.float32).astype(float)
    x[100:400] = x[100]  # a large group of copies: ties go to the smaller key
    x[400] = 0
    x[401] = np.nan
    names = [f"k{i:04}" for i in rng.permutation(700)]
    rows = [(n, "ab"[i % 2], [float(v) for v in x[i]]) for i, n in enumerate(names)] + [("short", "a", [1.0]), ("none", "a", None), ("empty", "a", []), ("hole", "a", [None] * 8)]
    table = spark.createDataFrame(rows, f"doc_id string, law string, vector array<{kind}>")
    got = search.top_dense(table, table.select(table.doc_id.alias("query_id"), "vector"), 5).collect()
    want = brute(x, names, 5) | {("short", 1): ("short", 1.0)}
    assert {(r.query_id, r.rank): (r.doc_id, r.score) for r in got} == want
    asked = spark.createDataFrame([(n, ["b"] if i % 3 == 0 else None, [float(v) for v in x[i]]) for i, n in enumerate(names)], f"query_id string, laws array<string>, vector array<{kind}>")
    got = search.top_dense(table.where("size(vector) = 8"), asked, 5).collect()
    assert {(r.query_id, r.rank): (r.doc_id, r.score) for r in got} == brute(x, names, 5, lambda q, r: q % 3 or r % 2)


def test_rows_are_read_once_for_all_queries(spark):
    """The plan doesn't grow with the queries, and these aren't taken to the driver."""
    rows = spark.range(5000).selectExpr("id as doc_id", "array(sin(id), cos(id), 1D) as vector")
    found = search.top_dense(rows, rows.withColumnRenamed("doc_id", "query_id"), 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 3
    assert found.where("rank = 1 and query_id <> doc_id").count() == 0 and found.count() == 10_000


def test_few_queries_find_what_brute_force_finds(spark):
    """Several batches in a task, of which later ones have better rows; laws, widths, and vectors with nothing to compare."""
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.normal(size=(n, 4)).round(1)  # many equal scores
    x[10], x[11, 2], x[12, 0] = 0, np.nan, np.inf
    x[5000:5030] = x[:30] * 3
    names = [f"k{i:04}" for i in rng.permutation(n)]
    rows = [(name, ["a", "b", None][i % 3], [float(v) for v in x[i]]) for i, name in enumerate(names)]
    rows[4000:4000] = [("short", "a", [1.0]), ("none", "a", None), ("empty", "b", []), ("hole", "b", [None, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "doc_id string, law string, vector array<double>").coalesce(1)
    laws = lambda q: [None, ["b"], ["a", "b"], []][q % 4]
    asked = [(names[q], laws(q), [float(v) for v in x[q]]) for q in range(60)] + [("s", ["a"], [2.0]), ("t", ["b"], [2.0])]
    got = search.top_dense(table, spark.createDataFrame(asked, "query_id string, laws array<string>, vector array<double>"), 7).collect()
    allowed = lambda q, r: not laws(q) or ["a", "b", None][r % 3] in laws(q)
    with np.errstate(all="ignore"):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit[:60] @ unit.T, 9)
    want = {("s", 1): ("short", 1.0)}
    for q in range(60):
        best = sorted((-scores[q, r], names[r]) for r in range(n) if np.isfinite(scores[q, r]) and allowed(q, r))[:7]
        want |= {(names[q], i): (key, round(-s, 6)) for i, (s, key) in enumerate(best, 1)}
    assert {(r.query_id, r.rank): (r.doc_id, r.score) for r in got} == want


def test_a_vector_is_computed_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def embed(x: int) -> list[float]:
        ran.add(1)
        return [x / 100, 1.0]

    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.udf(embed, "array<double>")("id").alias("vector"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.doc_id for r in search.top_dense(rows, asked, 2).orderBy("rank").collect()] == [2999, 2998]
    assert ran.value == 3000


def test_letters_are_counted_in_whole_texts(monkeypatch, spark):
    monkeypatch.setattr(retrieval, "_PIECE", 7)
    texts = [None, "", "abc", "Zz é漢字😀 z", "a" * 40 + "q", "", None, "xyz\x00x"]
    want = [t if t is None else [float(t.count(c)) for c in retrieval._LETTERS] for t in texts]
    for low in range(len(texts) + 1):
        assert retrieval._counted(pa.array(texts, pa.string()).slice(low)).to_pylist() == want[low:]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.v for r in frame.select("i", retrieval.letter_counts(F.col("t")).alias("v")).orderBy("i").collect()] == want
