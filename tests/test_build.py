"""Stages against recounts, and each way of the gate."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import build

SCHEMA = "id long, text string"
STAGES = [
    build.Stage("lines", lambda d: d.select("id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''"), {"chars": "sum(length(line))"}),
    build.Stage("words", lambda d: d.select(F.explode(F.split("line", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), {"all": "sum(n)", "most": "max(n)"}),
]
ROWS = [(1, "a b\n\nb c"), (2, None), (3, "a"), (3, "a")]


@pytest.fixture
def source(spark):
    return lambda rows=ROWS: spark.createDataFrame(rows, SCHEMA)


def test_report_is_the_recount(spark, source, tmp_path):
    got = build.run(source(), str(tmp_path), STAGES).orderBy("place").collect()
    assert [(r.stage, r.rows_in, r.rows_out, r.measures) for r in got] == [("lines", 4, 4, {"chars": 8}), ("words", 4, 3, {"all": 6, "most": 3})]
    for r in got:
        assert r.rows_out == spark.read.parquet(f"{tmp_path}/{r.stage}").count() and r.elapsed_ms >= 0
    again = build.run(source([(1, None)]), str(tmp_path), STAGES).orderBy("place").collect()
    assert [(r.rows_in, r.rows_out, r.measures) for r in again] == [(1, 0, {"chars": 0}), (0, 0, {"all": 0, "most": 0})]


def test_each_way_of_the_gate(spark, source, tmp_path):
    root = str(tmp_path)

    def ask(rows=ROWS, **more):
        r = build.ensure_ready(source(rows), root, STAGES, **({"model": "m"} | more))
        return r.action, r.reason

    with pytest.raises(build.NotReady, match="no source rows"):
        ask([])
    assert ask() == ("rebuild", "no snapshot")
    assert ask(ROWS[::-1]) == ("reuse", "up to date")
    assert ask(ROWS[1:]) == ("rebuild", "row count")
    assert ask([(2, ""), *ROWS[2:]]) == ("rebuild", "rows changed")
    with pytest.raises(build.NotReady, match="other model"):
        ask(model="n")
    assert build.snapshot(spark, root).model == "m"
    assert ask(model="n", allow=True) == ("rebuild", "allowed")
    assert ask(model=None, rebuild=True) == ("rebuild", "asked for")
    assert ask([(2, ""), *ROWS[2:]], model=None) == ("rebuild", "row count")
    spark.read.parquet(f"{root}/words").limit(0).write.mode("overwrite").parquet(f"{root}/words")
    assert ask([(2, ""), *ROWS[2:]], model=None) == ("rebuild", "rows differ")
    assert ask([(2, ""), *ROWS[2:]], model=None) == ("reuse", "up to date")


def test_a_build_that_breaks_off_counts_as_none(spark, source, tmp_path):
    root = str(tmp_path)
    build.ensure_ready(source(), root, STAGES)
    broken = [STAGES[0], build.Stage("words", lambda d: d.select(F.raise_error(F.lit("broken")).alias("word"), F.lit(1).alias("n")))]
    with pytest.raises(Exception, match="broken"):
        build.ensure_ready(source(), root, broken, rebuild=True)
    assert build.snapshot(spark, root) is None
    assert build.ensure_ready(source(), root, STAGES).reason == "no snapshot"
