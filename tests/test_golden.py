"""Golden sets on small tables."""

from pyspark.sql import functions as F

from lexloom.operators import golden


def test_questions_that_give_their_place_away(spark):
    asked = spark.createDataFrame([(1, " "), (2, "第十条说什么"), (3, "《道路法》说什么"), (4, "道路交通安全法怎么罚"), (5, "怎么罚"), (6, None), (7, "中华人民共和国道路交通安全法怎么罚"), (8, "看民法")], "id int, q string")
    names = spark.createDataFrame([("中华人民共和国道路交通安全法",), ("民法",), ("",), (None,)], "name string")
    got = {r.id: (r.reason, r.alias) for r in golden.guarded(asked, names, "id", "q", "name").collect()}
    assert got == {1: ("empty", None), 2: ("number", None), 3: ("title", None), 4: ("name", "道路交通安全法"), 5: (None, None), 6: ("empty", None), 7: ("name", "中华人民共和国道路交通安全法"), 8: ("name", "民法")}
    assert {r.reason for r in golden.guarded(asked, names.limit(0), "id", "q", "name").collect()} == {"empty", "number", "title", None}


def test_clauses_notes_and_states(spark):
    t = spark.createDataFrame([("为了安全，制定本法。",), ("在境内的人适用本法。",), ("在境内的人适用本法。" + "其他的事情由国务院另行作出规定并且向社会公布。",)], "t string")
    got = [tuple(r) for r in t.select(golden.preamble(F.col("t")), golden.pure_scope(F.col("t"))).collect()]
    assert got == [(True, False), (False, True), (False, False)]
    notes = spark.createDataFrame([(["未重排：无模型", "请核对", None],)], "n array<string>").select(golden.prompt_notes(F.col("n")).alias("n")).first().n
    assert notes == ["请核对"]
    states = spark.createDataFrame([("a", True, "a"), ("a", True, "b"), ("a", False, "b"), (None, True, "b"), ("a", True, "")], "r string, e boolean, a string")
    assert [r[0] for r in states.select(golden.weights_state(F.col("r"), F.col("e"), F.col("a"))).collect()] == ["ok", "mismatch", "unknown", "unknown", "unknown"]
    assert spark.range(1).select(golden.canonical_name(F.lit("法"), F.lit("2021-01-02"), F.lit(".docx"))).first()[0] == "法_20210102.docx"


def test_rows_by_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    keys = spark.createDataFrame([(1, None), (9, "z")], "k int, v string")
    assert sorted(golden.updated(rows, keys, "k").collect(), key=str) == sorted([(1, None), (2, "b"), (None, "c")], key=str)
    assert {tuple(r) for r in golden.touched(rows, keys, "k").collect()} == {(1, True), (9, False)}
    assert {r.v for r in golden.unseen(rows, keys, "k").collect()} == {"b", "c"}
