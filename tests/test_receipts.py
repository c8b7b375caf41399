"""Receipts of searches as text."""

from pyspark.sql import functions as F

from lexloom.operators import answers


def test_receipts(spark):
    calls = spark.createDataFrame([(1, 1, "停车", ["未重排：无", "请核对"]), (2, 2, "噪声", None), (3, 3, None, [])], "query_id int, n int, text string, notes array<string>")
    hits = spark.createDataFrame(
        [(1, "a", 2, "《甲》第一条", "原文", ["第二条", "第三条"]), (1, "b", 1, "《乙》第一条", "不再出现", None), (1, "a", 3, "《甲》第一条", "原文", []), (2, "b", 1, "《乙》第一条", "x", None)],
        "query_id int, doc_id string, rank int, citation string, shown string, refs array<string>",
    )
    seen = spark.createDataFrame([(1, "b"), (1, "b"), (2, "b")], "query_id int, doc_id string")
    got = {r.query_id: r.receipt.split("\n") for r in answers.receipt_texts(calls, hits, seen).collect()}
    assert got[1] == [
        "检索#1「停车」｜命中 3 条（新增 2 / 已知 1）", "【1】《乙》第一条（上一轮已给过原文）", "【2】《甲》第一条", "    原文", "    相关条：第二条、第三条", "【3】《甲》第一条（上一轮已给过原文）", "提示：请核对",
    ]
    assert got[2][1].startswith("注意：") and got[2][2:] == ["【1】《乙》第一条（上一轮已给过原文）"]
    assert got[3][0] == "检索#3「」｜命中 0 条（新增 0 / 已知 0）" and got[3][1].startswith("没有命中") and len(got[3]) == 2


def test_failures(spark):
    failed = spark.createDataFrame([(True, 8.0, None), (True, 2.5, None), (False, 8.0, "断开"), (False, 8.0, None)], "late boolean, budget double, message string").coalesce(1)
    got = [(r.receipt.split("。")[0], r.error) for r in answers.failure_receipts(failed, F.col("late"), F.col("budget"), F.col("message")).collect()]
    tail = "秒仍未返回），本次没取到结果"
    assert got == [(f"检索超时（超过 8 {tail}", "检索超时"), (f"检索超时（超过 2.5 {tail}", "检索超时"), ("检索失败：断开", "检索失败"), ("检索失败：", "检索失败")]
