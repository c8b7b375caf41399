from pyspark.sql import functions as F

from lexloom.functions import text as T


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("x")).first().x


def test_numerals(spark):
    want = {"一百二十三": 123, "十": 10, "二十": 20, "一千零五": 1005, "百": 100, "零": 0, "零零": None, "": None, "一二x": None, "九": 9}
    for numeral, n in want.items():
        assert one(spark, T.cn_to_int(F.col("a")), a=numeral) == n, numeral


def test_article_number(spark):
    for raw, n in {"第十八条": 18, "第 18 条": 18, "21": 21, "²": None, " ": None, "第条": None}.items():
        assert one(spark, T.article_number(F.col("a")), a=raw) == n, raw


def test_clean_and_trim(spark):
    assert one(spark, T.clean(F.col("a")), a="　实施 \t条例​ x y　") == "实施条例 x y"
    assert one(spark, T.squeeze(F.col("a")), a=" 目　录 ") == "目录"


def test_references_keep_their_order(spark):
    assert one(spark, T.references(F.col("a"), F.lit("第一条")), a="第三条、第一条和第二条，第三条") == ["第三条", "第二条"]


def test_bigrams(spark):
    for text, want in {"": [""], " ": [""], "a": ["a"], "aba b": ["ab", "ba"], "ab": ["ab"]}.items():
        assert one(spark, T.bigrams(F.col("a")), a=text) == want, text


def test_terms(spark):
    assert one(spark, T.terms(F.col("a")), a="Road 12B 交通法 x") == ["road", "12b", "x", "交通", "通法"]
    assert one(spark, T.terms(F.col("a")), a="No Chinese-here") == ["no", "chinese", "here"]


def test_citations_and_booleans(spark):
    assert one(spark, T.cited_labels(F.col("a")), a="见[依据3]与【依据 1】，再[依据3]；[依据2】") == [3, 1, 2]
    assert [one(spark, T.tolerant_boolean(F.col("a")), a=x) for x in ("True", " no ", "1", "maybe")] == [True, False, True, None]
    assert one(spark, T.braces(F.col("a")), a='so {"a": {"b": 1}} it is') == '{"a": {"b": 1}}'
    assert one(spark, T.braces(F.col("a")), a="none") is None


def test_segments(spark):
    got = one(spark, T.segments(F.col("a")), a="甲[依据1]乙【时效 2】[材料3】丙")
    assert [(s.kind, s.text) for s in got] == [("text", "甲"), ("ref", "[依据1]"), ("text", "乙"), ("ref", "【时效 2】"), ("text", "[材料3】丙")]


def test_files_and_ids(spark):
    assert one(spark, T.file_version(F.col("a")), a="某条例_20250101") == "2025-01-01"
    assert one(spark, T.file_version(F.col("a")), a="某条例") == "unknown"
    assert one(spark, T.file_law_name(F.col("a")), a="某条例_20250101") == "某条例"
    assert one(spark, T.law_id(F.col("a"), {"甲": "first"}), a="甲") == "first"
    assert one(spark, T.law_id(F.col("a"), {"甲": "first"}), a="乙").startswith("law_")
    assert one(spark, T.valid_doc_id(F.col("a")), a="0123456789ab") and not one(spark, T.valid_doc_id(F.col("a")), a="../etc")
    assert one(spark, T.plain_law_name(F.col("a")), a="中华人民共和国刑法") == "刑法"


def test_times(spark):
    assert one(spark, T.seconds_to_midnight(F.timestamp_seconds(F.col("a").cast("long"))), a="0") == 86400
    assert one(spark, T.seconds_to_midnight(F.timestamp_seconds(F.col("a").cast("long"))), a="86399") == 1
    # 2022-02-22 19:22:22 UTC, the example of the UUID standard.
    assert abs(one(spark, T.uuid6_seconds(F.col("a")), a="1EC9414C-232A-6B00-B3C8-9F6BDECED846") - 1645557742) < 1
    assert one(spark, T.uuid6_seconds(F.col("a")), a="1EC9414C-232A-4B00-B3C8-9F6BDECED846") is None


def test_clamp_and_clip(spark):
    assert [one(spark, T.clamp(F.col("a"), 1, 20, 6), a=x) for x in ("0", "7", "99", "x")] == [1, 7, 20, 6]
    assert one(spark, T.clip(F.col("a"), 3), a="abcd") == "abc…"
