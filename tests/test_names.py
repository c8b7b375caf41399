from pyspark.sql import functions as F

from lexloom.operators import names, resolve


def test_occurrences_against_plain_search(spark):
    texts = [(1, "abcabcab"), (2, ""), (3, None), (4, "x民法典y中华人民共和国民法典"), (5, "aaaa 😀aa"), (6, "none")] + [(7, "bca")] * 2
    known = ["abc", "bca", "a", "aa", "民法典", "中华人民共和国民法典", "", None, "abc", "😀a"]
    rows = spark.createDataFrame(texts, "k int, text string")
    named = spark.createDataFrame([(n,) for n in known], "name string")
    want = sorted((k, n, i + 1, i + 1 + len(n)) for k, t in texts for n in {n for n in known if n} for i in range(len(t or "")) if t.startswith(n, i))
    for chars in (10**6, 4):
        assert sorted(map(tuple, names.occurrences(rows, named, "k", shard_chars=chars).collect())) == want
    assert names.occurrences(rows, named.where("false"), "k").count() == 0
    assert names.occurrences(rows.where("false"), named, "k").count() == 0


def test_substrings(spark):
    got = spark.createDataFrame([("aba",), ("",), (None,)], "s string").select(names.substrings(F.col("s")).alias("p")).collect()
    assert sorted(got[0].p) == ["a", "ab", "aba", "b", "ba"] and got[1].p == [] and not got[2].p


def test_cross_law_and_two_tiers(spark):
    laws = spark.createDataFrame([(1, "中华人民共和国民法典", 0), (2, "道路交通安全法", 1), (3, "实施条例", 2), (4, "交通安全法", 3)], "law int, name string, pos int")
    articles = spark.createDataFrame([("a", 1, "依照《道路交通安全法》"), ("b", 2, "《道路交通安全法》本法"), ("c", 3, "《民法典》和《没有》"), ("d", 2, None), ("e", 1, "《民法典》")], "article_id string, law int, text string")
    assert sorted(r.article_id for r in resolve.cross_law(articles, laws.select("law", "name")).collect()) == ["a", "c"]
    said = spark.createDataFrame([(1, "民法典"), (2, "交通安全法"), (3, "安全法"), (4, "某市道路交通安全法"), (5, "实施"), (6, "")], "k int, name string")
    known = laws.withColumnRenamed("law", "id")
    three = {r.k: (r.id, r.candidates) for r in resolve.resolved(said, known, "k").collect()}
    assert three[1] == (1, None) and three[2] == (4, None) and three[3] == (None, ["交通安全法", "道路交通安全法"]) and three[5] == (3, None) and three[6] == (None, None)
    assert three[4] == (None, ["交通安全法", "道路交通安全法"])
    two = {r.k: r.id for r in resolve.resolved(said, known, "k", tiers=2).collect()}
    assert two == {1: 1, 2: 4, 3: None, 4: None, 5: None, 6: None}
