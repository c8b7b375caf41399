import zipfile

from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.operators import answers, corpus, evaluate, ingest, resolve, rewrite, rounds, search, sessions
from lexloom.sources import readers, sinks


def lines(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc string, pos int, text string")


def texts(df):
    return [r.text for r in df.orderBy("doc", "pos").collect()]


def test_denoise(spark):
    raw = ["2025/1/2 10:30 打印", "https://www.gov.cn/x", "中国政府网", "网站标识码 bm01", "29 / 29", "42", "/", "____", "第一条 本规定自发布之日起施行。"]
    assert texts(corpus.denoised(lines(spark, raw))) == ["第一条 本规定自发布之日起施行。"]
    assert texts(corpus.denoised(lines(spark, ["所称“一日”、 “三日”，是指工作日。", "实施 条例"]))) == ["所称“一日”、“三日”，是指工作日。", "实施 条例"]


def test_frequent_lines(spark):
    rows = ["（一）机动车；"] * 3 + ["纯短重复"] * 3 + ["长" * 31] * 3 + ["单"]
    assert texts(corpus.infrequent(lines(spark, rows))) == ["（一）机动车；"] * 3 + ["长" * 31] * 3 + ["单"]


def test_stitching(spark):
    rows = ["第一章 总则", "第一条 甲", "第十八条、第十九条第一款规定的情形，", "应当从重处理。", "第二条 乙", "附则"]
    got = texts(corpus.stitched(lines(spark, rows)))
    assert got == ["第一章 总则", "第一条 甲第十八条、第十九条第一款规定的情形，应当从重处理。", "第二条 乙", "附则"]


def test_doubled_headings(spark):
    assert texts(corpus.without_doubled_headings(lines(spark, ["# 第一章", "第一章 总则", "## 标题", "文", "#"]))) == ["第一章 总则", "标题", "文"]


def test_paragraphs_and_long_parts(spark):
    rows = ["短", "（一）第一项内容比较长，超过十五个字的列表项。", "这是一个足够长的段落，应当单独成为一块。", "很短", "", "另一个足够长的段落，也应当单独成为一块。"]
    got = [r.text for r in corpus.merged_paragraphs(lines(spark, rows)).orderBy("pos").collect()]
    assert got == ["短\n（一）第一项内容比较长，超过十五个字的列表项。", rows[2] + "\n很短", rows[5]]
    text = "一二三。四五六七。八。九十"
    parts = spark.createDataFrame([(text,)], "t string").select(corpus.long_parts(F.col("t"), 5).alias("p")).first().p
    assert parts == ["一二三。四五六七。", "八。九十"] and "".join(parts) == text


LAW = ["测试条例", "目 录", "第一章 总则", "第二章 罚则", "第一章 总则", "第一节 一般", "第一条 甲。见第二条。", "续行。", "第二条 乙。", "第二章 罚则", "散行", "第三条 丙。", "第十一章 算在前条"]


def test_parse(spark):
    articles, left = corpus.parsed(lines(spark, LAW))
    got = articles.orderBy("article_index").collect()
    assert [(a.article_no, a.chapter, a.section, a.text, a.refs) for a in got] == [
        ("第一条", "第一章 总则", "第一节 一般", "第一条甲。见第二条。\n续行。", ["第二条"]),
        ("第二条", "第一章 总则", "第一节 一般", "第二条乙。", []),
        ("第三条", "第二章 罚则", None, "第三条丙。\n第十一章算在前条", []),
    ]
    assert texts(left) == ["散行"]
    many, _ = corpus.parsed(lines(spark, LAW), many=True)
    assert many.orderBy(F.desc("article_index")).first().text == "第三条丙。"
    assert corpus.parsed(lines(spark, ["目录", "第一章 甲"]))[0].count() == 0


def test_parents_and_chunks(spark):
    articles, left = corpus.parsed(lines(spark, LAW))
    full = articles.select("*", F.lit("law_x").alias("law_id"), F.lit("测试条例").alias("law_name"), F.lit("2025-01-01").alias("version"))
    parents, chunks = corpus.parents_and_chunks(full)
    assert parents.orderBy("article_index").first().parent_id == "law_x@2025-01-01#a001"
    first = chunks.orderBy("chunk_id").first()
    assert first.chunk_id == "law_x@2025-01-01#a001#p00" and first.embed_text == "《测试条例》第一章 总则 第一条：甲。见第二条。\n续行。" and first.part_total == 1
    assert corpus.corpus_stats(chunks).first().chunks == 3
    assert sinks.manifest(articles, left).first().leftovers == 1
    assert sinks.markdown(articles).first().markdown.startswith("## 第一章 总则\n\n### 第一节 一般\n\n#### 第一条\n\n")


def test_law_names(spark):
    names = spark.createDataFrame([("road", "中华人民共和国道路交通安全法", 1), ("penal", "中华人民共和国刑法", 2)], "id string, name string, pos int")
    asked = spark.createDataFrame([(1, "道路交通安全法"), (2, "刑法"), (3, "民法典"), (4, ""), (5, "中华人民共和国"), (6, "中华人民共和国刑法")], "k int, name string")
    got = {r.k: r.id for r in resolve.resolved(asked, names, "k").collect()}
    assert got == {1: "road", 2: "penal", 3: None, 4: None, 5: None, 6: "penal"}


def test_locate(spark):
    laws = spark.createDataFrame([("a", "交通法"), ("b", "交通法实施条例")], "law string, name string")
    articles = spark.createDataFrame([("a", 1, 1, "a1"), ("b", 1, 2, "b1"), ("b", 7, 3, "b7")], "law string, no int, pos int, article_id string")
    asked = spark.createDataFrame([(1, "《交通法》第一条"), (2, "交通法实施条例第1条说什么"), (3, "第七条说什么"), (4, "第一条说什么"), (5, "没有"), (6, "交通法第七条")], "k int, text string")
    assert {r.k: r.article_id for r in resolve.located(asked, "k", laws, articles).collect()} == {1: "a1", 2: "b1", 3: "b7"}


def test_as_of_takes_the_latest_only(spark):
    m = spark.createDataFrame([(1, 10, "x"), (1, 60, "y"), (1, 200, "z"), (2, 5, "w")], "d int, pos int, item string")
    laws = spark.createDataFrame([(1, 0, "A"), (1, 55, None), (1, 190, "B"), (2, 6, "C")], "d int, pos int, law string")
    assert [(r.item, r.law) for r in resolve.as_of(m, laws, ["d"], 50).orderBy("pos").collect()] == [("x", "A"), ("z", "B")]


def test_grouping_ties(spark):
    hits = spark.createDataFrame([(1, "b1", 0.3, 1), (1, "a2", 0.3, 2), (1, "a1", 0.3, 3)], "query_id int, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame([("a1", "A", "n"), ("a2", "A", "n"), ("b1", "B", "n")], "chunk_id string, parent_id string, name string")
    got = search.group_to_parents(hits, chunks).orderBy("rank").collect()
    assert [(r.parent_id, r.hit_chunks) for r in got] == [("A", ["a1", "a2"]), ("B", ["b1"])]


def test_rerank_tail(spark):
    rows = [(1, i, str(n), 0.5 - i * 0.001) for i, n in enumerate((1, 5, 9, 13, 20), 1)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, doc_id string, score double").withColumn("q", F.lit("")).withColumn("p", F.lit(""))
    model = F.when(F.col("doc_id") == "1", 0.1).otherwise(0.9)
    got = search.rerank(hits, "q", "p", 2, model).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["5", "1", "9", "13", "20"] and abs(got[2].score - 0.497) < 1e-9
    whole = search.rerank(hits, "q", "p", 0, F.col("doc_id").cast("double")).orderBy("rank").limit(3).collect()
    assert [r.doc_id for r in whole] == ["20", "13", "9"]


def test_single_channel_keeps_its_scores(spark):
    c = spark.createDataFrame([(1, "a", 7.5, 1)], "query_id int, doc_id string, score double, rank int")
    assert search.fuse({"bm25": c}, 5).first().score == 7.5
    assert abs(search.fuse({"x": c, "y": c}, 5).first().score - round(2 / 61, 9)) < 1e-12


def test_merging_rounds(spark):
    hits = spark.createDataFrame([(1, 1, 1, "A"), (1, 1, 2, "B"), (1, 2, 1, "B")], "query_id int, round int, rank int, doc_id string")
    assert [r.doc_id for r in rounds.interleaved(hits, 2).orderBy("place").collect()] == ["A", "B"]
    assert [r.doc_id for r in rounds.interleaved(hits, 1).collect()] == ["A"]
    assert [r.doc_id for r in rounds.concatenated(hits).orderBy("place").collect()] == ["A", "B"]


def test_metrics(spark):
    ranks = lambda *xs: spark.createDataFrame([(x,) for x in xs], "rank int")
    m = evaluate.metrics(ranks(1, 9, None)).first()
    assert (m.hit_at_1, m.hit_at_6, m.pool_recall, m.mrr_at_6) == (0.333333, 0.333333, 0.666667, 0.333333)
    m = evaluate.metrics(ranks(7, 20)).first()
    assert m.mrr_at_6 == 0 and m.pool_recall == 1 and m.mrr > 0
    assert evaluate.metrics(ranks()).first().hit_at_1 == 0
    flags = spark.createDataFrame([(None, True), (None, False)], "dense boolean, bm25 boolean")
    assert {r.channel: (r.hits, r.asked) for r in evaluate.channel_recall(flags, ["dense", "bm25"]).collect()} == {"dense": (0, 0), "bm25": (1, 2)}


def test_common_gold(spark):
    v = spark.createDataFrame([("q", 1, ["b", "a", "c"]), ("q", 2, []), ("q", 3, ["a", "b"]), ("r", 1, []), ("s", 1, ["a"]), ("s", 2, ["b"])], "question string, pos int, gold array<string>")
    assert {r.question: (r.gold, r.reason) for r in evaluate.common_gold(v).collect()} == {"q": (["b", "a"], None), "r": (None, "no citation"), "s": (None, "variants disagree")}


def test_review(spark):
    answers = spark.createDataFrame([(1, [1, 2, 9]), (2, []), (3, [1])], "k int, labels array<int>")
    evidence = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "k int, label int")
    verdicts = spark.createDataFrame([(1, 1, True), (1, 9, True), (3, 1, False)], "k int, label int, supported boolean")
    got = {r.k: (r.total, r.supported, r.score, r.passed) for r in evaluate.review_scores(answers, "k", evidence, verdicts).collect()}
    assert got == {1: (3, 1, 0.333, False), 2: (0, 0, None, True), 3: (1, 0, 0.0, False)}


def test_rate_limit_and_ledgers(spark):
    calls = spark.createDataFrame([(i, k, f"2025-01-01 00:00:{10 + i:02d}") for k in "ab" for i in range(5)], "n int, k string, t string").withColumn("t", F.to_timestamp("t"))
    got = sessions.rate_limited(calls, "k", "t", "n", 3).where("k = 'a'").orderBy("n").collect()
    assert [r.status for r in got] == [200, 200, 200, 429, 429] and got[3].retry_after == 47
    ledger = spark.createDataFrame([("d", 7, 1)], "day string, tokens long, calls long")
    for change, want in (((4, 1), (11, 2)), ((0, 0), (7, 1)), ((1, 0), (8, 1))):
        r = sessions.upserted(ledger, spark.createDataFrame([("d", *change)], "day string, tokens long, calls long"), "day", ["tokens", "calls"]).first()
        assert (r.tokens, r.calls) == want
    newer = spark.createDataFrame([("d", 1, 1, 1), ("d", 2, 2, 2)], "day string, tokens long, calls long, at int")
    assert sessions.replaced(ledger, newer, "day", "at").first().tokens == 2


def test_topics(spark):
    rows = [(1, 1, "new", None), (1, 2, "new", None), (1, 3, "continue", None), (1, 4, "resume", "t1"), (1, 5, "resume", "t9"), (1, 6, "new", None), (1, 7, "unsure", None)]
    t = spark.createDataFrame(rows, "s int, turn int, label string, wanted string")
    assert [r.topic for r in sessions.folded_topics(t, "s").orderBy("turn").collect()] == ["t1", "t2", "t2", "t1", "t1", "t6", "t6"]


def test_ingest_gates(spark):
    rows = [("a.exe", 1, "s1", 1, 0.0), ("b.md", 0, "s2", 1, 0.0), ("c.md", 9 << 20, "s3", 1, 0.0), ("../d.md", 5, "s4", 1, 0.0), ("e.md", 5, "s5", 0, 0.0), ("f.md", 5, "s6", 3, 0.5), ("g.md", 5, "s7", 3, 0.1), ("h.md", 5, "s7", 3, 0.1)]
    files = spark.createDataFrame(rows, "file string, size long, sha1 string, articles int, leftover double")
    assert [r.status for r in ingest.gated(files, "file").orderBy("file").collect()] == ["unsafe name", "suffix", "empty", "too large", "no article", "leftovers", "ready", "duplicate"]


def test_alias_and_hints(spark):
    q = spark.createDataFrame([(1, " 醉驾怎么罚 "), (2, "无关")], "k int, text string")
    got = {r.k: r for r in rewrite.expanded(q, [("醉驾", ["醉酒", "怎么"]), ("驾", ["醉酒", "驾驶"])]).collect()}
    assert got[1].expanded == "醉驾怎么罚 醉酒 驾驶" and got[1].matched == ["醉驾", "驾"] and got[2].expanded == "无关"
    names = spark.createDataFrame([(0, "深圳智能网联条例"), (1, "刑法")], "pos int, name string")
    asked = spark.createDataFrame([(1, "智能网联汽车条例")], "k int, text string")
    assert [(r.hint, r.pos) for r in rewrite.name_hints(asked, names, "k", ["条例"]).collect()] == [("智能网联", 0)]


def test_readers(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>第一章</w:t><w:tab/><w:t>总则</w:t></w:r></w:p><w:p/><w:tbl><w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t></w:r></w:p></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.md").write_bytes("﻿# 甲\r\n\r\n甲 全文\r\n第二行\r\n \r\n## 乙\n\n丙".encode())
    (tmp_path / "d.csv").write_text("no")
    got = readers.paragraphs(spark, str(tmp_path)).orderBy("file", "index").collect()
    assert [(r.file, r["index"], r.text, r.style) for r in got if r.note is None] == [("a.docx", 0, "第一章\t总则", "H1"), ("a.docx", 1, "a\nb", None), ("c.md", 0, "甲 全文\n第二行", None), ("c.md", 1, "乙", None), ("c.md", 2, "丙", None)]
    assert [r.file for r in got if r.note] == ["b.docx"]


def test_index_without_embedder(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "l", None, "red road", "red road"), ("c2", "l", "x", "blue", "blue")], "chunk_id string, law_id string, chapter string, text string, embed_text string")
    assert sinks.build_index(spark, chunks, f"{tmp_path}/i") == ["no embedder: lexical search only"]
    index = sinks.load_index(spark, f"{tmp_path}/i")
    assert index.postings.count() == 3 and index.documents == 2 and index.mean_length == 1.5
    assert spark.read.parquet(f"{tmp_path}/i/chunks").where("chapter = ''").count() == 1


def test_judgments(spark):
    rows = [(1, 'ok {"judgments": [{"n": 1, "supported": "yes"}, {"n": "2", "supported": false}, {"n": "x"}, {"n": 1, "supported": null}]} done'), (2, "no json"), (3, None), (4, '{"judgments": 5}')]
    got = {(r.k, r.n): r.supported for r in answers.judgments(spark.createDataFrame(rows, "k int, text string"), "k").collect()}
    assert got == {(1, 1): None, (1, 2): False}


def test_streams_and_findings(spark):
    frames = spark.createDataFrame([(1, 0, "token", "a"), (1, 1, "answer", "x"), (1, 2, "answer", "y"), (1, 3, "token", "z")], "k int, seq int, kind string, payload string")
    assert answers.last_answers(frames, "k").first().answer == "y"
    pages = spark.createDataFrame([(1, 0, " t" * 60, "s", "2025-01-02T03:04"), (1, 1, "b", None, None)], "query_id int, pos int, title string, snippet string, published string")
    got = answers.findings(pages, start=4).orderBy("label").collect()
    assert [r.label for r in got] == ["[时效5]", "[时效6]"] and len(got[0].title) == 81 and got[0].date == "2025-01-02"


def test_fixed_lists(spark):
    assert len(fixed.ALIASES) == 31 and len(fixed.GENERIC) == 30 and len(fixed.LAW_IDS) == 8
    q = spark.createDataFrame([(1, "酒驾和醉驾入刑")], "k int, text string")
    got = rewrite.expanded(q).first()
    assert got.matched == ["醉驾", "酒驾", "醉驾入刑"]
    assert got.expansions == ["醉酒", "醉酒驾驶", "醉酒后驾驶", "饮酒", "饮酒后驾驶", "饮酒驾驶", "醉酒驾驶机动车", "依法追究刑事责任"]
    names = spark.createDataFrame([(0, "道路运输条例"), (1, "深圳经济特区智能网联汽车管理条例")], "pos int, name string")
    asked = spark.createDataFrame([(1, "智能网联汽车的道路运输")], "k int, text string")
    assert [(r.hint, r.pos) for r in rewrite.name_hints(asked, names, "k").collect()] == [("智能网联汽车", 1)]
