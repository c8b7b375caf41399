"""Queries of evaluation, gold sets and review."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import answers, evaluate, fragments, search, sessions
from lexloom.plans.retrieval import _bm25_sql, corpus_index
from lexloom.plans.tables import Book, table
from lexloom.session import scratch_folder
from lexloom.sources import versions

BOOK = Book()

_POOL = f"{_bm25_sql()}, h AS (SELECT item_id, k AS doc_id, rank FROM r WHERE rank <= 20), gold AS (SELECT item_id, doc_id, source FROM benchmark b JOIN documents d ON contains(d.text, b.text)), res AS (SELECT b.item_id, (SELECT min(rank) FROM h JOIN gold g USING (item_id, doc_id) WHERE h.item_id = b.item_id) AS rank FROM benchmark b)"
_METRICS = "count(*) AS n, coalesce(round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6), 0) AS hit_at_1, coalesce(round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6), 0) AS hit_at_3, coalesce(round(avg(CASE WHEN rank <= 6 THEN 1.0::DOUBLE ELSE 0 END), 6), 0) AS hit_at_6, coalesce(round(sum(CASE WHEN rank <= 6 THEN 1.0::DOUBLE / rank ELSE 0 END) / count(*), 6), 0) AS mrr_at_6, coalesce(round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6), 0) AS mrr, count(rank) AS pool_hits, coalesce(round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6), 0) AS pool_recall"


def _gold(spark, sf_dir):
    """Documents that hold a benchmark passage word for word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    found = evaluate.holders(table(spark, sf_dir, "benchmark").select("item_id", "text"), docs, "item_id", "doc_id")
    return found.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("item_id", "doc_id", "source")


def _results(spark, sf_dir, gold):
    cases = table(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = search.top_bm25(corpus_index(spark, sf_dir), cases, 20, "item_id")
    return evaluate.first_ranks(cases, gold.select("item_id", "doc_id"), hits, "item_id")


@BOOK.query(f"WITH {_POOL} SELECT {_METRICS} FROM res")
def q_hit_mrr(spark, sf_dir):
    return evaluate.metrics(_results(spark, sf_dir, _gold(spark, sf_dir)))


@BOOK.query(f"WITH {_POOL} SELECT source, {_METRICS} FROM (SELECT DISTINCT item_id, source FROM gold) JOIN res USING (item_id) GROUP BY source")
def q_by_source_hit3(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    return evaluate.metrics(_results(spark, sf_dir, gold).join(gold.select("item_id", "source").distinct(), "item_id"), by=["source"])


@BOOK.query("""WITH c AS (SELECT unnest(['quality', 'toxic', 'long']) AS channel, unnest([CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality = 1 END, CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.toxic = 1 END, d.n_chars > 1000]) AS flag FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT channel, count(*) FILTER (flag) AS hits, count(flag) AS asked FROM c GROUP BY channel""")
def q_pool_channel_recall(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate.channel_recall(joined.select((F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"), (F.col("n_chars") > 1000).alias("long")), ["quality", "toxic", "long"])


@BOOK.query("""WITH x AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS arm, user_id AS query_id, event_id % 50 AS doc_id FROM events), g AS (SELECT DISTINCT user_id AS query_id, event_id % 50 AS doc_id FROM events WHERE event_type = 'purchase'),
 f AS (SELECT arm, count(DISTINCT (query_id, doc_id)) AS golds, count(DISTINCT query_id) AS questions_hit FROM x SEMI JOIN g USING (query_id, doc_id) GROUP BY arm)
 SELECT arm, count(DISTINCT query_id) AS questions, round(count(*) / count(DISTINCT query_id), 6) AS per_question, coalesce(any_value(golds), 0) AS golds, coalesce(any_value(questions_hit), 0) AS questions_hit FROM x LEFT JOIN f USING (arm) GROUP BY arm""")
def q_arm_compare(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("arm"), F.col("user_id").alias("query_id"), (F.col("event_id") % 50).alias("doc_id"))
    gold = e.where("event_type = 'purchase'").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 50).alias("doc_id"))
    return evaluate.compare_arms(runs, gold)


@BOOK.query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT source, max(n_chars) FILTER (nth = n // 2 + 1) AS upper_median, max(n_chars) AS largest FROM r GROUP BY source""")
def q_upper_median(spark, sf_dir):
    return evaluate.upper_median(table(spark, sf_dir, "documents"), "n_chars", ["source"])


@BOOK.query("""WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
 p AS (SELECT conv_id, turn, text AS q, CASE WHEN nr = 'assistant' THEN nt END AS a FROM n WHERE role = 'user'),
 x AS (SELECT conv_id, turn, i, substr(q, i, 1) AS c FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM p)), y AS (SELECT conv_id, turn, j, substr(a, j, 1) AS c FROM (SELECT *, unnest(range(1, length(a) + 1)) AS j FROM p)),
 r AS (SELECT conv_id, turn, i, i - j AS d, i - row_number() OVER (PARTITION BY conv_id, turn, i - j ORDER BY i) AS g FROM x JOIN y USING (conv_id, turn, c)),
 l AS (SELECT conv_id, turn, count(*) AS n, min(i) AS i FROM r GROUP BY conv_id, turn, d, g),
 b AS (SELECT conv_id, turn, max(n) AS n, arg_min(i, i - 1000000 * n) AS i FROM l GROUP BY conv_id, turn)
 SELECT p.conv_id, p.turn, CASE WHEN q IS NULL OR a IS NULL THEN NULL ELSE CAST(coalesce(n, 0) AS INTEGER) END AS overlap, CASE WHEN q IS NULL OR a IS NULL THEN NULL ELSE coalesce(substr(q, i, n), '') END AS part FROM p LEFT JOIN b USING (conv_id, turn)""")
def q_overlap_lengths(spark, sf_dir):
    """How much of each question is copied from its answer: their longest common part."""
    pairs = sessions.turn_pairs(table(spark, sf_dir, "conversations"), "conv_id").withColumn("case", F.struct("conv_id", "turn"))
    found = fragments.overlaps(pairs, pairs.select("case", F.col("answer").alias("text")), "case")
    return found.select("case.conv_id", "case.turn", "overlap", "part")


_VARIANTS = "v AS (SELECT user_id AS question, event_id AS pos, list_sort(list_distinct([(event_id % 3), (user_id % 3)])) AS gold0, event_type FROM events), w AS (SELECT question, pos, CASE WHEN event_type = 'view' THEN [] ELSE gold0 END AS gold FROM v)"
_COMMON = f"{_VARIANTS}, c AS (SELECT * FROM w WHERE len(gold) > 0), n AS (SELECT question, count(*) AS n, arg_min(gold, pos) AS first FROM c GROUP BY question), e AS (SELECT question, key, count(*) AS c FROM (SELECT question, unnest(gold) AS key FROM c) GROUP BY ALL), k AS (SELECT question, string_agg(key, ' ' ORDER BY list_position(first, key)) AS gold FROM n JOIN e USING (question) WHERE c = n AND list_contains(first, key) GROUP BY question), o AS (SELECT question, gold, CASE WHEN n IS NULL THEN 'no citation' WHEN gold IS NULL THEN 'variants disagree' END AS reason FROM (SELECT DISTINCT question FROM w) LEFT JOIN n USING (question) LEFT JOIN k USING (question))"


def _common(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pair = F.array_sort(F.array_distinct(F.array(F.col("event_id") % 3, F.col("user_id") % 3)))
    gold = F.when(F.col("event_type") == "view", F.array().cast("array<bigint>")).otherwise(pair)
    return evaluate.common_gold(e.select(F.col("user_id").alias("question"), F.col("event_id").alias("pos"), gold.alias("gold"))).withColumn("gold", F.array_join("gold", " "))


@BOOK.query(f"WITH {_COMMON} SELECT * FROM o")
def q_variant_intersection(spark, sf_dir):
    return _common(spark, sf_dir)


@BOOK.query(f"WITH {_COMMON} SELECT CASE WHEN gold IS NULL THEN 'nogold' WHEN question % 2 = 0 THEN 'reference' ELSE 'retrieval' END AS bucket, count(*) AS n FROM o GROUP BY 1")
def q_bucket_split(spark, sf_dir):
    t = _common(spark, sf_dir)
    return t.groupBy(evaluate.bucket_of(F.col("gold"), F.col("question") % 2 == 0).alias("bucket")).agg(F.count("*").alias("n"))


@BOOK.query("""WITH a AS (SELECT doc_id, n_chars % 5 AS v FROM documents WHERE doc_id % 4 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 7 ELSE n_chars % 5 END AS v FROM documents WHERE doc_id % 6 <> 0)
 SELECT doc_id, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'extra' ELSE 'changed' END AS state FROM a FULL JOIN b USING (doc_id) WHERE a.v IS DISTINCT FROM b.v""")
def q_dataset_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 5).alias("v"))
    new = d.where("doc_id % 6 <> 0").withColumn("v", F.when(F.col("doc_id") % 9 == 0, F.lit(7).cast("long")).otherwise(F.col("v")))
    return evaluate.drift(d.where("doc_id % 4 <> 0"), new, "doc_id")


_CLEAN = "[0-9]{4,}"


@BOOK.query(f"""WITH a AS (SELECT doc_id, lang, text FROM documents), b AS (SELECT doc_id, lang, regexp_replace(text, '{_CLEAN}', '#', 'g') AS text FROM documents WHERE n_chars >= 200 UNION ALL SELECT -1 - item_id, NULL, text FROM benchmark)
 SELECT doc_id, CASE WHEN b.text IS NULL THEN 'missing' WHEN a.text IS NULL THEN 'extra' ELSE 'changed' END AS state, CASE WHEN a.text IS NULL THEN 0 ELSE 1 END::BIGINT AS old_rows, CASE WHEN b.text IS NULL THEN 0 ELSE 1 END::BIGINT AS new_rows FROM a FULL JOIN b USING (doc_id) WHERE a.text IS DISTINCT FROM b.text""")
def q_version_diff(spark, sf_dir):
    """The documents against a version with numbers masked, short ones dropped and the benchmark's passages added."""
    old, new = _versions(spark, sf_dir)
    return versions.differences(spark, old, new, "doc_id")


@BOOK.query(f"""WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, regexp_replace(text, '{_CLEAN}', '#', 'g') AS text FROM documents WHERE n_chars >= 200 UNION ALL SELECT -1 - item_id, text FROM benchmark),
 f AS (SELECT min(doc_id) AS k FROM a FULL JOIN b USING (doc_id) WHERE a.text IS DISTINCT FROM b.text), n AS (SELECT (SELECT count(*) FROM a) AS old_rows, (SELECT count(*) FROM b) AS new_rows)
 SELECT CASE WHEN old_rows <> new_rows THEN 'count' WHEN k IS NULL THEN 'same' ELSE 'position' END AS verdict, old_rows, new_rows, k AS first_key, CASE WHEN k IS NOT NULL THEN (SELECT count(*) FROM a WHERE doc_id < k) + 1 END AS position FROM f, n""")
def q_version_verdict(spark, sf_dir):
    """The same two versions in one row: counts, and where in order of the key they first differ."""
    old, new = _versions(spark, sf_dir)
    return versions.verdict(spark, old, new, "doc_id")


def _versions(spark, sf_dir) -> tuple[str, str]:
    """Signatures of both versions, written for this call."""
    folder = f"{scratch_folder(spark, 'versions')}/{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    extra = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit(None).cast("string").alias("lang"), "text")
    new = d.where("n_chars >= 200").select("doc_id", "lang", F.regexp_replace("text", _CLEAN, "#").alias("text")).unionByName(extra)
    versions.sign(d.drop("n_chars"), "doc_id", f"{folder}/old")
    versions.sign(new, "doc_id", f"{folder}/new", like=f"{folder}/old")
    return f"{folder}/old", f"{folder}/new"


@BOOK.query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY turn, p_brand) AS INTEGER) AS place FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) QUALIFY row_number() OVER (ORDER BY turn, p_brand) <= 200")
def q_round_robin_candidates(spark, sf_dir):
    return evaluate.round_robin(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 200).select("p_partkey", "place")


@BOOK.query(r"""WITH a AS (SELECT doc_id, list_distinct([CAST(doc_id % 4 AS INTEGER), CAST(doc_id % 7 AS INTEGER), CAST(n_chars % 5 AS INTEGER)]) AS labels FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, [] FROM documents WHERE doc_id % 10 = 3),
 c AS (SELECT doc_id, unnest(labels) AS label FROM a), j AS (SELECT c.doc_id, c.label < 5 AND l.doc_id IS NOT NULL AND (l.quality + c.label) % 2 = 1 AS good FROM c LEFT JOIN labels l USING (doc_id)),
 s AS (SELECT doc_id, count(*) AS total, count(*) FILTER (good) AS supported FROM j GROUP BY doc_id)
 SELECT a.doc_id, coalesce(total, 0) AS total, coalesce(supported, 0) AS supported, round(supported / total, 3) AS score, coalesce(NOT round(supported / total, 3) < 0.35, true) AS passed FROM a LEFT JOIN s USING (doc_id)""")
def q_review_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    three = F.array(*[F.col(c).cast("int") for c in ("a", "b", "c")])
    labels = F.array_distinct(three)
    answers = d.select("doc_id", (F.col("doc_id") % 4).alias("a"), (F.col("doc_id") % 7).alias("b"), (F.col("n_chars") % 5).alias("c"))
    answers = answers.select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.array().cast("array<int>")).otherwise(labels).alias("labels"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("label")
    verdicts = table(spark, sf_dir, "labels").select("doc_id", "quality", numbers).select("doc_id", "label", ((F.col("quality") + F.col("label")) % 2 == 1).alias("supported"))
    return evaluate.review_scores(answers, "doc_id", d.select("doc_id", numbers), verdicts)


@BOOK.query("SELECT doc_id, CASE WHEN f = 0 THEN 'miss' WHEN f < 2 AND c > 0 THEN 'partial' WHEN c = 0 THEN 'uncited' WHEN c < f THEN 'half cited' WHEN f < 2 THEN 'partial' ELSE 'all' END AS failure FROM (SELECT doc_id, doc_id % 3 AS f, n_chars % 3 AS c FROM documents)")
def q_failure_taxonomy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evaluate.failure_class(F.col("doc_id") % 3, F.col("n_chars") % 3, F.lit(2)).alias("failure"))


_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


def _long_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return d.withColumn("rank", rank).select(F.col("source").alias("query_id"), "doc_id", "rank", F.concat(F.lit("《"), "lang", F.lit("》")).alias("citation"), "text")


@BOOK.query(f"""WITH {_TOP}, e AS (SELECT source AS query_id, string_agg('【依据' || rank || '】' || '《' || lang || '》' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS block FROM t WHERE rank <= 3 AND source <> 'src1' GROUP BY source)
 SELECT q.query_id, block || chr(10) || chr(10) || '问题：' || q.query_id AS prompt, CASE WHEN block IS NULL THEN 'empty' ELSE 'unavailable' END AS route FROM (SELECT DISTINCT source AS query_id FROM documents) q LEFT JOIN e USING (query_id)""")
def q_answer_prompt(spark, sf_dir):
    labelled = answers.evidence(_long_documents(spark, sf_dir).where("query_id <> 'src1'"), top_n=3)
    asked = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id")).distinct().withColumn("text", F.col("query_id"))
    return answers.answered(answers.prompts(asked, labelled)).select("query_id", "prompt", "route")


@BOOK.query("""WITH h AS (SELECT user_id AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, event_id % 3 = 0 AS known FROM events)
 SELECT query_id, count(*) FILTER (NOT known) AS fresh, count(*) FILTER (known) AS seen, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) FILTER (rank <= 3) AS first FROM h GROUP BY query_id""")
def q_tool_receipts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"))
    hits = e.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")))
    return answers.receipts(hits, e.where("doc_id % 3 = 0")).withColumn("first", F.array_join("first", " "))


@BOOK.query("""WITH h AS (SELECT user_id AS query_id, event_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 3 = 0 AS known FROM events WHERE user_id % 5 <> 0),
 p AS (SELECT query_id, count(*) AS total, count(*) FILTER (NOT known) AS fresh, string_agg('【' || n || '】《' || event_type || '》' || CASE WHEN known THEN '（上一轮已给过原文）' ELSE chr(10) || '    ' || coalesce(props, '') END || CASE WHEN event_id % 4 = 0 THEN chr(10) || '    相关条：' || event_type || '、' || event_id ELSE '' END, chr(10) ORDER BY n) AS lines FROM h GROUP BY query_id),
 c AS (SELECT DISTINCT user_id AS query_id FROM events)
 SELECT query_id, md5('检索#' || query_id || '「用户' || query_id || '」｜命中 ' || coalesce(total, 0) || ' 条（新增 ' || coalesce(fresh, 0) || ' / 已知 ' || (coalesce(total, 0) - coalesce(fresh, 0)) || '）'
  || CASE WHEN total IS NULL THEN chr(10) || '没有命中的法条。请换一组更接近法条原文的关键词，或补上具体违法情形与地点后重试。' WHEN fresh = 0 THEN chr(10) || '注意：本轮没有新增法条，与之前的检索重复。换个完全不同的角度，或直接结束检索。' ELSE '' END
  || coalesce(chr(10) || lines, '') || CASE WHEN query_id % 2 = 0 THEN chr(10) || '提示：请核对' ELSE '' END) AS digest FROM c LEFT JOIN p USING (query_id)""")
def q_receipt_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), "event_type", "props")
    name, even = F.concat(F.lit("用户"), "query_id"), F.col("query_id") % 2 == 0
    notes = F.when(even, F.array(F.lit("未重排：没有模型"), F.lit("请核对")))
    calls = e.select("query_id").distinct().select("query_id", F.col("query_id").alias("n"), name.alias("text"), notes.alias("notes"))
    refs = F.when(F.col("doc_id") % 4 == 0, F.array("event_type", F.col("doc_id").cast("string")))
    hits = e.where("query_id % 5 <> 0").select("query_id", "doc_id", F.col("doc_id").alias("rank"), F.concat(F.lit("《"), "event_type", F.lit("》")).alias("citation"), F.col("props").alias("shown"), refs.alias("refs"))
    return answers.receipt_texts(calls, hits, e.where("doc_id % 3 = 0")).select("query_id", F.md5(F.col("receipt").cast("binary")).alias("digest"))
