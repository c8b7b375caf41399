"""Queries of golden sets, and of rows changed by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import golden
from lexloom.plans.tables import Book, table

BOOK = Book()


def _users(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.concat_ws("/", "conv_id", "turn").alias("place"), "text")


@BOOK.query("""WITH n AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS word FROM benchmark) WHERE length(word) >= 6),
 q AS (SELECT conv_id || '/' || turn AS place, trim(coalesce(text, '')) AS t FROM conversations WHERE role = 'user'),
 m AS (SELECT place, word, row_number() OVER (PARTITION BY place ORDER BY length(word) DESC, word) AS r FROM q JOIN n ON contains(t, word))
 SELECT q.place, CASE WHEN t = '' THEN 'empty' WHEN word IS NOT NULL THEN 'name' END AS reason, word AS alias FROM q LEFT JOIN m ON m.place = q.place AND r = 1""")
def q_question_guard(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("word")).where(F.length("word") >= 6).distinct()
    return golden.guarded(_users(spark, sf_dir), words, "place", "text", "word")


@BOOK.query("SELECT min(conv_id || '/' || turn) AS place, lower(text) AS text, count(*) - 1 AS dropped FROM conversations WHERE role = 'user' GROUP BY lower(text)")
def q_first_asked(spark, sf_dir):
    return golden.first_asked(_users(spark, sf_dir).withColumn("text", F.lower("text")), F.col("text"), "place")


@BOOK.query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def q_unseen(spark, sf_dir):
    return golden.unseen(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


_ARM = "r AS (SELECT CASE WHEN event_type <> 'view' THEN event_id END AS located, value > 50 AS is_gold, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS rank FROM events)"


@BOOK.query(f"""WITH {_ARM} SELECT count(*) AS cases, count(located) AS located, count(*) - count(located) AS fell_back, count(*) FILTER (located IS NOT NULL AND is_gold) AS correct,
 count(*) FILTER (located IS NOT NULL AND NOT coalesce(is_gold, false)) AS wrong, count(*) FILTER (located IS NOT NULL AND is_gold AND coalesce(rank, 0) <> 1) AS rule_only, count(*) FILTER (located IS NULL AND rank = 1) AS baseline_only,
 count(*) FILTER (located IS NOT NULL AND is_gold) + count(*) FILTER (located IS NULL AND rank = 1) AS combined FROM r""")
def q_reference_arm(spark, sf_dir):
    e, rank = table(spark, sf_dir, "events"), F.col("user_id") % 3
    return golden.reference_counts(e.select(F.when(F.col("event_type") != "view", F.col("event_id")).alias("located"), (F.col("value") > 50).alias("is_gold"), F.when(rank > 0, rank).alias("baseline_rank")))


@BOOK.query("SELECT count(*) AS cases, min(w) AS least, max(w) AS most, round(avg(w), 6) AS mean, CAST(sum(g) AS BIGINT) AS golds FROM (SELECT user_id, count(DISTINCT event_type) AS w, count(*) AS g FROM events GROUP BY user_id)")
def q_gold_widths(spark, sf_dir):
    return golden.width_summary(table(spark, sf_dir, "events"), "user_id", "event_type")


@BOOK.query("SELECT event_type, count(DISTINCT user_id) AS cases FROM events GROUP BY event_type")
def q_gold_needed(spark, sf_dir):
    return golden.needed_by(table(spark, sf_dir, "events"), "user_id", "event_type")


@BOOK.query("SELECT trim(text) AS text, greatest(1, item_id % 7 - 2) AS top_k, greatest(1, item_id % 7 - 2, item_id % 5) AS candidates FROM benchmark")
def q_normalised_queries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return golden.normalised_queries(b.select("text", (F.col("item_id") % 7 - 2).alias("top_k"), (F.col("item_id") % 5).alias("candidates")))


@BOOK.query("SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NULL THEN d.source WHEN l.quality = 1 THEN 'ready' END AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_mark_by_key(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ready").alias("source"))
    return golden.updated(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), changes, "doc_id")


@BOOK.query("SELECT page_id AS doc_id, page_id IN (SELECT doc_id FROM labels) AS changed FROM pages")
def q_touched_keys(spark, sf_dir):
    return golden.touched(table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id")
