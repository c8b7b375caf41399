"""Queries of the corpus build and of resolution, each on the driver table closest to it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import build, corpus, ingest, resolve
from lexloom.plans.tables import Book, table
from lexloom.session import scratch_folder

BOOK = Book()

_L = "l AS (SELECT doc_id AS doc, i - 1 AS pos, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def _lines(spark, sf_dir):
    return corpus.lines(table(spark, sf_dir, "documents"), "doc_id")


@BOOK.query(rf"""WITH {_L}, n AS (SELECT *, count(*) OVER (PARTITION BY doc, text) AS n FROM l)
 SELECT doc, CAST(pos AS INTEGER) AS pos, text FROM n WHERE n < 3 OR length(text) > 30 OR regexp_matches(text, '[，。；、：！？（）《》〈〉“”‘’,.!?;:()\[\]{{}}<>]')""")
def q_frequent_lines(spark, sf_dir):
    return corpus.infrequent(_lines(spark, sf_dir))


@BOOK.query(rf"""WITH {_L}, t AS (SELECT doc, pos, trim(text, ' ' || chr(9) || chr(13)) AS text FROM l)
 SELECT doc, CAST(pos AS INTEGER) AS pos, text FROM t WHERE text <> '' AND NOT regexp_matches(text, '^\d{{4}}/\d{{1,2}}/\d{{1,2}}\s+\d{{1,2}}:\d{{2}}|中国政府网|gov\.cn|网站标识码|^\d{{1,3}}\s*/\s*\d{{1,3}}$|^\d+$|^/$|^_+$|^https?://')""")
def q_denoise_lines(spark, sf_dir):
    return corpus.denoised(_lines(spark, sf_dir))


_HEAD = "^(The|And|Is|Of|In) "


@BOOK.query(f"""WITH {_L}, b AS (SELECT *, sum(CASE WHEN regexp_matches(text, '{_HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS block FROM l)
 SELECT doc, CAST(block AS BIGINT) AS block, CAST(min(pos) AS INTEGER) AS pos, md5(string_agg(text, '' ORDER BY pos)) AS digest FROM b GROUP BY doc, block""")
def q_stitch_blocks(spark, sf_dir):
    return corpus.stitched(_lines(spark, sf_dir), _HEAD).select("doc", "block", "pos", F.md5("text").alias("digest"))


@BOOK.query(f"""WITH {_L}, m AS (SELECT doc, pos, trim(CASE WHEN pos % 3 = 0 THEN '## ' || split_part(text, ' ', 1) ELSE split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) END) AS text FROM (SELECT doc, pos - pos % 3 AS g, pos, first_value(text) OVER (PARTITION BY doc, pos - pos % 3 ORDER BY pos) AS text FROM l)),
 s AS (SELECT *, trim(regexp_replace(text, '^#{{1,6}}[ \\t]*', '')) AS body FROM m), n AS (SELECT *, lead(body) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM s)
 SELECT doc, CAST(pos AS INTEGER) AS pos, body AS text FROM n WHERE body <> '' AND NOT (body <> text AND coalesce(starts_with(nxt, body), false))""")
def q_heading_dedupe(spark, sf_dir):
    group = F.col("pos") - F.col("pos") % 3
    from pyspark.sql import Window as W

    first = F.first("text").over(W.partitionBy("doc", group).orderBy("pos"))
    one, two = F.split_part(F.col("first"), F.lit(" "), F.lit(1)), F.split_part(F.col("first"), F.lit(" "), F.lit(2))
    made = F.trim(F.when(F.col("pos") % 3 == 0, F.concat(F.lit("## "), one)).otherwise(F.concat(one, F.lit(" "), two)))
    t = _lines(spark, sf_dir).withColumn("first", first).select("doc", "pos", made.alias("text"))
    return corpus.without_doubled_headings(t)


@BOOK.query(rf"""WITH {_L}, k AS (SELECT doc, pos, trim(text, ' ' || chr(9) || chr(13)) AS text FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) = 1 OR NOT (length(text) < 60 OR regexp_matches(text, '^\d+[.)]')) AS opens FROM k WHERE text <> ''),
 b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS block FROM f)
 SELECT doc, CAST(block AS BIGINT) AS block, CAST(min(pos) AS INTEGER) AS pos, md5(string_agg(text, chr(10) ORDER BY pos)) AS digest FROM b GROUP BY doc, block""")
def q_paragraph_merge(spark, sf_dir):
    return corpus.merged_paragraphs(_lines(spark, sf_dir), 60, r"^\d+[.)]").select("doc", "block", "pos", F.md5("text").alias("digest"))


@BOOK.query(r"""WITH RECURSIVE d AS (SELECT item_id, text, list_sort(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) IN ('.', ';'))) AS ends FROM benchmark),
 c AS (SELECT item_id, text, ends, CAST(0 AS BIGINT) AS low, list_min(list_filter(ends, lambda e: e >= 80)) AS high, 1 AS n FROM d WHERE length(text) > 80
  UNION ALL SELECT item_id, text, ends, high, list_min(list_filter(ends, lambda e: e - c.high >= 80)), n + 1 FROM c WHERE high IS NOT NULL),
 p AS (SELECT item_id, n, trim(substr(text, low + 1, coalesce(high, length(text)) - low), ' ' || chr(10) || chr(9) || chr(13)) AS part FROM c UNION ALL SELECT item_id, 1, text FROM d WHERE length(text) <= 80)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n) - 1 AS INTEGER) AS n, part FROM p WHERE part <> ''""")
def q_long_split(spark, sf_dir):
    parts = corpus.long_parts(F.col("text"), 80, "[.;]")
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("n", "part"))


@BOOK.query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'th[a-z]{1,3}on')) AS ref, generate_subscripts(regexp_extract_all(text, 'th[a-z]{1,3}on'), 1) AS p FROM documents),
 f AS (SELECT doc_id, ref, min(p) AS p FROM m WHERE ref <> 'thention' GROUP BY ALL) SELECT doc_id, string_agg(ref, ' ' ORDER BY p) AS refs FROM f GROUP BY doc_id""")
def q_sentence_refs(spark, sf_dir):
    refs = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit("th[a-z]{1,3}on"), F.lit(0))), lambda x: x != "thention")
    return table(spark, sf_dir, "documents").select("doc_id", refs.alias("r")).where("size(r) > 0").select("doc_id", F.array_join("r", " ").alias("refs"))


@BOOK.query("SELECT count(*) AS chunks, count(DISTINCT source) AS laws, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / greatest(count(*), 1), 1) AS avg_chars FROM documents")
def q_corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(table(spark, sf_dir, "documents").withColumnRenamed("source", "law_id"))


@BOOK.query("""WITH l AS (SELECT source AS law_id, arg_max(lang, doc_id) AS law_name, arg_max(CAST(doc_id AS VARCHAR), doc_id) AS version, count(DISTINCT n_chars) AS articles FROM documents GROUP BY source)
 SELECT *, regexp_matches(law_name, '省|市|自治区|经济特区') AS local FROM l""")
def q_source_listing(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("source").alias("law_id"), F.col("lang").alias("law_name"), F.col("doc_id").cast("string").alias("version"), F.col("n_chars").alias("article_no"), F.col("doc_id").alias("pos"))
    return corpus.laws_of(t)


@BOOK.query("""WITH old AS (SELECT 'f' || doc_id AS file, sha1(text) AS sha1 FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT 'f' || doc_id AS file, sha1(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS sha1 FROM documents WHERE doc_id % 7 <> 0)
 SELECT coalesce(old.file, new.file) AS file, CASE WHEN old.file IS NULL THEN 'new' WHEN new.file IS NULL THEN 'gone' WHEN old.sha1 <> new.sha1 THEN 'changed' ELSE 'same' END AS state FROM old FULL JOIN new USING (file)""")
def q_sha1_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id"))
    old = docs.where("doc_id % 3 <> 0").select(name.alias("file"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 7 <> 0").select(name.alias("file"), F.sha1(text.cast("binary")).alias("sha1"))
    return ingest.compared(old, new)


@BOOK.query("""WITH d AS (SELECT doc_id, doc_id % 16 AS corpus, 'f' || doc_id AS file, sha1(text) AS sha1, text, doc_id % 4 AS articles FROM documents),
 m AS (SELECT * FROM d WHERE corpus <> 0),
 s AS (SELECT corpus, CASE WHEN corpus = 3 THEN 'g' || doc_id ELSE file END AS file, CASE WHEN corpus = 4 THEN sha1(text || '!') ELSE sha1 END AS sha1 FROM d WHERE NOT (corpus = 2 AND doc_id % 32 = 2)),
 lm AS (SELECT corpus, count(*) AS laws, count(*) FILTER (corpus = 1) AS unparsed, CAST(sum(articles) AS BIGINT) AS articles FROM m GROUP BY corpus),
 j AS (SELECT s.corpus, s.file, CASE WHEN m.file IS NULL THEN 'new' WHEN s.sha1 IS DISTINCT FROM m.sha1 THEN 'changed' END AS odd FROM s LEFT JOIN m ON m.corpus = s.corpus AND m.file = s.file),
 lf AS (SELECT corpus, count(*) AS files, min_by(odd, file) FILTER (odd IS NOT NULL) AS odd FROM j GROUP BY corpus),
 f AS (SELECT coalesce(lm.corpus, lf.corpus) AS corpus, coalesce(laws, 0) AS laws, coalesce(unparsed, 0) AS unparsed, coalesce(articles, 0) AS articles, coalesce(files, 0) AS files, odd FROM lm FULL JOIN lf ON lm.corpus = lf.corpus)
 SELECT corpus, laws, files, CASE WHEN laws = 0 THEN 'no structure' WHEN unparsed > 0 THEN 'parse missing' WHEN laws <> files THEN 'file count' WHEN odd = 'new' THEN 'new file' WHEN odd = 'changed' THEN 'file changed'
  WHEN corpus = 5 THEN 'no chunks' WHEN corpus = 6 THEN 'parents differ' WHEN corpus = 7 THEN 'no snapshot' WHEN corpus = 8 THEN 'no collection' WHEN corpus = 9 THEN 'rows differ' WHEN corpus = 10 THEN 'other model' WHEN corpus = 11 THEN 'no vectors' END AS reason FROM f""")
def q_stale_reason(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 16).alias("corpus"), F.concat(F.lit("f"), "doc_id").alias("file"), F.col("text").cast("binary").alias("text"), (F.col("doc_id") % 4).alias("articles"))
    c = F.col("corpus")
    manifest = d.where(c != 0).select("corpus", "file", F.col("doc_id").alias("law_id"), F.sha1("text").alias("sha1"), "articles")
    files = d.where(~((c == 2) & (F.col("doc_id") % 32 == 2))).select(
        "corpus", F.when(c == 3, F.concat(F.lit("g"), "doc_id")).otherwise(F.col("file")).alias("file"), F.sha1(F.when(c == 4, F.concat("text", F.lit(b"!"))).otherwise(F.col("text"))).alias("sha1"))
    facts = ingest.build_facts(manifest, manifest.where(c != 1).select("corpus", "law_id"), files, ["corpus"])
    facts = facts.withColumn("parents", F.when(c != 5, F.col("articles") + (c == 6).cast("long"))).withColumn("chunks", F.col("parents")).withColumn("snapshot_rows", F.when(c != 7, F.col("articles") * 2))
    facts = facts.withColumn("collection_rows", F.when(c != 8, F.col("articles") * 2 + (c == 9).cast("long"))).withColumn("want_dense", c != 13).withColumn("vector_enabled", ~c.isin(11, 12, 13))
    facts = facts.withColumn("model", F.when(c != 10, "m")).withColumn("want_model", F.lit("m")).withColumn("embed_failed", c == 12)
    return ingest.staleness(facts).select("corpus", "laws", "files", "reason")


@BOOK.query(r"""WITH f AS (SELECT doc_id, 'd' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '.exe' ELSE '.md' END AS file, text, length(text) AS size, sha1(text) AS sha1, len(regexp_extract_all(text, '\.')) AS articles, CAST(len(string_split(text, '!')) - 1 AS DOUBLE) / greatest(length(text), 1) AS leftover FROM documents),
 g AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY doc_id) AS nth FROM f)
 SELECT doc_id, CASE WHEN NOT regexp_matches(file, '\.(docx|md|txt|pdf)$') THEN 'suffix' WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'too large' WHEN articles = 0 THEN 'no article' WHEN leftover > 0.02 THEN 'leftovers' WHEN nth > 1 THEN 'duplicate' ELSE 'ready' END AS status FROM g""")
def q_ingest_gate(spark, sf_dir):
    name = F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 11 == 0, ".exe").otherwise(".md"))
    marks = F.size(F.split("text", "!")) - 1
    files = table(spark, sf_dir, "documents").select("doc_id", name.alias("file"), F.length("text").alias("size"), F.sha1(F.col("text").cast("binary")).alias("sha1"), F.regexp_count("text", F.lit(r"\.")).alias("articles"), (marks / F.greatest(F.length("text"), F.lit(1))).alias("leftover"))
    return ingest.gated(files, "doc_id", most_bytes=20000, most_leftover=0.02).select("doc_id", "status")


@BOOK.query("""WITH m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CHINA' WHEN 1 THEN 'A' WHEN 2 THEN 'STATES' WHEN 3 THEN 'NATION_' || (p_partkey % 30) ELSE '' END AS name FROM part),
 k AS (SELECT n_name AS f, max(n_nationkey) AS id FROM nation GROUP BY n_name), a AS (SELECT DISTINCT name FROM m WHERE name <> ''),
 j AS (SELECT name, f, id, CASE WHEN name = f THEN 1 WHEN ends_with(f, name) THEN 2 ELSE 3 END AS tier FROM a JOIN k ON contains(f, name) OR contains(name, f)),
 b AS (SELECT name, count(*) FILTER (tier <= 1) AS n1, count(*) FILTER (tier <= 2) AS n2, count(*) AS n3, max(id) FILTER (tier <= 1) AS i1, max(id) FILTER (tier <= 2) AS i2, max(id) AS i3, string_agg(f, '|' ORDER BY f) AS c FROM j GROUP BY name)
 SELECT p_partkey, m.name, CASE WHEN n1 = 1 THEN i1 WHEN n2 = 1 THEN i2 WHEN n3 = 1 THEN i3 END AS id, CASE WHEN n1 = 1 OR n2 = 1 OR n3 = 1 THEN NULL ELSE c END AS candidates FROM m LEFT JOIN b USING (name)""")
def q_name_resolve(spark, sf_dir):
    p = F.col("p_partkey") % 5
    name = F.when(p == 0, "CHINA").when(p == 1, "A").when(p == 2, "STATES").when(p == 3, F.concat(F.lit("NATION_"), F.col("p_partkey") % 30)).otherwise("")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    out = resolve.resolved(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), names, "p_partkey")
    return out.withColumn("candidates", F.array_join("candidates", "|"))


_ASKED = "SELECT o_orderkey AS query, o_orderkey AS law, CAST(o_orderkey % 9 AS INTEGER) AS no FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, -o_orderkey, 1 FROM orders WHERE o_orderkey % 50 = 1"


@BOOK.query(f"""WITH a AS ({_ASKED}), i AS (SELECT l_orderkey AS law, l_linenumber AS no, arg_min(l_partkey, l_suppkey * 1000000 + l_partkey) AS article_id FROM lineitem GROUP BY ALL),
 p AS (SELECT l_orderkey AS law, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY ALL)
 SELECT query, law, no, article_id, CASE WHEN article_id IS NOT NULL THEN 'found' WHEN low IS NULL THEN 'unknown law' ELSE 'out of range ' || low || '-' || high END AS message FROM a LEFT JOIN i USING (law, no) LEFT JOIN p USING (law)""")
def q_point_lookup(spark, sf_dir):
    articles = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("article_id"), (F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("pos"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"))
    some = orders.where("query % 3 = 0").select("query", F.col("query").alias("law"), (F.col("query") % 9).cast("int").alias("no"))
    none = orders.where("query % 50 = 1").select("query", (-F.col("query")).alias("law"), F.lit(1).alias("no"))
    return resolve.looked_up(some.union(none), articles)


@BOOK.query("""WITH m AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_id AS item FROM events WHERE event_type <> 'click'), c AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, max(event_id) AS law FROM events WHERE event_type = 'click' GROUP BY ALL)
 SELECT m.user_id, m.pos, m.item, c.law FROM m ASOF JOIN c ON m.user_id = c.user_id AND m.pos >= c.pos WHERE m.pos - c.pos <= 86400""")
def q_asof_mention(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("pos"), "event_id", "event_type")
    laws = e.where("event_type = 'click'").groupBy("user_id", "pos").agg(F.max("event_id").alias("law"))
    return resolve.as_of(e.where("event_type <> 'click'").withColumnRenamed("event_id", "item"), laws, ["user_id"], 86400)


@BOOK.query("""WITH s AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS low, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(abs(value) * 1000) AS BIGINT) % 90000 AS high FROM events)
 SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.user_id = s.user_id AND o.low <= s.low AND o.high >= s.high AND o.high - o.low > s.high - s.low)""")
def q_span_antijoin(spark, sf_dir):
    low = F.unix_timestamp("ts")
    high = low + F.floor(F.abs("value") * 1000) % 90000
    return resolve.outermost(table(spark, sf_dir, "events").select("event_id", "user_id", low.alias("low"), high.alias("high")), ["user_id"])


@BOOK.query("""WITH l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''), c AS (SELECT DISTINCT doc_id, line FROM l),
 w AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(line), '[a-z]+'))) AS term FROM c) GROUP BY term)
 SELECT 1 AS place, 'lines' AS stage, (SELECT count(*) FROM documents) AS rows_in, count(*) AS rows_out, CAST(sum(length(line)) AS BIGINT) AS total FROM l
 UNION ALL SELECT 2, 'distinct', (SELECT count(*) FROM l), count(*), CAST(sum(length(line)) AS BIGINT) FROM c
 UNION ALL SELECT 3, 'terms', (SELECT count(*) FROM c), count(*), CAST(sum(n) AS BIGINT) FROM w""")
def q_build_report(spark, sf_dir):
    """Documents to lines, distinct lines and terms, built behind the gate; what each stage read and wrote, as measured while writing."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit("[a-z]+"), F.lit(0)))
    stages = [
        build.Stage("lines", lambda d: d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''"), {"total": "sum(length(line))"}),
        build.Stage("distinct", lambda d: d.distinct(), {"total": "sum(length(line))"}),
        build.Stage("terms", lambda d: d.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n")), {"total": "sum(n)"}),
    ]
    root = f"{scratch_folder(spark, 'build')}/{uuid.uuid4().hex}"
    build.ensure_ready(table(spark, sf_dir, "documents").select("doc_id", "text"), root, stages)
    return build.report(spark, root).select("place", "stage", "rows_in", "rows_out", F.col("measures")["total"].alias("total"))
