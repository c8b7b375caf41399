"""Queries of sessions, ledgers, quotas and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import rewrite, sessions
from lexloom.plans.tables import Book, table
from lexloom.streaming import limits, states, topics

BOOK = Book()


@BOOK.query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
 SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM b WHERE back <= 3""")
def q_last_n_turns(spark, sf_dir):
    return sessions.last_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3, ["conv_id"])


@BOOK.query("""WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations)
 SELECT conv_id, turn, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM n WHERE role = 'user'""")
def q_turn_pairs(spark, sf_dir):
    return sessions.turn_pairs(table(spark, sf_dir, "conversations"), "conv_id")


@BOOK.query("""WITH p AS (SELECT user_id, event_type, max(event_id) AS last_turn, count(*) AS turns FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_turn DESC, event_type) AS place FROM p)
 SELECT user_id, event_type, last_turn, turns, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2""")
def q_recent_topics(spark, sf_dir):
    return sessions.recent_topics(table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("turn")), "user_id", "event_type", 2)


@BOOK.query("SELECT e.user_id, e.event_type, e.event_id FROM events e JOIN (SELECT user_id, event_type, max(event_id) AS m FROM events GROUP BY ALL) x ON x.user_id = e.user_id AND x.event_type = e.event_type AND x.m = e.event_id")
def q_keep_latest(spark, sf_dir):
    return sessions.keep_latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


_STATS = "st AS (SELECT c.user_id, latest, n + coalesce(w, 0) AS rows FROM (SELECT user_id, max(event_id) AS latest, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY user_id) c LEFT JOIN (SELECT user_id, count(*) AS w FROM events WHERE event_type = 'click' GROUP BY user_id) w ON w.user_id = c.user_id)"


def _stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("checkpoint_id"), "event_type")
    return sessions.thread_stats(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), "user_id")


@BOOK.query(f"WITH {_STATS} SELECT * FROM st")
def q_thread_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@BOOK.query(f"WITH {_STATS} SELECT count(*) AS threads, count(*) FILTER (latest < 9000) AS expired, CAST(coalesce(sum(rows) FILTER (latest < 9000), 0) AS BIGINT) AS rows, min(latest) AS oldest, max(latest) AS newest FROM st")
def q_ttl_expired(spark, sf_dir):
    return sessions.cleanup_plan(_stats(spark, sf_dir), "latest", F.lit(9000))


@BOOK.query(f"WITH {_STATS} SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM st WHERE latest < 9000)")
def q_ttl_purge(spark, sf_dir):
    return sessions.purged(table(spark, sf_dir, "events").select("user_id", "event_id"), _stats(spark, sf_dir).where("latest < 9000"), "user_id")


_RATE = "w AS (SELECT event_id, event_type, ts, time_bucket(INTERVAL 1 minute, ts) AS m, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 minute, ts) ORDER BY ts, event_id) AS nth FROM events)"


@BOOK.query(f"WITH {_RATE} SELECT event_id, CAST(nth AS INTEGER) AS nth, CASE WHEN nth > 1 THEN 429 ELSE 200 END AS status, CAST(CASE WHEN nth > 1 THEN greatest(1, ceil((epoch_us(m) + 60000000 - epoch_us(ts)) / 1e6)) END AS INTEGER) AS retry_after FROM w")
def q_rate_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return sessions.rate_limited(e, "event_type", "ts", "event_id", 1).select("event_id", "nth", "status", "retry_after")


_DAILY = "SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY 1"


@BOOK.query(f"SELECT strftime(day, '%Y-%m-%d') AS day, tokens, calls FROM ({_DAILY})")
def q_daily_usage(spark, sf_dir):
    return sessions.daily_usage(table(spark, sf_dir, "events"), "ts", F.floor(F.abs("value")).cast("long")).withColumn("day", F.col("day").cast("string"))


@BOOK.query(f"SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(calls) AS BIGINT) AS calls FROM (SELECT * FROM ({_DAILY}) UNION ALL SELECT CAST(ts AS DATE), user_id % 3 - 1, event_id % 2 FROM events WHERE user_id % 3 - 1 > 0 OR event_id % 2 > 0) GROUP BY day")
def q_ledger_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ledger = sessions.daily_usage(e, "ts", F.floor(F.abs("value")).cast("long"))
    changes = e.select(F.to_date("ts").alias("day"), (F.col("user_id") % 3 - 1).alias("tokens"), (F.col("event_id") % 2).alias("calls"))
    return sessions.upserted(ledger, changes, "day", ["tokens", "calls"]).withColumn("day", F.col("day").cast("string"))


@BOOK.query("SELECT event_type, count(*) AS count, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def q_span_summary(spark, sf_dir):
    return sessions.span_summary(table(spark, sf_dir, "events"), "event_type", "value")


@BOOK.query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id")
def q_trajectory(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    return sessions.trajectory(e, "user_id", "event_type", ["click", "view", "purchase"])


_FOLD = """WITH RECURSIVE t AS (SELECT user_id, event_id AS turn, CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'continue' WHEN 'purchase' THEN 'resume' ELSE 'unsure' END AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 f AS (SELECT user_id, turn, n, 't' || turn AS topic, 't' || turn AS first FROM t WHERE n = 1 UNION ALL SELECT t.user_id, t.turn, t.n, CASE t.label WHEN 'new' THEN 't' || t.turn ELSE f.topic END, f.first FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)
 SELECT user_id, turn, topic FROM f"""


def _label():
    return F.when(F.col("event_type") == "view", "new").when(F.col("event_type") == "click", "continue").when(F.col("event_type") == "purchase", "resume").otherwise("unsure")


@BOOK.query(_FOLD)
def q_topic_fold(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("turn"), _label().alias("label"), F.lit("elsewhere").alias("wanted"))
    return sessions.folded_topics(t, "user_id")


@BOOK.query(_FOLD)
def q_topic_stream(spark, sf_dir):
    stream = limits.events(spark, f"{sf_dir}/events.parquet")
    found = topics.topics(stream, "user_id", "ts", columns={"turn": F.col("event_id"), "label": _label(), "wanted": F.lit("elsewhere")})
    return limits.latest(limits.drained(found, "update"), ["user_id", "turn"]).select("user_id", "turn", "topic")


@BOOK.query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(floor(abs(value)) AS BIGINT) AS amount FROM events),
 f AS (SELECT user_id, max(event_id) AS t FROM e WHERE event_type = 'purchase' GROUP BY user_id),
 s AS (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id DESC) AS n FROM e LEFT JOIN f USING (user_id) WHERE t IS NULL OR event_id > t),
 p AS (SELECT user_id, day, min(event_id) FILTER (event_type = 'view') AS a, min(event_id) FILTER (event_type = 'click') AS r, count(*) FILTER (event_type = 'click') AS n FROM e WHERE event_type IN ('view', 'click') GROUP BY ALL),
 q AS (SELECT *, CASE WHEN r IS NULL THEN 'open' WHEN a IS NULL THEN 'unasked' WHEN r > a THEN 'answered' ELSE 'conflict' END AS status FROM p)
 SELECT user_id, 'last' AS kind, 'type' AS field, '' AS slot, max(event_id) AS turn, arg_max(event_type, event_id) AS value FROM e GROUP BY user_id
 UNION ALL SELECT user_id, 'sum', 'amount', '', NULL, CAST(CAST(coalesce(sum(amount), 0) AS BIGINT) AS VARCHAR) FROM e GROUP BY user_id
 UNION ALL SELECT user_id, 'window', 'seen', CAST(n AS VARCHAR), event_id, event_type FROM s WHERE n <= 5
 UNION ALL SELECT user_id, 'pause', day, status, coalesce(r, a), CASE WHEN r IS NOT NULL THEN 'event ' || r END FROM q
 UNION ALL SELECT user_id, 'refused', day, '', NULL, CAST(n - CASE WHEN status = 'answered' THEN 1 ELSE 0 END AS VARCHAR) FROM q""")
def q_session_states(spark, sf_dir):
    """Every user's state after all events: last kind, sum, newest entries since a purchase, and each day's question with its answer."""
    stream = limits.events(spark, f"{sf_dir}/events.parquet")
    day, kind = F.to_date("ts").cast("string"), F.col("event_type")

    def update(op, field, value, when=None):
        made = F.struct(F.lit(op).alias("op"), field.alias("field"), value.cast("string").alias("value"))
        return made if when is None else F.when(when, made)

    each = F.array(
        update("set", F.lit("type"), kind), update("add", F.lit("amount"), F.floor(F.abs("value"))), update("append", F.lit("seen"), kind),
        update("clear", F.lit("seen"), kind, kind == "purchase"), update("pause", day, F.lit(None), kind == "view"), update("resume", day, F.concat(F.lit("event "), "event_id"), kind == "click"),
    )
    updates = stream.select("user_id", "ts", F.col("event_id").alias("turn"), F.explode(F.filter(each, lambda u: u.isNotNull())).alias("u")).select("user_id", "ts", "turn", "u.*")
    with states.store(spark):
        out = limits.drained(states.states(updates, "user_id", "ts", live="60 days"), "update")
    return states.held(out, "user_id")


@BOOK.query("SELECT event_id, 86400 - CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS retry, strftime(ts, '%Y-%m-%d') AS day FROM events")
def q_day_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.seconds_to_midnight(F.col("ts")).alias("retry"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@BOOK.query(f"SELECT strftime(day, '%Y-%m-%d') AS day, tokens, calls FROM ({_DAILY})")
def q_usage_stream(spark, sf_dir):
    return limits.usage_by_day(spark, f"{sf_dir}/events.parquet").withColumn("day", F.col("day").cast("string"))


@BOOK.query("SELECT event_type, CAST(time_bucket(INTERVAL 1 minute, ts) AS TIMESTAMP) AS minute, count(*) AS calls, greatest(count(*) - 1, 0) AS refused FROM events GROUP BY ALL")
def q_rate_stream(spark, sf_dir):
    return limits.refused_by_minute(spark, f"{sf_dir}/events.parquet", 1)


@BOOK.query()
def q_slot_ratio(spark, sf_dir):
    pairs = sessions.turn_pairs(table(spark, sf_dir, "conversations"), "conv_id").where("answer is not null")
    return pairs.select("conv_id", "turn", F.round(rewrite.ratio(F.col("question"), F.col("answer")), 6).alias("ratio"))
