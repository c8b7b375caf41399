"""Sessions, ledgers and retention, in batch; streams use the same functions in each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The last ``n`` turns of each key, oldest first in ``place``."""
    back = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("turn")))
    kept = turns.withColumn("back", back).where(F.col("back") <= n)
    return kept.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("turn"))).drop("back")


def turn_pairs(messages: DataFrame, by: str) -> DataFrame:
    """Each question with the answer right after it, null where another question follows."""
    w = W.partitionBy(by).orderBy("turn")
    t = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return t.where("role = 'user'").select(by, "turn", F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


def recent_topics(turns: DataFrame, session: str, topic: str, n: int) -> DataFrame:
    """The ``n`` topics of each session touched last, ties by name, with their number of turns."""
    per = turns.groupBy(session, topic).agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns"))
    order = W.partitionBy(session).orderBy(F.desc("last_turn"), topic)
    return per.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def folded_topics(turns: DataFrame, session: str, most: int = 11) -> DataFrame:
    """Topic of each turn from its label: continue and unsure stay, resume goes to a visible topic, new opens ``t{turn}``.

    ``turns(session, turn, label, wanted)``. Sequential by nature: a fold inside each session's
    ordered array, which is bounded by one conversation.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "label", "wanted")))
    start = F.struct(F.lit("").alias("active"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<turn:bigint,topic:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        made = F.concat(F.lit("t"), x["turn"].cast("string"))
        topic = F.when((acc["active"] == "") | (x["label"] == "new"), made).when((x["label"] == "resume") & F.array_contains(acc["seen"], x["wanted"]), x["wanted"]).otherwise(acc["active"])
        seen = F.array_append(F.array_remove(acc["seen"], topic), topic)
        seen = F.slice(seen, F.greatest(F.lit(1), F.size(seen) - most + 1), F.lit(most))
        return F.struct(topic.alias("active"), seen.alias("seen"), F.array_append(acc["out"], F.struct(x["turn"].cast("bigint").alias("turn"), topic.alias("topic"))).alias("out"))

    folded = turns.groupBy(session).agg(ordered.alias("rows")).select(session, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x"))
    return folded.select(session, "x.turn", "x.topic")


def keep_latest(table: DataFrame, by: list[str], order: str) -> DataFrame:
    return table.withColumn("__m", F.max(order).over(W.partitionBy(*by))).where(F.col(order) == F.col("__m")).drop("__m")


def thread_stats(checkpoints: DataFrame, writes: DataFrame, thread: str) -> DataFrame:
    """Latest checkpoint and number of rows of each thread in both tables."""
    a = checkpoints.groupBy(thread).agg(F.max("checkpoint_id").alias("latest"), F.count("*").alias("n"))
    b = writes.groupBy(thread).agg(F.count("*").alias("w"))
    return a.join(b, thread, "left").select(thread, "latest", (F.col("n") + F.coalesce("w", F.lit(0))).alias("rows"))


def cleanup_plan(stats: DataFrame, last: str, cutoff: Column) -> DataFrame:
    old = F.col(last) < cutoff
    return stats.agg(F.count("*").alias("threads"), F.count_if(old).alias("expired"), F.coalesce(F.sum(F.when(old, F.col("rows"))), F.lit(0)).alias("rows"), F.min(last).alias("oldest"), F.max(last).alias("newest"))


def purged(table: DataFrame, expired: DataFrame, key: str) -> DataFrame:
    return table.join(expired.select(key).distinct(), key, "left_anti")


def rate_limited(calls: DataFrame, key: str, ts: str, order: str, rpm: int = 30) -> DataFrame:
    """Calls by minute and key: the ``rpm + 1``-th and later are refused, and count all the same."""
    minute = F.window(ts, "1 minute")
    t = calls.withColumn("w", minute)
    nth = F.row_number().over(W.partitionBy(key, "w").orderBy(ts, order))
    wait = F.greatest(F.lit(1), F.ceil((F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6)).cast("int")
    return t.withColumn("nth", nth).withColumn("status", F.when(F.col("nth") > rpm, 429).otherwise(200)).withColumn("retry_after", F.when(F.col("nth") > rpm, wait)).drop("w")


def daily_usage(calls: DataFrame, ts: str, tokens: Column) -> DataFrame:
    """Tokens and calls of each UTC day; calls without tokens count, rows with neither don't exist here."""
    return calls.groupBy(F.to_date(ts).alias("day")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("calls"))


def upserted(ledger: DataFrame, changes: DataFrame, key: str, add: list[str]) -> DataFrame:
    """Ledger with changes added to the columns ``add``; rows of changes without a positive number are skipped."""
    positive = None
    for c in add:
        positive = (F.col(c) > 0) if positive is None else positive | (F.col(c) > 0)
    both = ledger.select(key, *add).unionByName(changes.where(positive).select(key, *add))
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in add])


def replaced(ledger: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace: the last change of a key, else the ledger's row."""
    newest = changes.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return ledger.join(newest, key, "left_anti").unionByName(newest.select(*ledger.columns))


def span_summary(spans: DataFrame, name: str, seconds: str) -> DataFrame:
    s = spans.groupBy(name).agg(F.count("*").alias("count"), F.round(F.sum(seconds), 6).alias("total"), F.round(F.avg(seconds), 6).alias("mean"))
    return s.orderBy(F.desc("total"), name)


def trajectory(calls: DataFrame, session: str, tool: str, tools: list[str]) -> DataFrame:
    return calls.groupBy(session).pivot(tool, tools).count().na.fill(0)


def fresh_calls(calls: DataFrame, session: str, key: Column) -> DataFrame:
    """The first successful call of each key in a session; failed ones may be tried again."""
    ok = calls.where("ok").withColumn("__k", key)
    return ok.withColumn("__n", F.row_number().over(W.partitionBy(session, "__k").orderBy("pos"))).where("__n = 1").drop("__n", "__k")
