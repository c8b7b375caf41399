"""Evidence, prompts, answers and receipts as text; models are columns or tables that a caller gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.functions import text as T
from lexloom.operators.golden import prompt_notes


def evidence(hits: DataFrame, query: str = "query_id", top_n: int = 0, show_top: int = 0) -> DataFrame:
    """Hits with their label 【依据i】, the first ``top_n``, else ``show_top``, else all."""
    most = top_n or show_top
    t = hits.withColumn("n", F.row_number().over(W.partitionBy(query).orderBy("rank")))
    t = t if not most else t.where(F.col("n") <= most)
    return t.withColumn("label", F.format_string("【依据%d】", "n"))


def _joined(order: str, text: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("t")))), lambda x: x["t"]), sep)


def prompts(questions: DataFrame, labelled: DataFrame, query: str = "query_id") -> DataFrame:
    """One prompt per question: its evidence in order, then the question; without evidence ``prompt`` is null."""
    block = labelled.groupBy(query).agg(_joined("n", F.concat("label", "citation", F.lit("\n"), "text"), "\n\n").alias("block"))
    out = questions.join(block, query, "left")
    return out.withColumn("prompt", F.concat("block", F.lit("\n\n问题："), T.u_trim(F.col("text")))).drop("block")


def answered(asked: DataFrame, answer: Column | None = None) -> DataFrame:
    """Route and answer of prompts: ``empty`` without evidence, ``unavailable`` without a model's answer, else ``model``."""
    given = answer if answer is not None else F.lit(None).cast("string")
    route = F.when(F.col("prompt").isNull(), "empty").when(given.isNull(), "unavailable").otherwise("model")
    return asked.withColumn("route", route).withColumn("answer", F.when(F.col("prompt").isNotNull(), given))


def last_answers(frames: DataFrame, key: str) -> DataFrame:
    """Of a stream's frames ``(key, seq, kind, payload)`` the last answer; a stream without one fails."""
    last = frames.groupBy(key).agg(F.max_by("payload", F.when(F.col("kind") == "answer", F.col("seq"))).alias("answer"), F.count_if(F.col("kind") == "answer").alias("n"))
    return last.select(key, F.when(F.col("n") == 0, F.raise_error(F.lit("a stream ended without its answer")).cast("string")).otherwise(F.col("answer")).alias("answer"))


def judgments(replies: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, supported) of the JSON object inside a reply; what isn't one gives no rows, a later n wins."""
    schema = "judgments array<struct<n:string,supported:string>>"
    items = replies.select(key, F.posexplode(F.from_json(T.braces(F.col(text)), schema)["judgments"]).alias("pos", "item"))
    number = F.col("item.n").try_cast("int")
    good = items.select(key, "pos", number.alias("n"), T.tolerant_boolean(F.col("item.supported")).alias("supported")).where("n is not null")
    return good.groupBy(key, "n").agg(F.max_by(F.struct("supported"), "pos").alias("x")).select(key, "n", "x.supported")


def findings(pages: DataFrame, start: int = 0, most: int = 5, query: str = "query_id") -> DataFrame:
    """Fetched web results as labelled rows: title to 80 characters, snippet to 300, the date's day."""
    t = pages.withColumn("n", F.row_number().over(W.partitionBy(query).orderBy("pos"))).where(F.col("n") <= most)
    return t.select(query, F.format_string("[时效%d]", F.col("n") + start).alias("label"), T.clip(T.u_trim(F.col("title")), 80).alias("title"), T.clip(T.u_trim(F.col("snippet")), 300).alias("snippet"), F.substring("published", 1, 10).alias("date"))


def receipts(hits: DataFrame, seen: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """How many hits of a call are new and how many were seen, and the first three keys."""
    t = hits.join(seen.select(query, key).distinct().withColumn("known", F.lit(True)), [query, key], "left")
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]), 1, 3)
    return t.groupBy(query).agg(F.count_if(F.col("known").isNull()).alias("fresh"), F.count("known").alias("seen"), first.alias("first"))


def receipt_texts(calls: DataFrame, hits: DataFrame, seen: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, receipt): what a caller reads of each search.

    ``calls(query, n, text, notes)``, ``hits(query, rank, key, citation, shown, refs)``, ``seen(query, key)``;
    ``shown`` is the snippet, as of ``rewrite.shown_snippets``. A hit that was seen, or comes a second
    time in one call, is cited without it. A call without hits says so; null texts count as empty.
    """
    first = F.row_number().over(W.partitionBy(query, key).orderBy("rank")) == 1
    t = hits.join(seen.select(query, key).distinct().withColumn("__seen", F.lit(True)), [query, key], "left")
    t = t.withColumn("__new", F.col("__seen").isNull()).withColumn("__known", ~(F.col("__new") & first))
    t = t.withColumn("__n", F.row_number().over(W.partitionBy(query).orderBy("rank", key)))
    cited = F.concat(F.lit("【"), F.col("__n").cast("string"), F.lit("】"), F.coalesce("citation", F.lit("")), F.when(F.col("__known"), fixed.RECEIPT_KNOWN).otherwise(""))
    shown = F.when(~F.col("__known"), F.concat(F.lit("    "), F.coalesce("shown", F.lit(""))))
    refs = F.when(F.size("refs") > 0, F.concat(F.lit(fixed.RECEIPT_REFS), F.array_join("refs", "、")))
    per = t.groupBy(query).agg(F.count("*").alias("__all"), F.count_if("__new").alias("__fresh"), _joined("__n", F.concat_ws("\n", cited, shown, refs), "\n").alias("__lines"))
    total, fresh = F.coalesce("__all", F.lit(0)), F.coalesce("__fresh", F.lit(0))
    head = F.format_string(fixed.RECEIPT_HEAD, F.col("n").cast("string"), F.coalesce("text", F.lit("")), total.cast("string"), fresh.cast("string"), (total - fresh).cast("string"))
    warning = F.when(total == 0, fixed.RECEIPT_EMPTY).when(fresh == 0, fixed.RECEIPT_NOTHING_NEW)
    notes = F.transform(prompt_notes(F.col("notes")), lambda n: F.concat(F.lit(fixed.RECEIPT_NOTE), n))
    told = F.when(F.size(notes) > 0, F.array_join(notes, "\n"))
    return calls.join(per, query, "left").select(query, F.concat_ws("\n", head, warning, "__lines", told).alias("receipt"))


def failure_receipts(failed: DataFrame, timed_out: Column, budget: Column, message: Column) -> DataFrame:
    """Add ``receipt`` and ``error`` of searches that ran out of ``budget`` seconds or failed with a ``message``."""
    late = F.format_string(fixed.SEARCH_TIMEOUT, F.regexp_replace(budget.cast("string"), r"\.0$", ""))
    receipt = F.when(timed_out, late).otherwise(F.format_string(fixed.SEARCH_FAILURE, F.coalesce(message, F.lit(""))))
    return failed.withColumn("receipt", receipt).withColumn("error", F.when(timed_out, fixed.TIMEOUT).otherwise(fixed.FAILURE))
