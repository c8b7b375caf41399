"""Retrieval metrics, arm comparison and gold sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_ranks(cases: DataFrame, gold: DataFrame, hits: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Each case's rank of its first gold hit, null without one; cases without gold stay."""
    found = hits.join(gold, [query, key]).groupBy(query).agg(F.min("rank").alias("rank"))
    return cases.select(query).distinct().join(found, query, "left")


def _share(flag: Column) -> Column:
    return F.coalesce(F.round(F.avg(F.when(flag, 1.0).otherwise(0.0)), 6), F.lit(0.0))


def metrics(results: DataFrame, ks: Sequence[int] = (1, 3, 6), mrr_at: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """hit@k, MRR with and without cutoff, pool hits and recall; all zero without cases."""
    inverse = 1.0 / F.col("rank")
    columns = [
        F.count("*").alias("n"),
        *[_share(F.col("rank") <= k).alias(f"hit_at_{k}") for k in ks],
        F.coalesce(F.round(F.sum(F.when(F.col("rank") <= mrr_at, inverse).otherwise(0.0)) / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0)).alias(f"mrr_at_{mrr_at}"),
        F.coalesce(F.round(F.avg(F.coalesce(inverse, F.lit(0.0))), 6), F.lit(0.0)).alias("mrr"),
        F.count("rank").alias("pool_hits"),
        _share(F.col("rank").isNotNull()).alias("pool_recall"),
    ]
    return results.groupBy(*by).agg(*columns) if by else results.agg(*columns)


def channel_recall(results: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(channel, hits, asked): flags that are null (the channel never ran) don't count."""
    arrays = F.explode(F.array(*[F.struct(F.lit(f).alias("channel"), F.col(f).alias("flag")) for f in flags])).alias("x")
    return results.select(arrays).groupBy("x.channel").agg(F.count_if(F.col("x.flag")).alias("hits"), F.count("x.flag").alias("asked"))


def compare_arms(results: DataFrame, gold: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """For each arm: hits, golds found, and candidates per question, of ``results(arm, query, key, rank)``."""
    found = results.join(gold, [query, key], "left_semi").groupBy("arm").agg(F.count_distinct(query, key).alias("golds"), F.count_distinct(query).alias("questions_hit"))
    per = results.groupBy("arm").agg(F.count("*").alias("candidates"), F.count_distinct(query).alias("questions"))
    return per.join(found, "arm", "left").select("arm", "questions", F.round(F.col("candidates") / F.col("questions"), 6).alias("per_question"), F.coalesce("golds", F.lit(0)).alias("golds"), F.coalesce("questions_hit", F.lit(0)).alias("questions_hit"))


def upper_median(values: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The element at n // 2 in order, and the largest; ranks are windows, so no group is gathered."""
    w = W.partitionBy(*by)
    ranked = values.select(*by, value, F.row_number().over(w.orderBy(value)).alias("nth"), F.count("*").over(w).alias("n"))
    picked = F.max(F.when(F.col("nth") == F.floor(F.col("n") / 2) + 1, F.col(value)))
    return ranked.groupBy(*by).agg(picked.alias("upper_median"), F.max(value).alias("largest"))


def common_gold(variants: DataFrame) -> DataFrame:
    """Gold of each question: what all variants that cite anything cite, in the first one's order.

    ``variants(question, pos, gold array)``. Reason is null, ``no citation`` or ``variants disagree``.
    """
    cited = variants.where(F.size("gold") > 0)
    n = cited.groupBy("question").agg(F.count("*").alias("n"), F.min_by("gold", "pos").alias("first"))
    # A key counts once for each variant.
    each = cited.select("question", "pos", F.explode(F.array_distinct("gold")).alias("key")).groupBy("question", "key").agg(F.count("*").alias("c"))
    places = n.select("question", "n", F.posexplode(F.array_distinct("first")).alias("place", "key"))
    kept = places.join(each, ["question", "key"]).where("c = n").groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("gold"))
    out = variants.select("question").distinct().join(n.select("question", "n"), "question", "left").join(kept, "question", "left")
    reason = F.when(F.col("n").isNull(), "no citation").when(F.col("gold").isNull(), "variants disagree")
    return out.select("question", "gold", reason.alias("reason"))


def bucket_of(gold: Column, names_article: Column) -> Column:
    """reference where the question names its article itself, retrieval with gold, else nogold."""
    return F.when(gold.isNull(), "nogold").when(names_article, "reference").otherwise("retrieval")


def drift(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """First difference of two data sets in order of ``key``: missing, extra or changed rows."""
    values = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*values).alias("a"))
    b = new.select(key, F.struct(*values).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return a.join(b, key, "full").where(~F.equal_null("a", "b")).select(key, state.alias("state"))


def failure_class(found: Column, cited: Column, total: Column) -> Column:
    """all, half cited, uncited, partial or miss."""
    return F.when(found == 0, "miss").when((found < total) & (cited > 0), "partial").when(cited == 0, "uncited").when(cited < found, "half cited").when(found < total, "partial").otherwise("all")


def round_robin(table: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows when groups take turns, with their place.

    No group gives more than ``most`` rows, which is cut before the shuffle; the places are those of
    one ordered list of ``most`` rows.
    """
    t = table.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("turn") <= most)
    first = t.orderBy("turn", group).limit(most)
    return first.withColumn("place", F.row_number().over(W.orderBy("turn", group)))


def holders(passages: DataFrame, docs: DataFrame, passage_key: str, key: str, words: int = 8) -> DataFrame:
    """(passage, document): documents ``(key, body)`` that hold a passage ``(passage_key, text)`` word for word.

    A passage's first ``words`` whole words in a row, by hash, find the candidates in a join with
    those of the documents; the text decides. Passages too short for that are compared with every
    document.
    """
    pattern = r"(?<!\S)(?=(\S+(?:\s+\S+){%d}))" % (words - 1)

    def runs(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.xxhash64(x))

    # The outer words of a passage may be parts of words in a document.
    long = F.size(F.split("text", r"\s+")) >= words + 2
    asked = passages.where(long).select(passage_key, "text", F.element_at(runs(F.col("text")), 2).alias("h"))
    some = docs.select(key, F.explode(F.array_distinct(runs(F.col("body")))).alias("h"))
    pairs = some.join(asked.select("h", passage_key), "h").select(passage_key, key).distinct()
    found = pairs.join(passages, passage_key).join(docs, key).where(F.contains("body", "text")).select(passage_key, key)
    short = passages.where(~long).join(docs, F.contains("body", "text")).select(passage_key, key)
    return found.unionByName(short)


def review_scores(answers: DataFrame, key: str, evidence: DataFrame, verdicts: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Share of an answer's cited labels that are supported, and whether it passes.

    ``answers(key, labels array<int>)``, ``evidence(key, label)``, ``verdicts(key, label, supported)``.
    A label without evidence or verdict is unsupported. No labels: no score, and it passes. A
    threshold below 0 switches the review off, 0 only scores.
    """
    cited = answers.select(key, F.explode_outer("labels").alias("label"))
    known = evidence.select(key, "label").distinct().withColumn("known", F.lit(True))
    judged = verdicts.groupBy(key, "label").agg(F.max_by("supported", "pos").alias("supported")) if "pos" in verdicts.columns else verdicts
    joined = cited.join(known, [key, "label"], "left").join(judged, [key, "label"], "left")
    good = F.col("known") & F.coalesce("supported", F.lit(False))
    out = joined.groupBy(key).agg(F.count("label").alias("total"), F.count_if(F.coalesce(good, F.lit(False))).alias("supported"))
    score = F.when(F.col("total") > 0, F.round(F.col("supported") / F.col("total"), 3))
    passed = F.coalesce(~(F.lit(threshold > 0) & (score < threshold)), F.lit(True))
    return out.select(key, "total", "supported", score.alias("score"), passed.alias("passed"))
