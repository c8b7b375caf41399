"""Merging several rounds of retrieval, and the materials of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T


def interleaved(hits: DataFrame, cap: int | None = None, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Round robin: by rank, then round; the first of each key stays; then the cap."""
    first = W.partitionBy(query, key).orderBy("rank", "round")
    kept = hits.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    kept = kept.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("rank", "round")))
    return kept if cap is None else kept.where(F.col("place") <= cap)


def concatenated(hits: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Round after round; the first of each key stays."""
    first = W.partitionBy(query, key).orderBy("round", "rank")
    kept = hits.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("round", "rank")))


def material_scores(passages: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Share of a question's bigrams that a passage of the same ``scope`` has; at least one, best ``max(1, k)``.

    Bigrams are joined, so that a passage without a common one costs nothing.
    """
    # Folded in a step of its own, else each use of the text would fold it anew.
    questions = questions.select("scope", "query_id", T.folded(F.col("text")).alias("text"))
    passages = passages.select("scope", "position", T.folded(F.col("text")).alias("text"))
    q = questions.select("scope", "query_id", T.bigrams(F.col("text")).alias("grams"))
    q = q.select("scope", "query_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    p = passages.select("scope", "position", F.explode(T.bigrams(F.col("text"))).alias("gram"))
    common = q.join(p, ["scope", "gram"]).groupBy("scope", "query_id", "position", "n").agg(F.count("*").alias("common"))
    scored = common.select("scope", "query_id", "position", F.round(F.col("common") / F.greatest(F.col("n"), F.lit(1)), 6).alias("score"))
    order = W.partitionBy("scope", "query_id").orderBy(F.desc("score"), "position")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))


def labelled_materials(passages: DataFrame, cap: int = 600) -> DataFrame:
    """Stripped, without blanks, cut to ``cap`` characters, with one running label per request."""
    kept = passages.withColumn("text", F.substring(T.u_trim(F.col("text")), 1, cap)).where("text <> ''")
    order = W.partitionBy("request").orderBy("doc_pos", "line_no")
    return kept.withColumn("label", F.concat(F.lit("[材料"), F.row_number().over(order), F.lit("]")))
