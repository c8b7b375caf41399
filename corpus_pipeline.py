"""A corpus pipeline of five stages, each one operator of ``lexloom.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and all that the one before kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, langid, mixing, near_copies, suffix_dedup
from lexloom.llm.common import small_batches, table, written
from lexloom.llm.queries import TOKENIZER

#: The score by the family and the closest rival is about this where both machines are undecided.
LEAST_SCORE = 0.25


#: Columns that stages read; all others pass through them, whatever their names are.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def passing_others(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in small batches, with the columns it doesn't read named apart from those that its operator adds or uses inside."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        apart = {c: f"__other{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        return stage(spark, docs.withColumnsRenamed(apart), sf_dir).withColumnsRenamed({v: k for k, v in apart.items()})

    return run_stage


@passing_others
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no letter, or no machine leans to any) go; null and empty texts are such.

    Rows that repeat are judged alike.
    """
    model = langid.fit(docs, langid.fold() != 2)
    found = langid.predict(docs, model, closest=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("closest") >= LEAST_SCORE)).drop("lang_pred", "score", "closest")


@passing_others
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) the document of smallest id stays.

    A null id is the last one; rows that repeat are one document; null and empty texts are copies of one another.
    """
    return near_copies.one_of_each(docs)


@passing_others
def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out of all texts."""
    cut = suffix_dedup.remove(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


@passing_others
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with as many of their words, as the mix takes of them."""
    return mixing.drawn_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    small_batches(spark)
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, keep_text=False)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_array", suffix_array), ("mix", mix), ("encode", encode)]

#: None of the stages can be said in SQL as a whole: each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
