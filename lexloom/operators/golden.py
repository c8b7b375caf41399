"""Sets of test questions: guards, exclusions, counts of a reference arm, distributions; and rows changed by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.fixed import ARTICLE_REF, NATION, PREAMBLE, SCOPE, SILENT_NOTES, TITLE
from lexloom.operators.names import occurrences


def preamble(text: Column) -> Column:
    return text.rlike(PREAMBLE)


def pure_scope(text: Column) -> Column:
    """A clause of scope, with fewer than 20 characters in the sentences that aren't about scope."""
    others = F.filter(F.split(text, "[。；]"), lambda s: ~s.rlike(SCOPE))
    return text.rlike(SCOPE) & (F.length(F.array_join(others, "")) < 20)


def name_aliases(names: DataFrame, name: str) -> DataFrame:
    """``alias``: each name, and its form without the nation's name if that has four characters or more."""
    short = F.when(F.startswith(name, F.lit(NATION)), F.substr(F.col(name), F.lit(len(NATION) + 1))).otherwise(F.col(name))
    forms = names.where(F.length(name) > 0).select(F.col(name).alias("alias"), short.alias("short"))
    return forms.select("alias").union(forms.where(F.length("short") >= 4).select("short")).distinct()


def guarded(questions: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``(key, reason, alias)``: why a question gives its own place away, null where it doesn't.

    Reasons in order: empty, number, title, name (the longest alias in it, ties by code point).
    ``key`` is unique. Each question is read once by the automaton of all names.
    """
    asked = questions.select(key, T.u_trim(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    pairs = occurrences(asked, name_aliases(names, name), key, "__t", "alias").withColumnRenamed("name", "alias")
    best = pairs.groupBy(key).agg(F.min(F.struct((-F.length("alias")).alias("n"), "alias")).alias("b")).select(key, F.col("b.alias").alias("alias"))
    t = F.col("__t")
    reason = F.when(t == "", "empty").when(t.rlike(ARTICLE_REF), "number").when(t.rlike(TITLE), "title").when(F.col("alias").isNotNull(), "name")
    judged = asked.join(best, key, "left").withColumn("reason", reason)
    return judged.select(key, "reason", F.when(F.col("reason") == "name", F.col("alias")).alias("alias"))


def first_asked(questions: DataFrame, normal: Column, order: str) -> DataFrame:
    """The first row of each normalised question, with how many later ones were ``dropped``."""
    first = questions.withColumn("__k", normal).groupBy("__k")
    return first.agg(F.min_by(F.struct(*questions.columns), order).alias("q"), (F.count("*") - 1).alias("dropped")).select("q.*", "dropped")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those seen; a null key was never seen."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def reference_counts(results: DataFrame) -> DataFrame:
    """Counts of a rule arm beside a search: ``results(located, is_gold, baseline_rank)``, nulls where nothing was found."""
    found, gold, top = F.col("located").isNotNull(), F.coalesce("is_gold", F.lit(False)), F.coalesce(F.col("baseline_rank") == 1, F.lit(False))
    gold = found & gold
    counts = {"located": found, "fell_back": ~found, "correct": gold, "wrong": found & ~gold, "rule_only": gold & ~top, "baseline_only": ~found & top}
    return results.agg(F.count("*").alias("cases"), *[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn("combined", F.col("correct") + F.col("baseline_only"))


def width_summary(golds: DataFrame, case: str, law: str) -> DataFrame:
    """Least, greatest and mean number of laws of a case, and all gold rows; ``golds`` has one row a gold."""
    per = golds.groupBy(case).agg(F.count_distinct(law).alias("w"), F.count("*").alias("g"))
    return per.agg(F.count("*").alias("cases"), F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.avg("w"), 6).alias("mean"), F.coalesce(F.sum("g"), F.lit(0)).alias("golds"))


def needed_by(golds: DataFrame, case: str, law: str) -> DataFrame:
    """How many cases need each law."""
    return golds.groupBy(law).agg(F.count_distinct(case).alias("cases"))


def normalised_queries(queries: DataFrame) -> DataFrame:
    """Text trimmed, ``top_k`` 1 or more, ``candidates`` no fewer than ``top_k``."""
    q = queries.withColumn("text", F.trim("text")).withColumn("top_k", F.greatest(F.lit(1), F.col("top_k")))
    return q.withColumn("candidates", F.greatest("top_k", "candidates"))


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the other columns of ``changes`` (one row a key) set where the key is there; other keys do nothing."""
    new = [c for c in changes.columns if c != key]
    side = changes.select(F.col(key), F.struct(*new).alias("__new"))
    joined = rows.join(side, key, "left")
    return joined.select(*[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def touched(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Whether an update or deletion by each key changes a row."""
    there = rows.select(key).distinct().withColumn("__there", F.lit(True))
    return keys.select(key).distinct().join(there, key, "left").select(key, F.coalesce("__there", F.lit(False)).alias("changed"))


def prompt_notes(notes: Column) -> Column:
    """Notes of an array without those that tell of the search itself."""
    return F.filter(notes, lambda n: ~n.rlike("^(?:" + "|".join(SILENT_NOTES) + ")"))


def weights_state(recorded: Column, enabled: Column, actual: Column) -> Column:
    """unknown, ok or mismatch of an index's fingerprint and that of the weights at hand."""
    known = (F.coalesce(recorded, F.lit("")) != "") & (F.coalesce(actual, F.lit("")) != "") & F.coalesce(enabled, F.lit(False))
    return F.when(~known, "unknown").when(actual == recorded, "ok").otherwise("mismatch")


def canonical_name(name: Column, version: Column, suffix: Column) -> Column:
    return F.concat(name, F.lit("_"), F.replace(version, F.lit("-"), F.lit("")), suffix)
