"""Query rewriting: aliases, hints of names, and the best window of a passage."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.functions import text as T
from lexloom.operators import fragments


def expanded(queries: DataFrame, aliases: Sequence[tuple[str, Sequence[str]]] = fixed.ALIASES, most: int = 8) -> DataFrame:
    """Add ``matched`` aliases, ``expansions`` (the first ``most`` formal terms not in the text) and ``expanded``.

    The alias list is an ordered parameter; it is matched inside the row, so nothing is joined.
    """
    text = T.u_trim(F.col("text"))
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.array(*map(F.lit, terms)).alias("terms")) for a, terms in aliases])
    hit = F.filter(table, lambda a: F.contains(text, a["alias"]))
    wanted = F.array_distinct(F.filter(F.flatten(F.transform(hit, lambda a: a["terms"])), lambda t: ~F.contains(text, t)))
    out = queries.withColumn("matched", F.transform(hit, lambda a: a["alias"])).withColumn("expansions", F.slice(wanted, 1, most))
    return out.withColumn("expanded", F.concat_ws(" ", text, F.nullif(F.array_join("expansions", " "), F.lit(""))))


def similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def name_hints(queries: DataFrame, names: DataFrame, key: str, stop: Sequence[str] = fixed.GENERIC, least: int = 2) -> DataFrame:
    """(key, hint, pos): the longest part that a text and a name ``(pos, name)`` share, if it says something; first place of each."""
    return fragments.hints(queries, names, key, least=least).where(~F.col("hint").isin(list(stop)))


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, as an Arrow UDF."""

    @F.pandas_udf("double")
    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p or "", q or "") for p, q in zip(x, y)])

    return both(a, b)


def best_windows(passages: DataFrame, key: str, width: int, question: str = "question") -> DataFrame:
    """(key, start from 1, snippet): the earliest window of ``width`` characters with the greatest weight.

    Each bigram of the question weighs 1 over its occurrences in the passage, where it begins.
    A passage no longer than ``width``, or without any of the bigrams, begins at its beginning.
    Only the question's bigrams and their places are spread, not every character.
    """
    s = F.regexp_replace(T.u_trim(F.col("text")), "\n", " ")
    t = passages.select(key, s.alias("s"), T.bigrams(F.col(question)).alias("grams"))
    last = F.greatest(F.length("s") - width + 1, F.lit(1))
    places = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(F.col("s"), i, F.lit(2)).alias("gram"))), lambda x: F.array_contains("grams", x["gram"]))
    marks = t.where(F.length("s") > width).select(key, last.alias("last"), F.explode(places).alias("x")).select(key, "last", "x.i", "x.gram")
    marks = marks.withColumn("mark", 1.0 / F.count("*").over(W.partitionBy(key, "gram")))
    # The first of the best windows begins where a mark leaves the one before it or has just come in, or at the beginning.
    starts = marks.select(key, "last", F.explode(F.array(F.lit(1), F.col("i") + 1, F.col("i") - width + 1)).alias("start")).where("start between 1 and last").distinct()
    inside = (F.col("m.i") >= F.col("s.start")) & (F.col("m.i") < F.col("s.start") + width)
    scored = starts.alias("s").join(marks.alias("m"), (F.col(f"s.{key}") == F.col(f"m.{key}")) & inside, "left").groupBy(F.col(f"s.{key}").alias(key), F.col("s.start").alias("start")).agg(F.round(F.coalesce(F.sum("m.mark"), F.lit(0.0)), 9).alias("score"))
    best = scored.groupBy(key).agg(F.min_by("start", F.struct(-F.col("score"), "start")).alias("start"))
    return t.join(best, key, "left").select(key, F.coalesce("start", F.lit(1)).alias("start"), F.substring(F.col("s"), F.coalesce("start", F.lit(1)), F.lit(width)).alias("snippet"))


def shown_snippets(passages: DataFrame, key: str, width: int = 120, lead: int = 40, least: int = 40, question: str = "question") -> DataFrame:
    """(key, shown): a passage as a receipt shows it, with its head up to a colon and marks where something is left out.

    ``lead`` bounds the head, and windows that begin within it show the passage from its beginning;
    with fewer than ``least`` characters left beside the head, the window is shown alone.
    """
    found = best_windows(passages, key, width, question)
    s = F.regexp_replace(T.u_trim(F.col("text")), "\n", " ")
    t = passages.select(key, s.alias("s"), (F.trim(F.col(question)) == "").alias("blank")).join(found.select(key, "start"), key)
    n, start, more = F.length("s"), F.col("start"), F.lit("…")
    head = chapeau(F.col("s"), lead)
    rest = width - F.length(head) - 1

    def part(a: Column, size: Column) -> Column:
        return F.substring(F.col("s"), a, size)

    ends = start + width  # the place of the last character that is shown, a window and one more
    marked = F.exists(T.bigrams(F.col("q")), lambda g: F.contains(F.col("s"), g))
    t = t.join(passages.select(key, F.col(question).alias("q")), key)
    whole = F.when(n <= width, F.col("s"))
    plain = whole.when(F.col("blank") | ~marked, F.concat(part(F.lit(1), F.lit(width)), more))
    early = plain.when(start - 1 <= lead, F.concat(part(F.lit(1), F.least(n, ends)), F.when(ends < n, more).otherwise("")))
    alone = early.when(rest < least, F.concat(more, part(start, F.lit(width + 1)), more))
    shown = alone.otherwise(F.concat(head, more, part(start, rest), F.when(start - 1 + rest < n, more).otherwise("")))
    return t.select(key, shown.alias("shown"))


def chapeau(text: Column, limit: int) -> Column:
    """The head of a passage up to its last colon within ``limit`` characters."""
    head = F.substring(text, 1, limit)
    return F.when(F.contains(head, F.lit("：")), F.regexp_extract(head, "(?s)^.*：", 0)).otherwise(head)
