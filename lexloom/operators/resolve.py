"""Names to laws, mentions to articles, and spans within spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.functions import text as T
from lexloom.operators.names import occurrences, substrings


def resolved(mentions: DataFrame, names: DataFrame, key: str, tiers: int = 3) -> DataFrame:
    """``id`` of a mention's name: exact, else the only name that ends with it, else the only one that contains it or is contained.

    ``mentions(key, name)``, ``names(id, name, pos)``; of equal names the last ``pos`` wins. The
    lowest tier with exactly one name counts; without one ``id`` is null and ``candidates`` lists
    the names of the lowest tier that has any, sorted. Names are a dimension table of short strings.
    """
    known = names.groupBy("name").agg(F.max_by("id", "pos").alias("id")).withColumnRenamed("name", "full")
    asked = mentions.where(F.col("name") != "").select("name").distinct()
    # A mention in a name is equal to one of the name's parts; a name in a mention is found by the names' automaton.
    within = known.select("full", F.explode(substrings(F.col("full"))).alias("name")).join(asked, "name")
    tier = F.when(F.col("name") == F.col("full"), 1).when(F.endswith("full", "name"), 2).otherwise(3)
    pairs = within.select("name", "full", tier.alias("tier"))
    if tiers == 3:
        around = occurrences(asked.withColumn("mention", F.col("name")), known, "mention", "name", "full")
        pairs = pairs.unionByName(around.where("mention <> name").select(F.col("mention").alias("name"), F.col("name").alias("full"), F.lit(3).alias("tier")))
    pairs = pairs.where(F.col("tier") <= tiers).groupBy("name", "full").agg(F.min("tier").alias("tier")).join(known, "full")
    # A wider tier holds what the narrower ones hold.
    count = [F.count(F.when(F.col("tier") <= t, 1)).alias(f"n{t}") for t in range(1, tiers + 1)]
    pick = [F.max(F.when(F.col("tier") <= t, F.col("id"))).alias(f"id{t}") for t in range(1, tiers + 1)]
    best = pairs.groupBy("name").agg(*count, *pick, F.array_sort(F.collect_list("full")).alias("candidates"))
    chosen = F.coalesce(*[F.when(F.col(f"n{t}") == 1, F.col(f"id{t}")) for t in range(1, tiers + 1)])
    out = best.select("name", chosen.alias("id"), F.when(chosen.isNull(), F.col("candidates")).alias("candidates"))
    return mentions.join(out, "name", "left").select(key, "name", "id", "candidates")


def first_of(table: DataFrame, *keys: str, order: str = "pos") -> DataFrame:
    """The first row of each key."""
    return table.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def looked_up(asked: DataFrame, articles: DataFrame) -> DataFrame:
    """(query, law, no) to the article, or why not: the law is unknown, or it ends at some number.

    ``articles(law, no, pos, article_id)``; the first of equal numbers counts.
    """
    index = first_of(articles, "law", "no").select("law", "no", "article_id")
    per_law = articles.groupBy("law").agg(F.count("*").alias("n"), F.min("no").alias("low"), F.max("no").alias("high"))
    out = asked.join(index, ["law", "no"], "left").join(per_law, "law", "left")
    why = F.when(F.col("article_id").isNotNull(), "found").when(F.col("n").isNull(), "unknown law").otherwise(F.format_string("out of range %d-%d", "low", "high"))
    return out.select("query", "law", "no", "article_id", why.alias("message"))


def as_of(mentions: DataFrame, law_mentions: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """Each mention with the latest law mention at or before it, if that is within ``tolerance`` and resolved.

    One union and one running window instead of a range join; no earlier law is tried in its place.
    ``mentions(*by, pos, item)``, ``law_mentions(*by, pos, law)``.
    """
    both = mentions.select(*by, "pos", "item", F.lit(None).cast(dict(law_mentions.dtypes)["law"]).alias("law"), F.lit(1).alias("side"))
    both = both.unionByName(law_mentions.select(*by, "pos", F.lit(None).cast(dict(mentions.dtypes)["item"]).alias("item"), "law", F.lit(0).alias("side")))
    run = W.partitionBy(*by).orderBy("pos", "side").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("side") == 0, F.struct("pos", "law")), True).over(run)
    out = both.withColumn("seen", seen).where((F.col("side") == 1) & F.col("seen.law").isNotNull() & (F.col("pos") - F.col("seen.pos") <= tolerance))
    return out.select(*by, "pos", "item", F.col("seen.law").alias("law"))


def outermost(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans ``(*by, low, high)`` that lie strictly within no longer one of the same key.

    Sorted by start and descending end, a span is inside another exactly if an earlier one ends no
    sooner and is longer; a running maximum says so without a self join.
    """
    before = F.max("high").over(W.partitionBy(*by).orderBy("low").rangeBetween(W.unboundedPreceding, -1))
    same = F.max("high").over(W.partitionBy(*by, "low"))
    return spans.withColumn("b", before).withColumn("s", same).where((F.coalesce("b", F.col("high") - 1) < F.col("high")) & (F.col("s") == F.col("high"))).drop("b", "s")


def located(questions: DataFrame, key: str, laws: DataFrame, articles: DataFrame) -> DataFrame:
    """Questions that name one article: by a bracketed law, else by the longest law names in it, else by a number that one law has.

    ``laws(law, name)``, ``articles(law, no, pos, article_id)``. Only questions with exactly one
    article come back; the others go on to retrieval.
    """
    no = F.coalesce(
        F.nullif(F.regexp_extract("text", fixed.ASKED_NUMERAL, 1), F.lit("")),
        F.nullif(F.regexp_extract("text", fixed.ASKED_NUMBER, 1), F.lit("")),
    )
    asked = questions.select(key, "text", T.article_number(no).alias("no")).where("no is not null")
    named = asked.select(key, F.explode(F.regexp_extract_all("text", F.lit(fixed.TITLE), F.lit(1))).alias("name"))
    bracketed = resolved(named.withColumn("name", T.u_trim(F.col("name"))), laws.select(F.col("law").alias("id"), "name", F.monotonically_increasing_id().alias("pos")), key).where("id is not null").select(key, F.col("id").alias("law"), F.lit(1).alias("tier"))
    first = occurrences(asked, laws, key).groupBy(key, "name").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    inside = first.join(laws, "name").select(key, "law", "low", "high")
    spans = outermost(inside, [key]).select(key, "law", F.lit(2).alias("tier"))
    index = first_of(articles, "law", "no")
    anywhere = asked.join(index, "no").select(key, "law", F.lit(3).alias("tier"))
    options = bracketed.union(spans).union(anywhere).distinct().join(asked.select(key, "no"), key).join(index, ["law", "no"])
    # Where a law is named, a number in another law doesn't count.
    said = bracketed.union(spans).groupBy(key).agg(F.min("tier").alias("said"))
    options = options.join(said, key, "left").where(F.col("tier") == F.coalesce("said", F.lit(3)))
    return options.groupBy(key).agg(F.countDistinct("article_id").alias("n"), F.min("article_id").alias("article_id")).where("n = 1").drop("n")


def scope(laws: DataFrame, region: str | None) -> DataFrame | None:
    """National laws and those whose name has the region; None where that says nothing."""
    if not region or region == "?":
        return None
    local = laws.where(F.contains(F.col("name"), F.lit(region)))
    if laws.where(F.col("name") == region).count() or not local.count():
        return None
    return laws.where(~T.is_local(F.col("name"))).select("law").union(local.select("law")).distinct()


def cross_law(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """Articles that name another law in 《》."""
    named = articles.select("article_id", "law", F.explode(F.regexp_extract_all("text", F.lit(fixed.TITLE), F.lit(1))).alias("name"))
    known = laws.select(F.col("law").alias("id"), "name", F.monotonically_increasing_id().alias("pos"))
    hit = resolved(named, known, "article_id").where("id is not null").select("article_id", F.col("id").alias("other"))
    return articles.join(hit, (articles.article_id == hit.article_id) & (articles.law != hit.other), "left_semi")

