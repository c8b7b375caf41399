"""Gates before a file enters the corpus, and what changed since the last build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUFFIXES = r"\.(docx|md|txt|pdf)$"
MOST_BYTES, MOST_LEFTOVER = 8 << 20, 0.2


def gated(files: DataFrame, order: str, known: DataFrame | None = None, most_bytes: int = MOST_BYTES, most_leftover: float = MOST_LEFTOVER) -> DataFrame:
    """Add ``status``: the first gate that a file fails, else ``ready``.

    ``files(file, size, sha1, articles, leftover)``, optionally ``law_id``; duplicates count by
    ``order``, and against ``known(sha1, law_id)``.
    """
    nth = F.row_number().over(W.partitionBy("sha1").orderBy(order))
    out = files.withColumn("__nth", nth)
    doubled: Column = F.col("__nth") > 1
    if known is not None:
        out = out.join(known.select("sha1").distinct().withColumn("__known", F.lit(True)), "sha1", "left")
        doubled = doubled | F.coalesce("__known", F.lit(False))
    status = (
        F.when(~F.lower("file").rlike(SUFFIXES), "suffix").when(F.col("size") == 0, "empty").when(F.col("size") > most_bytes, "too large")
        .when(F.col("file").rlike(r"(^|[/\\])\.\.([/\\]|$)"), "unsafe name").when(F.col("articles") == 0, "no article").when(F.col("leftover") > most_leftover, "leftovers").when(doubled, "duplicate")
    )
    if "law_id" in files.columns:
        out = out.withColumn("__law", F.row_number().over(W.partitionBy("law_id").orderBy(order)))
        taken = F.col("__law") > 1
        if known is not None:
            out = out.join(known.select("law_id").distinct().withColumn("__held", F.lit(True)), "law_id", "left")
            taken = taken | F.coalesce("__held", F.lit(False))
        status = status.when(taken, "law exists")
    return out.withColumn("status", status.otherwise("ready")).drop("__nth", "__known", "__law", "__held")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """State of each file between two manifests ``(file, sha1)``: new, gone, changed or same."""
    a, b = old.select("file", F.col("sha1").alias("a")), new.select("file", F.col("sha1").alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "file", "full").select("file", state.alias("state"))


def unchanged(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to parse, files whose stored parse is reused)."""
    return files.join(manifest, ["file", "sha1"], "left_anti"), files.join(manifest, ["file", "sha1"], "left_semi")


def stale_reason(facts: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The first rule that holds of a row of counts, else null: rules are ordered."""
    reason = None
    for name, holds in rules:
        reason = F.when(holds, name) if reason is None else reason.when(holds, name)
    return facts.withColumn("reason", reason)


def stale_rules() -> list[tuple[str, Column]]:
    """The reasons to build anew, in the order they are asked."""
    return [
        ("no structure", F.col("laws") == 0),
        ("parse missing", F.col("unparsed") > 0),
        ("file count", F.col("files") != F.col("laws")),
        ("new file", F.col("first_odd") == "new"),
        ("file changed", F.col("first_odd") == "changed"),
        ("no chunks", F.col("parents").isNull() | F.col("chunks").isNull()),
        ("parents differ", F.col("parents") != F.col("articles")),
        ("no snapshot", F.col("snapshot_rows").isNull()),
        ("no collection", F.col("collection_rows").isNull()),
        ("rows differ", F.col("collection_rows") != F.col("snapshot_rows")),
        ("other model", F.col("want_dense") & F.col("vector_enabled") & ~F.col("model").eqNullSafe(F.col("want_model"))),
        ("no vectors", F.col("want_dense") & ~F.col("vector_enabled") & ~F.col("embed_failed")),
    ]


def build_facts(manifest: DataFrame, parsed: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """Counts that the rules on structure ask, of each corpus ``by``.

    ``manifest(file, law_id, sha1, articles)``, ``parsed(law_id)`` that are there, ``files(file, sha1)``
    of the source. A corpus counts if it has a row in ``manifest`` or ``files``. ``first_odd`` says
    whether the first file, by name, that doesn't match the manifest is ``new`` or ``changed``.
    """
    there = parsed.select(*by, "law_id").distinct().withColumn("__there", F.lit(True))
    laws = manifest.join(there, [*by, "law_id"], "left").groupBy(*by).agg(
        F.count("*").alias("laws"), F.count_if(F.col("__there").isNull()).alias("unparsed"), F.coalesce(F.sum("articles"), F.lit(0)).alias("articles"))
    known = manifest.groupBy(*by, "file").agg(F.max("sha1").alias("__sha1"), F.lit(True).alias("__known"))
    odd = F.when(F.col("__known").isNull(), "new").when(~F.col("sha1").eqNullSafe(F.col("__sha1")), "changed")
    first = F.min(F.when(odd.isNotNull(), F.struct("file", odd.alias("kind"))))
    sources = files.join(known, [*by, "file"], "left").groupBy(*by).agg(F.count("*").alias("files"), first["kind"].alias("first_odd"))
    return laws.join(sources, by, "full").na.fill(0, ["laws", "unparsed", "articles", "files"])


def staleness(facts: DataFrame, rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    """``reason`` to build each corpus anew, null where it is up to date.

    Beside the columns of ``build_facts``: ``parents``, ``chunks``, ``snapshot_rows``,
    ``collection_rows`` (null: not there), ``want_dense``, ``vector_enabled``, ``model``,
    ``want_model``, ``embed_failed``. Null flags count as false.
    """
    flags = ["want_dense", "vector_enabled", "embed_failed"]
    return stale_reason(facts.na.fill(False, flags), rules or stale_rules())
