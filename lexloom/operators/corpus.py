"""From lines and paragraphs to articles, parents and chunks; all folds are windows.

Ordered input is ``(doc, pos, text)``. Numbering of what opens a new block is a running sum, so
a document is one window partition and documents are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.functions import text as T


def lines(docs: DataFrame, key: str, text: str = "text", pattern: str = "\n") -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, pattern)).alias("pos", "text"))


def denoised(table: DataFrame) -> DataFrame:
    """Stripped lines without spaces after Chinese marks, and without print marks, page numbers, rules and addresses."""
    line = F.regexp_replace(T.u_trim(F.col("text")), r"(?<=[　-〿＀-￯])[ \t]+(?=[一-鿿“”‘’])", "")
    return table.withColumn("text", line).where((F.col("text") != "") & ~F.col("text").rlike(T.LINE_NOISE))


def infrequent(table: DataFrame, least: int = 3, short: int = 30) -> DataFrame:
    """Drop short lines without punctuation that a document has ``least`` times or more."""
    n = F.count("*").over(W.partitionBy("doc", "text"))
    return table.withColumn("n", n).where((F.col("n") < least) | (F.length("text") > short) | F.col("text").rlike(T.LINE_PUNCTUATION)).drop("n")


def _islands(table: DataFrame, opens: Column, glue: str) -> DataFrame:
    order = W.partitionBy("doc").orderBy("pos")
    numbered = table.withColumn("block", F.sum(opens.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # Whatever comes before the first opening is a block of its own, opened by the first row.
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), glue)
    return numbered.groupBy("doc", "block").agg(F.min("pos").alias("pos"), joined.alias("text"))


def stitched(table: DataFrame, head: str = T.BLOCK_HEAD, glue: str = "") -> DataFrame:
    """Blocks that open at a heading; other lines are glued to the block before them."""
    return _islands(table, F.col("text").rlike(head), glue)


def without_doubled_headings(table: DataFrame) -> DataFrame:
    """Drop a marked heading that the next block begins with, and the marks of the others."""
    order = W.partitionBy("doc").orderBy("pos")
    body = T.u_trim(F.regexp_replace("text", r"^#{1,6}[ \t]*", ""))
    out = table.withColumn("body", body).withColumn("next", F.lead("body").over(order))
    doubled = (F.col("body") != F.col("text")) & F.coalesce(F.col("next").startswith(F.col("body")), F.lit(False))
    return out.where(~doubled & (F.col("body") != "")).select("doc", "pos", F.col("body").alias("text"))


def merged_paragraphs(table: DataFrame, least: int = 15, marker: str = T.LIST_MARKER) -> DataFrame:
    """A list item or a paragraph under ``least`` characters joins the one before it, never the first."""
    kept = table.withColumn("text", T.u_trim(F.col("text"))).where("text <> ''")
    first = F.row_number().over(W.partitionBy("doc").orderBy("pos")) == 1
    kept = kept.withColumn("opens", first | ~(F.col("text").rlike(marker) | (F.length("text") < least)))
    return _islands(kept, F.col("opens"), "\n")


def long_parts(text: Column, least: int = 500, end: str = "[。；]") -> Column:
    """Cut at the first sentence end that is ``least`` characters or more from the last cut; stripped, blanks dropped.

    ``least`` is the length that a cut needs, so that parts are no shorter, but for the last.
    """
    ends = F.array_compact(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(end), i + 1)))
    cuts = F.aggregate(ends, F.array(F.lit(0)), lambda acc, e: F.when(e - F.element_at(acc, -1) >= least, F.array_append(acc, e)).otherwise(acc))
    all_cuts = F.array_append(cuts, F.length(text))
    pieces = F.transform(F.sequence(F.lit(1), F.size(all_cuts) - 1), lambda i: T.u_trim(F.substring(text, F.element_at(all_cuts, i) + 1, F.element_at(all_cuts, i + 1) - F.element_at(all_cuts, i))))
    return F.when(F.length(text) <= least, F.array(text)).otherwise(F.filter(pieces, lambda p: p != ""))


def kind_of(text: Column, many: bool = False) -> Column:
    """chapter, section, article or other. Chapter and section numbers have one character unless ``many``."""
    n = T.NUMERAL + ("+" if many else "")
    return F.when(text.rlike(fixed.CHAPTER_LINE.format(n=n)), "chapter").when(text.rlike(fixed.SECTION_LINE.format(n=n)), "section").when(text.rlike(fixed.ARTICLE_LINE), "article").otherwise("other")


def parsed(paragraphs: DataFrame, many: bool = False) -> tuple[DataFrame, DataFrame]:
    """(articles, leftovers) of cleaned paragraphs ``(doc, pos, text)``.

    With a table of contents (目录), articles are looked for after the chapter and section lines
    that follow it. The body begins at the last chapter before the first article. Articles carry
    their chapter and section; a section ends at the next chapter. Lines between a heading and an
    article are leftovers; what is before the body is the preamble. Without an article all is
    leftovers, or with a table of contents nothing is.
    """
    order = W.partitionBy("doc").orderBy("pos")
    so_far, whole = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("doc")
    t = paragraphs.withColumn("text", T.clean(F.col("text"))).where("text <> ''").withColumn("kind", kind_of(F.col("text"), many))
    t = t.withColumn("i", F.row_number().over(order)).withColumn("toc", F.min(F.when(F.col("text").rlike(fixed.CONTENTS_LINE), F.col("i"))).over(whole))
    after = (F.col("i") > F.col("toc")) & ~F.col("kind").isin("chapter", "section")
    t = t.withColumn("toc_end", F.coalesce(F.min(F.when(after, F.col("i"))).over(whole) - 1, F.col("toc"), F.lit(0)))
    t = t.withColumn("first_article", F.min(F.when((F.col("kind") == "article") & (F.col("i") > F.col("toc_end")), F.col("i"))).over(whole))
    in_front = (F.col("kind") == "chapter") & (F.col("i") <= F.col("first_article")) & (F.col("i") > F.coalesce("toc", F.lit(0)))
    t = t.withColumn("body", F.coalesce(F.max(F.when(in_front, F.col("i"))).over(whole), F.col("first_article"), F.when(F.col("toc").isNull(), 1)))
    t = t.withColumn("shown", F.concat_ws(" ", F.regexp_extract("text", fixed.HEAD_MARK, 0), F.nullif(T.squeeze(F.regexp_replace("text", fixed.HEAD_MARK, "")), F.lit(""))))
    b = t.where("i >= body")
    b = b.withColumn("chapter", F.last(F.when(F.col("kind") == "chapter", F.col("shown")), True).over(so_far))
    b = b.withColumn("chapter_no", F.count(F.when(F.col("kind") == "chapter", 1)).over(so_far))
    in_chapter = W.partitionBy("doc", "chapter_no").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("shown")), True).over(in_chapter))
    b = b.withColumn("block", F.count(F.when(F.col("kind") != "other", 1)).over(so_far))
    b = b.withColumn("head", F.first("kind").over(W.partitionBy("doc", "block").orderBy("pos")))
    body = b.where("head = 'article'").groupBy("doc", "block").agg(
        F.min("pos").alias("pos"), F.first("chapter").alias("chapter"), F.first("section").alias("section"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("paragraphs"),
    )
    no = F.regexp_extract(F.element_at("paragraphs", 1), f"^({T.ARTICLE_REF})", 1)
    articles = body.withColumn("article_no", no).withColumn("text", F.array_join("paragraphs", "\n")).withColumn("article_index", F.row_number().over(W.partitionBy("doc").orderBy("pos")))
    articles = articles.withColumn("refs", T.references(F.col("text"), F.col("article_no"))).select("doc", "article_index", "article_no", "chapter", "section", "text", "paragraphs", "refs")
    return articles, b.where("head <> 'article' and kind = 'other'").select("doc", "pos", "text")


def parents_and_chunks(articles: DataFrame, least: int = 15, cut_at: int = 500) -> tuple[DataFrame, DataFrame]:
    """Parents (one per article) and their chunks, with ids, citation and the text to embed.

    ``articles`` has the columns of :func:`parsed` and ``law_id, law_name, version``.
    """
    pid = F.format_string("%s@%s#a%03d", "law_id", "version", "article_index")
    parents = articles.withColumn("parent_id", pid).withColumn("citation", T.citation(F.col("law_name"), F.col("version")))
    table = parents.select(F.col("parent_id").alias("doc"), F.posexplode("paragraphs").alias("pos", "text"))
    spread = merged_paragraphs(table, least).select("doc", "pos", F.posexplode(long_parts(F.col("text"), cut_at)).alias("n", "piece"))
    spread = spread.withColumn("part_index", F.row_number().over(W.partitionBy("doc").orderBy("pos", "n")) - 1)
    spread = spread.withColumn("part_total", F.count("*").over(W.partitionBy("doc")))
    chunks = parents.join(spread.withColumnRenamed("doc", "parent_id").select("parent_id", "part_index", "part_total", "piece"), "parent_id", "left")
    chunks = chunks.fillna({"part_index": 0, "part_total": 1, "piece": ""})
    body = F.when(F.col("part_index") == 0, F.regexp_replace("piece", rf"^{T.ARTICLE_REF}[\s　]*", "")).otherwise(F.col("piece"))
    embed = F.concat(F.lit("《"), "law_name", F.lit("》"), F.when(F.coalesce("chapter", F.lit("")) != "", F.concat("chapter", F.lit(" "))).otherwise(""), "article_no", F.lit("："), body)
    chunks = chunks.withColumn("chunk_id", F.format_string("%s#p%02d", "parent_id", "part_index")).withColumn("embed_text", embed)
    return parents.drop("paragraphs"), chunks.drop("text", "paragraphs").withColumnRenamed("piece", "text")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    n = F.count("*")
    return chunks.agg(n.alias("chunks"), F.countDistinct("law_id").alias("laws"), F.sum(F.length("text")).alias("chars"), F.round(F.sum(F.length("text")) / F.greatest(n, F.lit(1)), 1).alias("avg_chars"))


def laws_of(parents: DataFrame) -> DataFrame:
    """Laws by name: the last seen name and version, distinct article numbers, whether local."""
    last = F.max_by(F.struct("law_name", "version"), "pos")
    out = parents.groupBy("law_id").agg(last.alias("last"), F.countDistinct("article_no").alias("articles"))
    return out.select("law_id", "last.law_name", "last.version", "articles", T.is_local(F.col("last.law_name")).alias("local")).orderBy("law_name", "law_id")
