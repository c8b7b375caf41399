"""What the engine writes: tables, JSON lines, Markdown of laws, the search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import postings


def save(df: DataFrame, path: str, export_json: bool = False) -> None:
    """Replace a table; optionally export it as JSON lines beside."""
    df.write.mode("overwrite").parquet(path)
    if export_json:
        df.write.mode("overwrite").json(f"{path}.jsonl")


def append_material(df: DataFrame, path: str) -> None:
    """Chunks of session uploads, by document."""
    df.write.mode("append").partitionBy("doc_id").parquet(path)


def markdown(articles: DataFrame) -> DataFrame:
    """(doc, markdown): a chapter's and a section's heading once for each distinct text, then its articles."""
    seen = {c: F.row_number().over(W.partitionBy("doc", c).orderBy("article_index")) == 1 for c in ("chapter", "section")}
    heads = [F.when(F.col(c).isNotNull() & new, F.concat(F.lit(mark), F.col(c), F.lit("\n\n"))).otherwise("") for (c, new), mark in zip(seen.items(), ("## ", "### "))]
    t = articles.withColumn("block", F.concat(*heads, F.lit("#### "), "article_no", F.lit("\n\n"), "text"))
    ordered = F.array_sort(F.collect_list(F.struct("article_index", "block")))
    return t.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("markdown"))


def manifest(articles: DataFrame, leftovers: DataFrame) -> DataFrame:
    counts = articles.groupBy("doc").agg(F.count("*").alias("articles"), F.sum(F.length("text")).alias("chars"), F.count_distinct("chapter").alias("chapters"), F.count_distinct("section").alias("sections"))
    left = leftovers.groupBy("doc").agg(F.count("*").alias("leftovers"))
    return counts.join(left, "doc", "left").na.fill(0, ["leftovers"])


def build_index(spark: SparkSession, chunks: DataFrame, path: str, embed=None) -> list[str]:
    """Write chunks, postings, term and corpus statistics; without an embedder, or if it fails, a note and no vectors.

    ``embed`` is a column function of the text to embed (an Arrow UDF of a model).
    """
    rows = chunks.na.fill("", [c for c in ("chapter", "section") if c in chunks.columns])
    notes = []
    if embed is None:
        notes.append("no embedder: lexical search only")
    else:
        rows = rows.withColumn("vector", embed(F.col("embed_text")))
    try:
        save(rows, f"{path}/chunks")
    except Exception as error:  # a model may fail in any way; the lexical index is built all the same
        if embed is None:
            raise
        notes.append(f"embedding failed: {type(error).__name__}")
        save(rows.drop("vector"), f"{path}/chunks")
    rows = spark.read.parquet(f"{path}/chunks")
    save_index(rows.withColumnRenamed("embed_text", "text") if "text" not in rows.columns else rows.drop("text").withColumnRenamed("embed_text", "text"), path, "chunk_id", "law_id")
    laws = rows.agg(F.count("*").alias("chunks"), F.count_distinct("law_id").alias("laws")).withColumn("notes", F.array(*map(F.lit, notes)).cast("array<string>"))
    save(laws, f"{path}/meta")
    return notes


def save_index(docs: DataFrame, path: str, key: str, law: str | None = None, **shards) -> None:
    """Shards of documents with their postings in blocks, written as they are read; terms; and the corpus's lengths."""
    spark = docs.sparkSession
    postings.shards(docs, key, "text", law, **shards).write.mode("overwrite").parquet(f"{path}/shards")
    index = postings.index_of(spark.read.parquet(f"{path}/shards"))
    save(index.terms, f"{path}/terms")
    save(spark.createDataFrame([(index.documents, index.mean_length, index.shards)], "documents long, mean_length double, shards long"), f"{path}/lengths")


def load_index(spark: SparkSession, path: str) -> postings.Index:
    lengths = spark.read.parquet(f"{path}/lengths").first()
    return postings.index_of(spark.read.parquet(f"{path}/shards"), spark.read.parquet(f"{path}/terms"), (lengths.documents, lengths.mean_length, lengths.shards))
