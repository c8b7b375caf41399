"""The whole of a retrieval, for a table of queries: rewrite, two channels, fusion, parents, reranking.

Each step is one of :mod:`lexloom.operators.search` and :mod:`lexloom.operators.rewrite`; this
module only composes them, and says in notes what was left out. An embedder is a column function
of the text, a reranker one of question and passage (Arrow UDFs of a model, or anything built
in). One that fails doesn't stop the retrieval: without vectors BM25 alone is asked, without
scores the fused order stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import rewrite, search


@dataclass(frozen=True)
class Settings:
    top_k: int = 6
    candidates: int = 20
    rrf_k: int = search.RRF_K
    boost: float = search.HINT_BOOST
    rerank_first: int = 0


@dataclass(frozen=True)
class Corpus:
    """A built index: lexical part, ``chunks(chunk_id, parent_id, name, law, [vector])``, ``parents(parent_id, text)``."""

    index: search.Index
    chunks: DataFrame
    parents: DataFrame

    @property
    def has_vectors(self) -> bool:
        return "vector" in self.chunks.columns


def normalized(queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Stripped text, at least one result, and no fewer candidates than results; ``top_k`` and ``candidates`` may be columns."""
    have = queries.columns
    k = F.greatest(F.lit(1), F.coalesce(F.col("top_k"), F.lit(settings.top_k)) if "top_k" in have else F.lit(settings.top_k))
    c = F.coalesce(F.col("candidates"), F.lit(settings.candidates)) if "candidates" in have else F.lit(settings.candidates)
    return queries.withColumns({"text": T.u_trim(F.col("text")), "top_k": k, "candidates": F.greatest(k, c)})


def _fails(df: DataFrame) -> str | None:
    """Why a table of the queries or of their hits can't be computed, or None; it is persisted, and needed in full."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except PySparkException as error:
        return type(error).__name__
    return None


def retrieved(
    corpus: Corpus,
    queries: DataFrame,
    settings: Settings = Settings(),
    embed: Callable[[Column], Column] | None = None,
    score: Callable[[Column, Column], Column] | None = search.overlap_score,
    hints: DataFrame | None = None,
    aliases=None,
    query: str = "query_id",
) -> tuple[DataFrame, list[str]]:
    """(results, notes): each query's parents by rank, with channel ranks and the hint that fired.

    ``queries(query, text)`` may have ``laws`` (a filter), ``top_k`` and ``candidates``.
    """
    notes: list[str] = []
    asked = normalized(queries, settings)
    if aliases is not None:
        asked = rewrite.expanded(asked, aliases)
        asked = asked.withColumn("search", F.col("expanded"))
    else:
        asked = asked.withColumn("search", F.col("text"))
    most = asked.agg(F.max("candidates").alias("c")).first().c or settings.candidates
    # The filter of a query and its text; the question itself goes to the reranker.
    keys = [query, *(["laws"] if "laws" in asked.columns else [])]
    own = asked.select(query, "candidates", "top_k")

    def cut(channel: DataFrame) -> DataFrame:
        return channel.join(own, query).where(F.col("rank") <= F.col("candidates")).select(query, "chunk_id", "score", "rank")

    channels: dict[str, DataFrame] = {}
    if embed is None:
        notes.append("no embedder: BM25 only")
    elif not corpus.has_vectors:
        notes.append("the index has no vectors: BM25 only")
    else:
        vectors = asked.select(*keys, embed(F.col("search")).alias("vector")).persist()
        failed = _fails(vectors)
        if failed:
            notes.append(f"embedding the queries failed ({failed}): BM25 only")
        else:
            channels["dense"] = cut(search.top_dense(corpus.chunks, vectors, most, "chunk_id", query))
    lexical = asked.select(*keys, F.col("search").alias("text"))
    channels["bm25"] = cut(search.top_bm25(corpus.index, lexical, most, query, "chunk_id"))

    hits = search.fuse(channels, most, settings.rrf_k, query, "chunk_id")
    hits = hits.join(own.select(query, "candidates"), query).where(F.col("rank") <= F.col("candidates"))
    parents = search.group_to_parents(hits, corpus.chunks.select("chunk_id", "parent_id", "name"), hints, query, settings.boost)
    in_hits = hits.select(query, "chunk_id")
    for name, channel in channels.items():
        best = search.best_of_channel(channel.join(in_hits, [query, "chunk_id"], "left_semi"), corpus.chunks, query)
        parents = parents.join(best.withColumnsRenamed({"best_rank": f"{name}_rank", "best_score": f"{name}_score"}), [query, "parent_id"], "left")
    if "dense" not in channels:
        parents = parents.withColumns({"dense_rank": F.lit(None).cast("int"), "dense_score": F.lit(None).cast("double")})
    full = parents.join(asked.select(query, F.col("text").alias("question"), "top_k"), query).join(corpus.parents.select("parent_id", F.col("text").alias("passage")), "parent_id")
    if score is None:
        notes.append("no reranker: fused order")
    else:
        scored = search.rerank(full, "question", "passage", settings.rerank_first, score(F.col("question"), F.col("passage")), query)
        failed = None
        if score is not search.overlap_score:  # a model may fail, what is built in does not
            scored = scored.persist()
            failed = _fails(scored)
        if failed:
            notes.append(f"reranking failed ({failed}): fused order")
        else:
            full = scored
    out = full.where(F.col("rank") <= F.col("top_k"))
    return out.select(query, "parent_id", "rank", "score", "hit_chunks", "hint", "dense_rank", "dense_score", "bm25_rank", "bm25_score"), notes
