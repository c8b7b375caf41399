"""Queries of the retrieval core: BM25, dense, fusion, grouping, reranking, merging, materials."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import postings, retrieve, rewrite, rounds, search, vector_index
from lexloom.operators.names import occurrences
from lexloom.plans.tables import Book, table
from lexloom.session import scratch_folder
from lexloom.sources import segments, sinks

BOOK = Book()

_BM25 = r"""
 tok AS (SELECT {key} AS k, {keep} AS keep, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ts FROM {docs}),
 totals AS (SELECT count(*) AS n, avg(coalesce(len(ts), 0)) AS avgdl FROM tok),
 q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM {queries}) GROUP BY ALL),
 terms AS (SELECT DISTINCT term FROM q),
 tf AS (SELECT k, keep, dl, term, count(*) AS tf FROM (SELECT k, keep, len(ts) AS dl, unnest(ts) AS term FROM tok) SEMI JOIN terms USING (term) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sc AS (SELECT item_id, k, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS raw, round(raw, 6) AS score
        FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN totals WHERE keep GROUP BY item_id, k),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 9) DESC, k) AS rank FROM sc)"""


def _bm25_sql(docs: str = "documents", key: str = "doc_id", keep: str = "true", queries: str = "benchmark") -> str:
    return _BM25.format(docs=docs, key=key, keep=keep, queries=queries)


_LINES = "(SELECT doc_id, i - 1 AS line, doc_id || '#' || (i - 1) AS chunk_id, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(parts[i]) <> '')"


def _chunks(spark, sf_dir) -> DataFrame:
    split = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("law"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return split.where(F.trim("text") != "").withColumn("chunk_id", F.concat_ws("#", "doc_id", "line"))


#: Indexes of this application by table, folder and its files: built once, read by every query after.
_built: dict[tuple[str, str, str, str], postings.Index] = {}


def _state(spark, path: str) -> str:
    """Names, sizes and times of a table's files: another state is another table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}{{,/*}}"))
    return ";".join(sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in found))


def corpus_index(spark, sf_dir, of: str = "documents") -> postings.Index:
    """The written index of the documents or of their lines; the first query that needs it builds it."""
    key = (spark.sparkContext.applicationId, sf_dir, of, _state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _built:
        path = f"{scratch_folder(spark, 'index')}/{len(_built)}"
        if of == "documents":
            sinks.save_index(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path, "doc_id", "source")
            _built[key] = sinks.load_index(spark, path)
        elif of == "lines":
            sinks.save_index(_chunks(spark, sf_dir), path, "chunk_id", "law")
            _built[key] = sinks.load_index(spark, path)
        else:
            segments.sync(spark, path, _older(spark, sf_dir))
            segments.sync(spark, path, _keyed(spark, sf_dir))
            _built[key] = segments.load(spark, path)
            _roots[key] = path
    return _built[key]


_roots: dict[tuple[str, str, str, str], str] = {}


def _keyed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.col("source").alias("law"))


def _older(spark, sf_dir) -> DataFrame:
    """The documents before a change: one source had other texts, one wasn't there, one had copies that are gone."""
    now = _keyed(spark, sf_dir)
    other = now.where("law is null or law <> 'src3'").withColumn("text", F.when(F.col("law") == "src0", F.concat(F.lit("older words "), "text")).otherwise(F.col("text")))
    return other.unionByName(now.where("law = 'src1'").withColumn("key", -1 - F.col("key")))


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


def _bm25(spark, sf_dir, limit: int, **options) -> DataFrame:
    return search.top_bm25(corpus_index(spark, sf_dir), _questions(spark, sf_dir), limit, "item_id", **options)


@BOOK.query(r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents), p AS (SELECT DISTINCT doc_id, unnest(ts) AS term FROM tok)
 SELECT (SELECT count(*) FROM tok) AS documents, (SELECT round(avg(coalesce(len(ts), 0)), 6) FROM tok) AS mean_length, (SELECT count(DISTINCT term) FROM p) AS terms, (SELECT count(*) FROM p) AS postings""")
def q_index_stats(spark, sf_dir):
    index = corpus_index(spark, sf_dir)
    sizes = index.terms.agg(F.count("*").alias("terms")).crossJoin(index.postings.agg(F.sum("n").alias("postings")))  # one row each
    return sizes.select(F.lit(index.documents).cast("long").alias("documents"), F.round(F.lit(index.mean_length), 6).alias("mean_length"), "terms", "postings")


@BOOK.query(f"WITH {_bm25_sql()} SELECT item_id, k AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6")
def q_bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 6)


@BOOK.query(f"WITH {_bm25_sql()} SELECT item_id, k AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6")
def q_incremental_topk(spark, sf_dir):
    """As q_bm25_topk, of an index that came from an older version of the documents by additions, changes and deletions."""
    return search.top_bm25(corpus_index(spark, sf_dir, "segments"), _questions(spark, sf_dir), 6, "item_id")


@BOOK.query("""SELECT change, count(*) AS n FROM (
 SELECT CASE WHEN source = 'src3' THEN 'added' WHEN source = 'src0' AND text IS NOT NULL THEN 'changed' ELSE 'unchanged' END AS change FROM documents
 UNION ALL SELECT 'deleted' FROM documents WHERE source = 'src1') GROUP BY change""")
def q_incremental_changes(spark, sf_dir):
    """What the second version of that index found to add, change and delete against the first."""
    corpus_index(spark, sf_dir, "segments")
    root = _roots[spark.sparkContext.applicationId, sf_dir, "segments", _state(spark, f"{sf_dir}/documents.parquet")]
    found = segments.changes(spark, root, _keyed(spark, sf_dir), segments.manifest(spark, root, 1))
    return found.groupBy("change").agg(F.count("*").alias("n"))


@BOOK.query(f"""WITH {_bm25_sql(keep="lang IN ('de', 'fr') AND source <> 'src0'")} SELECT item_id, k AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def q_filtered_search(spark, sf_dir):
    keep = F.col("lang").isin("de", "fr") & (F.col("source") != "src0")
    return _bm25(spark, sf_dir, 6, allowed=table(spark, sf_dir, "documents").where(keep).select("doc_id"))


_DENSE = """ v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
 d AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.v, q.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q.v, q.v))) AS raw, round(raw, 6) AS score FROM v CROSS JOIN v q),
 dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, vec_id) AS rank FROM d WHERE isfinite(raw)),
 h AS (SELECT vec_id, v[1:32] AS v FROM v),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.v, q.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q.v, q.v))) AS raw, round(raw, 6) AS score FROM h v CROSS JOIN h q),
 sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, vec_id) AS rank FROM s WHERE isfinite(raw)),
 f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, vec_id, rank FROM dr WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, rank FROM sr WHERE rank <= 20) GROUP BY ALL),
 fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f)"""


def _channels(spark, sf_dir, limit: int = 20) -> dict[str, DataFrame]:
    """Two rankings of the vectors for each of them: by whole vectors, and by their first halves."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    out = {}
    for name, v in (("dense", F.col("vector")), ("half", F.slice("vector", 1, 32))):
        t = vectors.select("vec_id", v.alias("vector"))
        out[name] = search.top_dense(t, t.withColumnRenamed("vec_id", "query_id"), limit, "vec_id")
    return out


@BOOK.query(f"WITH {_DENSE} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM dr WHERE rank <= 10")
def q_dense_topk(spark, sf_dir):
    return _channels(spark, sf_dir, 10)["dense"]


_vectors: dict[tuple[str, str, str], vector_index.VectorIndex] = {}


def _vector_index(spark, sf_dir) -> vector_index.VectorIndex:
    """An index of two thirds of the vectors, to which the others were added later."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _vectors:
        path = f"{scratch_folder(spark, 'vectors')}/{len(_vectors)}"
        rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
        late = F.pmod(F.xxhash64("vec_id"), F.lit(3)) == 0
        vector_index.build(rows.where(~late), path, "vec_id", list_rows=32)
        _vectors[key] = vector_index.add(rows.where(late), path, "vec_id")
    return _vectors[key]


def _asking(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@BOOK.query()
def q_vector_index(spark, sf_dir):
    """The ten nearest vectors of each by the inverted file, and how many rows were read for it."""
    made, asked = _vector_index(spark, sf_dir), _asking(spark, sf_dir)
    read = vector_index.rows_read(made, asked)
    return vector_index.searched(made, asked, 10, key="vec_id").join(read, "query_id")


@BOOK.query(f"WITH {_DENSE} SELECT count(*) AS true_pairs, true AS recall_reached, true AS scores_equal FROM dr WHERE rank <= 10")
def q_vector_recall(spark, sf_dir):
    """Whether the inverted file finds nine of ten true neighbours of all vectors, each with its true score."""
    found = vector_index.searched(_vector_index(spark, sf_dir), _asking(spark, sf_dir), 10, key="vec_id").select("query_id", "vec_id", F.col("score").alias("found"))
    both = _channels(spark, sf_dir, 10)["dense"].join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("true_pairs"), (F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"), F.coalesce(F.max(F.abs(F.col("found") - F.col("score"))) < 1e-6, F.lit(True)).alias("scores_equal"))


@BOOK.query(f"WITH {_DENSE} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 10")
def q_rrf_fusion(spark, sf_dir):
    return search.fuse(_channels(spark, sf_dir), 10, key="vec_id")


@BOOK.query(f"""WITH {_DENSE} SELECT fr.query_id, fr.vec_id, fr.score, CAST(fr.rank AS INTEGER) AS rank, CAST(a.rank AS INTEGER) AS dense_rank, a.score AS dense_score, CAST(b.rank AS INTEGER) AS half_rank, b.score AS half_score
 FROM fr LEFT JOIN (SELECT * FROM dr WHERE rank <= 20) a ON a.query_id = fr.query_id AND a.vec_id = fr.vec_id LEFT JOIN (SELECT * FROM sr WHERE rank <= 20) b ON b.query_id = fr.query_id AND b.vec_id = fr.vec_id WHERE fr.rank <= 10""")
def q_channel_detail(spark, sf_dir):
    channels = {name: c.persist(StorageLevel.DISK_ONLY) for name, c in _channels(spark, sf_dir).items()}  # each is read twice
    return search.with_channels(search.fuse(channels, 10, key="vec_id"), channels, key="vec_id")


def _parents(spark, sf_dir) -> DataFrame:
    """Chunks that are hit name their document and its source."""
    return _chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("parent_id"), F.col("law").alias("name"))


def _hints(spark, sf_dir) -> DataFrame:
    """Each question hints at two sources, the first of which is its first."""
    two = F.array(*[F.struct(F.lit(i).alias("pos"), F.concat(F.lit("src"), (F.col("item_id") + i) % 4).alias("hint")) for i in range(2)])
    return _questions(spark, sf_dir).select("item_id", F.explode(two).alias("x")).select("item_id", "x.pos", "x.hint")


_HINT = "CASE WHEN contains(any_value({name}), 'src' || ({id} % 4)) THEN 'src' || ({id} % 4) WHEN contains(any_value({name}), 'src' || (({id} + 1) % 4)) THEN 'src' || (({id} + 1) % 4) END"


@BOOK.query(f"""WITH {_bm25_sql(docs=_LINES, key="chunk_id")}, h AS (SELECT * FROM r WHERE rank <= 20),
 p AS (SELECT h.item_id, l.doc_id AS parent_id, {_HINT.format(name="d.source", id="h.item_id")} AS hint, max(h.score) * CASE WHEN hint IS NULL THEN 1 ELSE 1.5 END AS score, count(DISTINCT l.chunk_id) AS n, string_agg(l.chunk_id, ' ' ORDER BY l.chunk_id) AS chunks, min(h.rank) AS first
       FROM h JOIN {_LINES} l ON l.chunk_id = h.k JOIN documents d ON d.doc_id = l.doc_id GROUP BY h.item_id, l.doc_id)
 SELECT item_id, parent_id, hint, score, chunks, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n DESC, first) AS INTEGER) AS rank FROM p""")
def q_group_child_parent(spark, sf_dir):
    hits = search.top_bm25(corpus_index(spark, sf_dir, "lines"), _questions(spark, sf_dir), 20, "item_id", "chunk_id")
    grouped = search.group_to_parents(hits, _parents(spark, sf_dir), _hints(spark, sf_dir), "item_id")
    return grouped.select("item_id", "parent_id", "hint", "score", F.array_join("hit_chunks", " ").alias("chunks"), "rank")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


#: For each byte its letter's place, or that of all others.
_PLACES = np.full(256, len(_LETTERS))
_PLACES[list(_LETTERS.encode())] = np.arange(len(_LETTERS))
#: Bytes that are counted at once.
_PIECE = 1 << 18


def _counted(text: pa.Array) -> pa.Array:
    """Letters are single bytes in UTF-8, which no other character has."""
    text = text.cast(pa.large_string())
    n, wide = len(text), len(_LETTERS) + 1
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    counts = np.zeros((n, wide))
    for low in range(ends[0], ends[-1], _PIECE):
        high = min(low + _PIECE, ends[-1])
        first, last = np.searchsorted(ends, [low, high - 1], "right") - 1
        rows = np.repeat(np.arange(last - first + 1), np.diff(ends[first : last + 2].clip(low, high)))
        counts[first : last + 1] += np.bincount(rows * wide + _PLACES[data[low:high]], minlength=(last - first + 1) * wide).reshape(-1, wide)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (wide - 1))
    return pa.ListArray.from_arrays(offsets, pa.array(counts[:, :-1].ravel()), mask=text.is_null())


def letter_counts(text: Column) -> Column:
    """A stand-in embedder: how often each letter a-z occurs, each text read once."""
    return F.arrow_udf(_counted, "array<double>")(text)


_VECTOR = "list_transform(string_split('" + " ".join(_LETTERS) + "', ' '), lambda c: CAST(length({0}) - length(replace({0}, c, '')) AS DOUBLE))"
_ALLOWED = "(b.item_id % 3 <> 0 OR d.source IN ('src1', 'src2'))"


@BOOK.query(rf"""WITH lines AS {_LINES}, tok AS (SELECT chunk_id, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ts FROM lines), totals AS (SELECT count(*) AS n, avg(coalesce(len(ts), 0)) AS avgdl FROM tok),
 b AS (SELECT item_id, trim(text) AS text FROM benchmark), q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM b) GROUP BY ALL),
 tf AS (SELECT chunk_id, doc_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) SEMI JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sb AS (SELECT item_id, chunk_id, any_value(doc_id) AS doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS raw FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN totals GROUP BY item_id, chunk_id),
 bm AS (SELECT b.item_id, chunk_id, raw, row_number() OVER (PARTITION BY b.item_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank FROM sb b JOIN documents d USING (doc_id) WHERE {_ALLOWED} QUALIFY rank <= 20),
 v AS (SELECT chunk_id, doc_id, {_VECTOR.format("text")} AS v FROM lines), qv AS (SELECT item_id, {_VECTOR.format("text")} AS v FROM b),
 sd AS (SELECT b.item_id, chunk_id, list_dot_product(v.v, b.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(b.v, b.v))) AS raw FROM v JOIN documents d USING (doc_id) CROSS JOIN qv b WHERE {_ALLOWED}),
 de AS (SELECT item_id, chunk_id, raw, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank FROM sd WHERE isfinite(raw) QUALIFY rank <= 20),
 f AS (SELECT item_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT item_id, chunk_id, rank FROM bm UNION ALL SELECT item_id, chunk_id, rank FROM de) GROUP BY ALL),
 fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 20),
 p AS (SELECT fr.item_id, l.doc_id AS parent_id, {_HINT.format(name="d.source", id="fr.item_id")} AS hint, max(fr.score) * CASE WHEN hint IS NULL THEN 1 ELSE 1.5 END AS score, count(*) AS n, string_agg(fr.chunk_id, ' ' ORDER BY fr.chunk_id) AS chunks, min(fr.rank) AS first, min(de.rank) AS dense_rank, min(bm.rank) AS bm25_rank
   FROM fr JOIN lines l USING (chunk_id) JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN de ON de.item_id = fr.item_id AND de.chunk_id = fr.chunk_id LEFT JOIN bm ON bm.item_id = fr.item_id AND bm.chunk_id = fr.chunk_id GROUP BY fr.item_id, l.doc_id),
 g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n DESC, first) AS rank FROM p),
 x AS (SELECT g.*, len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+')), list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+'))), 1) AS new FROM g JOIN b USING (item_id) JOIN documents d ON d.doc_id = g.parent_id),
 y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (rank <= 8) DESC, CASE WHEN rank <= 8 THEN -round(new, 9) END, rank) AS place FROM x)
 SELECT item_id, parent_id, CAST(place AS INTEGER) AS rank, CASE WHEN rank <= 8 THEN round(new, 6) ELSE score END AS score, chunks, hint, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank FROM y WHERE place <= CASE WHEN item_id % 2 = 0 THEN 6 ELSE 10 END""")
def q_retrieve(spark, sf_dir):
    """The whole retrieval of every question: filter, dense and BM25, fusion, parents with hints, reranking."""
    asked = _questions(spark, sf_dir).withColumns({"laws": F.when(F.col("item_id") % 3 == 0, F.array(F.lit("src1"), F.lit("src2"))), "top_k": F.when(F.col("item_id") % 2 == 0, 6).otherwise(10)})
    chunks = _chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("parent_id"), F.col("law").alias("name"), "law", letter_counts(F.col("text")).alias("vector"))
    corpus = retrieve.Corpus(corpus_index(spark, sf_dir, "lines"), chunks, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), "text"))
    found, _ = retrieve.retrieved(corpus, asked, retrieve.Settings(rerank_first=8), letter_counts, hints=_hints(spark, sf_dir), query="item_id")
    return found.select("item_id", "parent_id", "rank", "score", F.array_join("hit_chunks", " ").alias("chunks"), "hint", "dense_rank", "bm25_rank")


_TERMS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"


@BOOK.query(f"""WITH {_bm25_sql()},
 pool AS (SELECT r.item_id, k AS doc_id, rank, r.score, len(list_intersect({_TERMS.format('b.text')}, {_TERMS.format('d.text')})) / greatest(len({_TERMS.format('b.text')}), 1) AS new
          FROM r JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = r.k WHERE rank <= 20),
 w AS (SELECT *, rank <= 10 AS inside, CASE WHEN rank <= 10 THEN round(new, 6) ELSE score END AS s FROM pool)
 SELECT * FROM (SELECT item_id, doc_id, s AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY inside DESC, CASE WHEN inside THEN -round(new, 9) END, rank) AS INTEGER) AS rank FROM w) WHERE rank <= 12""")
def q_rerank(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", "text"), _questions(spark, sf_dir)
    pool = _bm25(spark, sf_dir, 20).join(asked.withColumnRenamed("text", "question"), "item_id").join(docs, "doc_id")
    return search.rerank(pool, "question", "text", 10, query="item_id").where("rank <= 12").select("item_id", "doc_id", "score", "rank")


_ALIASES = [("the", ["that", "with", "from"]), ("on", ["onto", "upon"]), ("er", ["better", "that"]), ("ing", ["going", "upon", "doing"]), ("qu", ["queue"]), ("th", ["thus", "then", "this"])]


@BOOK.query("""WITH a AS (SELECT * FROM (VALUES %s) t(alias, ap, term, tp)),
 hit AS (SELECT item_id, term, ap, tp FROM benchmark JOIN a ON contains(trim(text), alias) AND NOT contains(trim(text), term)),
 one AS (SELECT item_id, term, min(ap * 100 + tp) AS p FROM hit GROUP BY ALL),
 eight AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) AS n FROM one QUALIFY n <= 8),
 m AS (SELECT item_id, string_agg(alias, ' ' ORDER BY ap) AS matched FROM (SELECT DISTINCT item_id, alias, ap FROM benchmark JOIN a ON contains(trim(text), alias)) GROUP BY item_id)
 SELECT b.item_id, coalesce(matched, '') AS matched, coalesce(e.x, '') AS expansions, trim(text) || coalesce(' ' || e.x, '') AS expanded
 FROM benchmark b LEFT JOIN m USING (item_id) LEFT JOIN (SELECT item_id, string_agg(term, ' ' ORDER BY p) AS x FROM eight GROUP BY item_id) e USING (item_id)"""
    % ", ".join(f"('{a}', {i}, '{t}', {j})" for i, (a, ts) in enumerate(_ALIASES) for j, t in enumerate(ts)))
def q_alias_expand(spark, sf_dir):
    out = rewrite.expanded(_questions(spark, sf_dir), _ALIASES)
    return out.select("item_id", F.array_join("matched", " ").alias("matched"), F.array_join("expansions", " ").alias("expansions"), "expanded")


def _two_rounds(spark, sf_dir) -> DataFrame:
    c = _channels(spark, sf_dir)
    return c["dense"].withColumn("round", F.lit(1)).unionByName(c["half"].withColumn("round", F.lit(2)))


_ROUNDS = f"{_DENSE}, two AS (SELECT query_id, vec_id, rank, 1 AS round FROM dr WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, rank, 2 FROM sr WHERE rank <= 20)"


@BOOK.query(f"""WITH {_ROUNDS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY rank, round) AS nth FROM two)
 SELECT query_id, vec_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, round) AS place FROM k WHERE nth = 1) WHERE place <= 12""")
def q_merge_rounds(spark, sf_dir):
    return rounds.interleaved(_two_rounds(spark, sf_dir), 12, key="vec_id").select("query_id", "vec_id", "place")


@BOOK.query(f"""WITH {_ROUNDS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY round, rank) AS nth FROM two)
 SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round, rank) AS INTEGER) AS place FROM k WHERE nth = 1""")
def q_concat_dedupe(spark, sf_dir):
    return rounds.concatenated(_two_rounds(spark, sf_dir), key="vec_id").select("query_id", "vec_id", "place")


_GRAMS = r"(CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END)"


@BOOK.query(rf"""WITH t AS (SELECT conv_id, turn, role, lower(regexp_replace(text, '\s+', '', 'g')) AS s FROM conversations WHERE text IS NOT NULL),
 q AS (SELECT conv_id, turn AS query_id, {_GRAMS.format("s")} AS g FROM t WHERE role = 'user'), p AS (SELECT conv_id, turn AS position, {_GRAMS.format("s")} AS g FROM t WHERE role = 'assistant'),
 x AS (SELECT q.conv_id AS scope, query_id, position, round(len(list_intersect(q.g, p.g)) / greatest(len(q.g), 1), 6) AS score FROM q JOIN p USING (conv_id) WHERE len(list_intersect(q.g, p.g)) > 0)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope, query_id ORDER BY score DESC, position) AS INTEGER) AS rank FROM x) WHERE rank <= 5""")
def q_material_overlap(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("text is not null").withColumnRenamed("conv_id", "scope")
    asked = t.where("role = 'user'").select("scope", F.col("turn").alias("query_id"), "text")
    return rounds.material_scores(t.where("role = 'assistant'").select("scope", F.col("turn").alias("position"), "text"), asked)


@BOOK.query(r"""WITH p AS (SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE trim(text) <> '')
 SELECT conv_id AS request, turn, substr(text, 1, 600) AS text, '[材料' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) || ']' AS label FROM p""")
def q_material_labels(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), "turn", F.col("turn").alias("doc_pos"), F.col("text").alias("line_no"), "text")
    return rounds.labelled_materials(t).select("request", "turn", "text", "label")


@BOOK.query(r"""WITH g AS (SELECT item_id, replace(trim(text), chr(10), ' ') AS s FROM benchmark), q AS (SELECT unnest(['th', 'he', 'ea', 'an', 'nd']) AS gram),
 c AS (SELECT item_id, s, i, substr(s, i, 2) AS gram FROM (SELECT item_id, s, unnest(range(1, length(s))) AS i FROM g)),
 n AS (SELECT item_id, gram, count(*) AS n FROM c SEMI JOIN q USING (gram) GROUP BY ALL),
 m AS (SELECT c.item_id, i, coalesce(1.0::DOUBLE / n.n, 0) AS mark FROM c LEFT JOIN n ON n.item_id = c.item_id AND n.gram = c.gram),
 w AS (SELECT m.item_id, i, round(sum(mark) OVER (PARTITION BY m.item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING), 9) AS score, length(s) AS len FROM m JOIN g USING (item_id)),
 b AS (SELECT item_id, min(i) AS start FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM w WHERE i <= len - 59) WHERE score = best GROUP BY item_id)
 SELECT item_id, CAST(coalesce(start, 1) AS INTEGER) AS start, substr(s, coalesce(start, 1), 60) AS snippet FROM g LEFT JOIN b USING (item_id)""")
def q_snippet_window(spark, sf_dir):
    return rewrite.best_windows(_questions(spark, sf_dir).withColumn("question", F.lit("the and")), "item_id", 60).select("item_id", "start", "snippet")


_PARTS = "SELECT DISTINCT p_name AS text FROM part"


@BOOK.query(rf"""WITH q AS ({_PARTS}), n AS (SELECT row_number() OVER (ORDER BY name) AS pos, name FROM (SELECT DISTINCT reverse(p_name) || p_type AS name FROM part)),
 s AS (SELECT text, i, len, substr(text, i, len) AS sub FROM (SELECT text, i, unnest(range(1, length(text) - i + 2)) AS len FROM (SELECT text, unnest(range(1, length(text) + 1)) AS i FROM q))),
 m AS (SELECT s.text, pos, first(sub ORDER BY len DESC, i) AS hint FROM s JOIN n ON contains(name, sub) GROUP BY s.text, pos)
 SELECT text, hint, min(pos) AS pos FROM m WHERE length(hint) >= 2 AND hint NOT IN ('re', 'l ') GROUP BY text, hint""")
def q_law_hint_lcs(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.concat(F.reverse("p_name"), "p_type").alias("name")).distinct()
    names = names.withColumn("pos", F.row_number().over(W.orderBy("name")).cast("long"))  # a list of names, short by nature
    asked = parts.select(F.col("p_name").alias("text")).distinct().withColumn("k", F.col("text"))
    return rewrite.name_hints(asked, names, "k", stop=["re", "l "]).withColumnRenamed("k", "text")


@BOOK.query(r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS name FROM benchmark),
 h AS (SELECT doc_id, name, strpos(text, name) AS low FROM documents JOIN n ON contains(text, name))
 SELECT doc_id, count(*) AS names, CAST(sum(low) AS BIGINT) AS places, first(name ORDER BY length(name) DESC, name) AS longest FROM h GROUP BY doc_id""")
def q_names_in_texts(spark, sf_dir):
    """Of all longer words of the benchmark, those that occur anywhere in each document, by one pass of an automaton."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))).alias("name"))
    first = occurrences(table(spark, sf_dir, "documents"), words, "doc_id").groupBy("doc_id", "name").agg(F.min("low").alias("low"))
    longest = F.min(F.struct((-F.length("name")).alias("n"), "name"))["name"]
    return first.groupBy("doc_id").agg(F.count("*").alias("names"), F.sum("low").alias("places"), longest.alias("longest"))
