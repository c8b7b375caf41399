"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, cover_topk, fim, hilbert_ann, langid, mixing, quality, resample, sharding, simhash, suffix_dedup, toxicity, url_rules
from lexloom.llm.common import table

#: The vocabulary that op4 and the pipeline name; a parameter of the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.neighbours(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, keep_text=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


#: The given rules of op6.
URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.fold() != 2)
    held_out = F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", held_out, "text"), model).drop("text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("text", "lang", "source", "n_chars")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op10_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16, fine=256)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm=80)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark").select("text"), share=10, least=20, longest=1, buckets=10_000, seed=2024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_suffix_dedup": op1_suffix_dedup, "op2_hilbert_ann": op2_hilbert_ann, "op3_mixing": op3_mixing, "op4_bpe": op4_bpe, "op5_toxicity": op5_toxicity, "op6_url_rules": op6_url_rules, "op7_langid": op7_langid, "op8_quality": op8_quality, "op9_simhash": op9_simhash, "op10_cover_topk": op10_cover_topk, "op11_sharding": op11_sharding, "op12_fim": op12_fim, "op13_resample": op13_resample}
ORACLES: dict[str, str] = {
    "op10_cover_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_fim": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST(len(u) AS BIGINT) AS n,
                     list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT)) AS x FROM d),
        c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain'
                          WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op13_resample": r"""
        WITH texts AS (SELECT doc_id, row_number() OVER () AS nr, text, true AS mine FROM documents UNION ALL SELECT item_id, row_number() OVER (), text, false FROM benchmark),
        f AS (SELECT nr, mine, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
        h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM f)),
        -- CRC-32, bit by bit: each byte is added and followed by eight steps (-1).
        c AS (SELECT w, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(0, len(x) // 2), lambda i: [CAST('0x' || substr(x, 1 + 2 * i, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                     lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 10000 AS bucket FROM h),
        n AS (SELECT bucket, count(*) FILTER (mine) AS s, count(*) FILTER (NOT mine) AS t FROM f JOIN c USING (w) GROUP BY bucket),
        g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
        m AS (SELECT nr, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN c USING (w) JOIN g USING (bucket) WHERE mine GROUP BY nr),
        d AS (SELECT b.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(b.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
              FROM texts b LEFT JOIN m USING (nr) WHERE b.mine),
        r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS rank FROM d)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM d WHERE n_features >= 20) // 100 THEN rank END AS rank FROM r""",
}
