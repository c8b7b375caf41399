"""BM25 over shards and blocks against plain sums over all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.operators import postings, search

WORD = re.compile(r"[a-z0-9]+")


def plainly(docs, queries, limit, k1=1.2, b=0.75, keep=lambda key, law, laws: True):
    counts = {key: (Counter(WORD.findall((t or "").lower())), law) for key, t, law in docs}
    n, average = len(docs), max(sum(sum(c.values()) for c, _ in counts.values()) / max(1, len(docs)), 1e-9)
    df = Counter(t for c, _ in counts.values() for t in c)
    out = []
    for q, text, laws in queries:
        scores = []
        for key, (c, law) in counts.items():
            if not keep(key, law, laws):
                continue
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sum(c.values()) / average)) for t, m in Counter(WORD.findall((text or "").lower())).items() if t in c)
            if s > 0:
                scores.append((-round(s, 9), key))
        out += [(q, key, round(-s, 6), i) for i, (s, key) in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out)


def corpus(n=900):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    docs = [(f"d{i:04}", " ".join(draw.choices(words, weight, k=draw.randrange(0, 90))), f"law{i % 3}") for i in range(n)]
    docs += [("null", None, None), ("empty", "", "law1"), ("long", "w0 w1 w7 " * 5000, "law2")] + [(f"tie{i}", "w250 w251", "law0") for i in range(40)]
    queries = [(i, " ".join(draw.choices(words, weight, k=draw.randrange(1, 30))), None) for i in range(25)]
    return docs, queries + [(90, None, None), (91, "nothing known", None), (92, "W250 w250 w251", None), (93, "w0", ["law2"]), (94, "w0 w250", ["law0", "law1"]), (95, "w0", ["none"])]


@pytest.mark.parametrize("tokens,rows", [(2_000_000, 65_536), (3000, 100), (1, 7)])
def test_against_plain_sums(spark, tokens, rows):
    docs, queries = corpus(900 if rows > 7 else 150)
    frame = spark.createDataFrame(docs, "key string, text string, law string")
    asked = spark.createDataFrame(queries, "query_id int, text string, laws array<string>")
    index = postings.index_of(postings.shards(frame, "key", law="law", shard_tokens=tokens, shard_documents=rows).persist())
    assert index.documents == len(docs)
    fits = lambda key, law, laws: laws is None or law in laws
    for limit in (1, 6):
        got = sorted(map(tuple, search.top_bm25(index, asked, limit, key="key").collect()))
        assert got == plainly(docs, queries, limit, keep=fits)
    got = sorted(map(tuple, search.top_bm25(index, asked, 5, key="key", k1=2.0, b=0.3).collect()))
    assert got == plainly(docs, queries, 5, 2.0, 0.3, fits)
    some = frame.where("key like '%1' or key like 'tie%'")
    got = sorted(map(tuple, search.top_bm25(index, asked, 5, key="key", allowed=some.select("key")).collect()))
    assert got == plainly(docs, queries, 5, keep=lambda key, law, laws: fits(key, law, laws) and (key.endswith("1") or key.startswith("tie")))


def test_blocks_out_of_reach_are_left_unread(spark):
    draw = random.Random(4)
    rare = [f"r{i}" for i in range(4000)]
    docs = [(i, " ".join(["the", "of", "and"] * draw.randrange(1, 9) + draw.choices(rare, k=25))) for i in range(3000)]
    index = postings.index_of(postings.shards(spark.createDataFrame(docs, "key long, text string"), "key").persist())
    asked = spark.createDataFrame([(i, docs[i][1]) for i in range(0, 3000, 300)], "query_id int, text string")
    found = postings.searched(index, asked, 3, "query_id").where("key is null").agg(F.sum("read").alias("read"), F.sum("of").alias("of")).first()
    assert 0 < found.read < found.of / 2
    assert [r.doc_id for r in search.top_bm25(index, asked, 1).orderBy("query_id").collect()] == list(range(0, 3000, 300))


def test_bounds_hold_when_the_corpus_is_longer_than_a_shard(spark):
    short = postings.shards(spark.createDataFrame([(i, f"a b{i}") for i in range(50)], "key long, text string"), "key", generation=1)
    long = postings.shards(spark.createDataFrame([(100 + i, "c " * 900 + "a") for i in range(50)], "key long, text string"), "key", generation=2)
    index = postings.index_of(short.unionByName(long).persist())
    docs = [(i, f"a b{i}", None) for i in range(50)] + [(100 + i, "c " * 900 + "a", None) for i in range(50)]
    asked = [(1, "a", None), (2, "a c b7", None)]
    got = search.top_bm25(index, spark.createDataFrame([q[:2] for q in asked], "query_id int, text string"), 4, key="key")
    assert sorted(map(tuple, got.collect())) == plainly(docs, asked, 4)


def test_nothing_to_search(spark):
    none = postings.index_of(postings.shards(spark.createDataFrame([], "key long, text string"), "key"))
    asked = spark.createDataFrame([(1, "a")], "query_id int, text string")
    assert search.top_bm25(none, asked, 3).count() == 0 and none.documents == 0
    some = postings.index_of(postings.shards(spark.createDataFrame([(1, "a")], "key long, text string"), "key"))
    assert search.top_bm25(some, asked.where("false"), 3).count() == 0
