import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import resample
from lexloom.llm.common import flat

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest=1):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plainly(rows, targets, longest=1, buckets=10_000, share=10, least=20):
    seen, wanted = [0] * buckets, [0] * buckets
    for table, texts in ((seen, [t for _, t in rows]), (wanted, targets)):
        for t in texts:
            for f in plain_features(t, longest)[1]:
                table[zlib.crc32(f) % buckets] += 1
    S, T = sum(seen), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) for s, t in zip(seen, wanted)]
    out = []
    for i, t in rows:
        words, features = plain_features(t, longest)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(eligible[: share * len(eligible) // 100], 1):
        r[5] = rank
    return [(r[0], r[2], r[3], r[4], r[5]) for r in out]


def corpus(n=400):
    draw = random.Random(9)
    words = ["Alpha", "beta", "GAMMA", "délta", "日本語", "x1", "42", "naïve", "ÄÖ", "z" * 80, "a", "b"]
    marks = [" ", ", ", "\n", "-", "\x00", "_", "[", "{"]
    rows = [(i, "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(0, 60)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "?! ..."), (n + 3, "q" * 9000 + " tail " * 40), (3, rows[3][1]), (None, "no id " * 30)]


@pytest.mark.parametrize("longest,stretch", [(1, 1 << 22), (3, 1 << 22), (1, 50), (3, 50), (2, 7)])
def test_features_against_plain_ones(longest, stretch):
    some = [t for _, t in corpus(120)]
    lots = [[t] for t in some] if stretch < 1000 else [some]  # long texts come alone
    for lot in lots:
        raw, ends = flat(pa.array(lot, pa.string()))
        got, words = [[] for _ in lot], np.zeros(len(lot), int)
        for who, found, new in resample.feature_buckets(raw, ends, longest, 10_000, stretch):
            words += new
            for w, b in zip(who, found):
                got[w].append(int(b))
        for i, t in enumerate(lot):
            plain_words, features = plain_features(t, longest)
            assert words[i] == len(plain_words)
            assert sorted(got[i]) == sorted(zlib.crc32(f) % 10_000 for f in features)


@pytest.mark.parametrize("longest", [1, 2])
def test_against_plain_version(spark, longest):
    rows, targets = corpus(), ["alpha beta gamma " * 20, "x1 délta", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as rank", "map('k', 1) as extra", "2 as n_words")
    wanted = spark.createDataFrame([(t,) for t in targets], "text string")
    got = resample.resample(docs, wanted, longest=longest).collect()
    assert {tuple(r.extra.items()) for r in got} == {(("k", 1),)} and "text" not in got[0] and "n_words" not in got[0]
    want = plainly(rows, targets, longest)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(r["rank"] is not None for r in got) > 20


def test_the_draw_does_not_hang_on_partitions(spark):
    docs = spark.createDataFrame([(i % 50, "same words " * 15) for i in range(300)], "doc_id long, text string")
    wanted = spark.createDataFrame([("same",)], "text string")
    results = [sorted((r["rank"] or 0, r.doc_id) for r in resample.resample(docs.repartition(n), wanted, share=20).collect()) for n in (1, 7)]
    assert results[0] == results[1] and sum(r > 0 for r, _ in results[0]) == 60


@pytest.mark.parametrize("bits", [1, 5, 12])
def test_kth_key(spark, bits):
    draw = random.Random(1)
    keys = [(draw.randrange(-4, 4), draw.choice([-(2**63), 2**63 - 1, 0, 5, 6])) for _ in range(200)]
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "a long, b long, c long")
    full = sorted((a, b, i) for i, (a, b) in enumerate(keys))
    for k in (1, 77, 200):
        bound = resample.kth_key(rows, ["a", "b", "c"], k, bits)
        assert sorted(map(tuple, rows.where(resample._upto(["a", "b", "c"], bound)).collect())) == full[:k]
    assert resample.kth_key(rows, ["a"], 0) is None and resample.kth_key(rows, ["a"], 201) is None


def test_ranks_of_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = resample.range_ranked(rows, ["x"], partitions=5).collect()
    assert len(got) == 1000 and all(r["rank"] == r.x + 1 for r in got)
    assert resample.range_ranked(rows.where("false"), ["x"]).count() == 0


def test_drawn_documents_and_empty(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} " * 25, "s") for i in range(100)], "doc_id long, text string, source string")
    wanted = spark.createDataFrame([("word3 " * 9,)], "text string")
    got = resample.drawn_documents(docs, wanted, share=20).collect()
    assert len(got) == 20 and all(r.text == f"word{r.doc_id % 7} " * 25 for r in got)
    assert sum(r.doc_id % 7 == 3 for r in got) >= 10
    assert resample.resample(docs.where("false"), wanted).count() == 0
    assert resample.resample(docs, wanted.where("false")).count() == 100
