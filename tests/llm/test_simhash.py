import re

import numpy as np
import pytest
import xxhash

from lexloom.llm import simhash
from lexloom.llm.common import components


def brute_fp(text, shingle):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdéß"), 4)) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 80))) for _ in range(120)]
    base = rng.choice(vocabulary, 400)
    for _ in range(120):
        near = base.copy()
        near[rng.integers(0, 400, 2)] = rng.choice(vocabulary, 2)
        texts.append(" ".join(near))
    return texts + [texts[0], texts[0].upper(), None, "", " \t\n", "one", "one two", "x " * 5000, "a　b c"]


@pytest.mark.parametrize("seed,most", [(1, 16_384), (2, 8), (3, 4)])
def test_against_brute_force(spark, seed, most):
    texts = corpus(seed)
    docs = spark.createDataFrame([(1000 - i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, shingle=3, in_task=most).collect()}
    fps = [brute_fp(t, 3) for t in texts]
    want = brute_components(fps, [1000 - i for i in range(len(texts))])
    for i in range(len(texts)):
        assert got[1000 - i] == (fps[i], want[i]), i


def test_every_plan_is_whole():
    rng = np.random.default_rng(5)
    sample = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    for rows in (10, 10_000, 10_000_000, 10**11):
        parts = simhash.plan(sample, rows)
        assert sum(t + 1 for _, t in parts) == 4
        bits = [b for part, _ in parts for b in part]
        assert len(bits) == len(set(bits))
        for _ in range(200):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.integers(0, 64, 3):
                y ^= 1 << int(b)
            assert any(bin((x ^ y) & sum(1 << b for b in part)).count("1") <= t for part, t in parts)


def test_forest_connects():
    rng = np.random.default_rng(6)
    fps = np.unique((np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))))
    edges = simhash.forest(fps, 3)
    assert all(bin(int(a) ^ int(b)).count("1") <= 3 for a, b in edges)
    want = brute_components([int(x) for x in fps], list(range(len(fps))))
    assert len(edges) == len(fps) - len(set(want))


def test_a_large_bucket_is_cut_and_loses_no_link(spark):
    rng = np.random.default_rng(9)
    flips = (np.uint64(1) << rng.integers(0, 40, (600, 4)).astype(np.uint64)) * (rng.random((600, 4)) < 0.6)
    fps = np.unique(np.bitwise_xor.reduce(flips, axis=1) ^ np.uint64(0xDEADBEEF << 24))
    ids = list(range(len(fps)))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = brute_components([int(x) for x in fps], ids)
    for tau, in_task in ((3, 5), (3, 100), (3, 16_384)):
        root = {int(r.id) & (2**64 - 1): r.root for r in components(simhash.links(nodes, tau, in_task)).collect()}
        got = [root.get(int(x), int(x.view(np.int64))) for x in fps]
        assert len({*zip(got, want)}) == len({*got}) == len({*want})


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[201] == 200


def test_one_of_each(spark):
    docs = spark.createDataFrame([(3, "same words here", 1), (2, "same words here", 2), (2, "same words here", 2), (9, None, 1), (8, "", 1), (None, "alone in here again", 1)], "doc_id long, text string, n int")
    got = sorted((str(r.doc_id), r.text) for r in simhash.one_of_each(docs).collect())
    assert got == [("2", "same words here"), ("8", ""), ("None", "alone in here again")]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_one_of_each_without_or_with_shared_ids(spark):
    rows = [(None, "first of the texts without id"), (None, "second one and something else entirely"), (None, "second one and something else entirely"), (3, "near copy of number three here"), (5, "near copy of number three here"), (5, "a clean document of its own"), (7, "one text of the seventh"), (7, "quite another thing under seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in simhash.one_of_each(docs).collect()))
    assert got == sorted((i or 0, t) for i, t in {*rows} - {(5, "near copy of number three here")})
