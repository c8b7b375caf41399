import hashlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import suffix_dedup


def brute(texts, length=200):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed, n=40, alphabet="abcdé "):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list(alphabet), rng.integers(1, 9)))
    passages = [" ".join(word() for _ in range(k)) for k in (30, 45, 80, 120)]
    texts = []
    for i in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            parts.append(" ".join(word() for _ in range(rng.integers(1, 120))))
            p = passages[rng.integers(0, 4)]
            cut = rng.integers(0, len(p) // 3)
            parts.append(p[cut:] if rng.random() < 0.7 else p[: len(p) - cut])
        texts.append(" ".join(parts))
    for i in range(6):  # near copies
        t = list(texts[i % 3])
        for j in rng.integers(0, len(t), 3):
            t[j] = "Z"
        texts.append("".join(t))
    return texts + [texts[0], texts[0][:199], texts[0][:200], texts[1][7:], "", "x" * 199, "y" * 201, "q" * 700, "ab" * 400, None]


@pytest.mark.parametrize("seed,most", [(1, 20_000), (2, 20_000), (3, 2), (4, 2)])
def test_against_brute_force(spark, seed, most):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_spans int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, in_task=most).collect()}
    want = brute([(t or "").encode() for t in texts])
    for i in range(len(texts)):
        assert got[i] == want[i], i


def test_repeated_rows_null_ids_and_empty(spark):
    t = "A passage of some length, no part of which comes again. " * 1 + "".join(chr(97 + i * i % 26) for i in range(300))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t[:250]), (None, None), (2, "other")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.digests(docs).collect())
    n = len(t)
    assert got == sorted([("1", n, n), ("1", n, n), ("None", 250, 250), ("None", 0, 0), ("2", 5, 0)])
    assert suffix_dedup.digests(docs.where("false")).count() == 0
    cut = suffix_dedup.remove(docs)
    assert cut.columns == ["doc_id", "text"] and sorted(r.text for r in cut.collect()) == ["", "", "", "", "other"]


def test_nul_bytes_at_the_ends(spark):
    rng = np.random.default_rng(6)
    p = "".join(rng.choice(list("abcdef"), 196))
    texts = [p + "\0" * n + s for n, s in ((4, ""), (4, "xyz"), (5, ""), (9, "k"), (60, ""), (61, "a"), (2, ""))] + ["\0" * n + p + "q" * n for n in (1, 3, 30, 199, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])


def test_one_gram_with_many_surroundings(spark):
    rng = np.random.default_rng(7)
    other = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    line = other(60)
    left, right = [other(150) for _ in range(3)], [other(150) for _ in range(3)]
    texts = [other(rng.integers(0, 90)) + left[i % 3][-int(rng.integers(1, 150)) :] + line + right[i // 3 % 3][: rng.integers(1, 150)] + other(rng.integers(0, 90)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute([t.encode() for t in texts])
    assert sum(w[1] > 0 for w in want) > 20
    for in_task in (3, 20_000):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, in_task=in_task).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_stretches_pick_the_same():
    rng = np.random.default_rng(8)
    raw = rng.integers(97, 100, 9000).astype(np.uint8)
    raw[3000:3900] = 97  # ties, and windows that pick one suffix across a border
    whole = suffix_dedup.pick_suffixes(raw, np.array([0, len(raw)]))
    for stretch in (150, 977, 4000):
        parts = suffix_dedup.pick_suffixes(raw, np.array([0, len(raw)]), stretch=stretch)
        assert all((a == b).all() for a, b in zip(whole, parts))


def test_multikey_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order, shared = suffix_dedup.multikey_order(rows)
    listed = rows[order].tolist()
    assert listed == sorted(rows.tolist())
    for a, b, k in zip(listed, listed[1:], shared[1:]):
        assert a[:k] == b[:k] and (k == 5 or a[k] != b[k])
