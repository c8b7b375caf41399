import itertools

import numpy as np

import corpus_pipeline
from lexloom.llm import near_copies, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if len(a & b) >= 0.8 * len(a | b):
            root[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return sorted(min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")) for g in groups.values())


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(900)]
    rows = []
    for _ in range(25):  # chains of edits, whose similarities lie on both sides of 0.8
        base = rng.choice(vocabulary, rng.integers(60, 300))
        for edits in (0, 1, 2, 3, 4, 6, 8):
            near = base.copy()
            near[rng.integers(0, len(base), edits)] = rng.choice(vocabulary, edits)
            rows.append((len(rows), " ".join(near)))
            if edits == 3:
                base = near
    return rows + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a c")]


def test_stage_against_brute_force_jaccard(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert [r.doc_id for r in got.orderBy("doc_id").collect()] == [i for i, _ in brute(rows)]
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(9)
    found = 0
    for _ in range(300):
        shared, own = rng.integers(0, 2**63, 80).astype(np.uint64), rng.integers(0, 2**63, (2, 10)).astype(np.uint64)
        a, b = (near_copies.smallest(np.r_[shared, x]) for x in own)
        assert abs((a == b).mean() - 0.8) < 0.2
        found += (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert found == 300


def test_candidates_come_from_fingerprints_too(spark):
    """The stage's documents have the fingerprints of op9's operator (of five words), and those within three bits meet."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r.fp for r in simhash.fingerprints(docs, "text", 5).collect()}
    signed = near_copies.signed(docs).collect()
    assert {r.doc_id: r.fp for r in signed} == prints
    nodes = {r.node: r.fp for r in signed if r["keys"]}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    met = near_copies.by_fingerprint(spark.createDataFrame(list(nodes.items()), "node long, fp long")).collect()
    for r in met:
        assert r.a > r.b and (nodes[r.a] % 2**64 ^ nodes[r.b] % 2**64).bit_count() <= 3
        root[find(r.a)] = find(r.b)
    close = [(a, b) for a, b in itertools.combinations(nodes, 2) if (nodes[a] % 2**64 ^ nodes[b] % 2**64).bit_count() <= 3]
    assert close and all(find(a) == find(b) for a, b in close)
