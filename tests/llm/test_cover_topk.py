import numpy as np

from lexloom.llm import cover_topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every, scale=64):
    good = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 12 and None not in v and all(np.isfinite(v))]
    out = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(good) if b != a)
            out += [(i, r, None if none else j, -s if -(2**63) <= -s < 2**63 else None) for r, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in cover_topk.top_k(table, **kw).collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 12))
    m = centres[rng.integers(0, 12, 900)] * rng.uniform(0.2, 1, (900, 1)) + 0.2 * rng.normal(size=(900, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(3000 + i, rows[3][1]) for i in range(200)]
    rows += [(9000, None), (9020, [0.0] * 12), (9040, [float("inf")] + [0.0] * 11), (9060, [None] * 12), (9080, [1.0]), (None, rows[1][1]), (40, rows[2][1])]
    want = brute(rows, 20, 20)
    assert run(spark, rows) == want
    assert run(spark, rows, pivots=5, sample=64, block=7, chunk=50) == want


def test_small_and_large_numbers(spark):
    rows = [(0, [1.0] * 12), (20, [-1.0] * 12), (5, [0.5] * 12)]
    assert run(spark, rows) == brute(rows, 20, 20)
    big = [(i, [float((i * 7919 + j * 104729) % 1000 - 500) * 1e4 for j in range(12)]) for i in range(60)]
    assert run(spark, big) == brute(big, 20, 20)
    huge = big + [(60, [1e30] * 12), (61, [-1e30] * 6 + [3e8] * 6), (80, [1e9] * 12), (None, [2e30] * 12), (100, [3e8] + [0.0] * 11)]
    assert run(spark, huge) == brute(huge, 20, 20) == run(spark, huge, pivots=3, block=2, chunk=7)
    assert run(spark, []) == [] and run(spark, [(20, [2.0, 1.0])]) == [] and run(spark, [(1, [2.0]), (3, [2.0])]) == []


def test_cover_tree_covers_and_search_prunes():
    rng = np.random.default_rng(2)
    centres = 40 * rng.normal(size=(20, 6))
    m = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 6)))
    tree = cover_topk.cover_tree(m)
    stack, leaves = [tree], []
    while stack:
        node = stack.pop()
        assert np.sqrt(((m[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        leaves += [] if node.children else node.rows.tolist()
        stack += node.children
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
    assert sorted(leaves) == list(range(4000))
    search = cover_topk.DualSearch(m[:200], np.arange(200), np.full(200, -np.inf), 10, 1e6)
    search.pass_by(m, np.arange(4000), np.arange(4000))
    assert search.compared < 0.5 * 200 * 4000
