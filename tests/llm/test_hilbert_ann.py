import itertools

import numpy as np

from lexloom.llm import hilbert_ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    m = np.array([v for _, v in good])
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            s = hilbert_ann.cosines(np.broadcast_to(v, m.shape), m)
            order = sorted((b for b in range(len(good)) if b != a), key=lambda b: (-s[b], good[b][0]))
            out.setdefault(i, []).append([(good[b][0], s[b]) for b in order[:k]])
    return out


def test_curve_is_a_hilbert_curve():
    for n, bits in ((2, 4), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        at = hilbert_ann.hilbert_index(points, bits)
        assert sorted(at.tolist()) == list(range(len(points)))
        path = points[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    m = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(5000 + i, rows[0][1]) for i in range(300)]  # one very common vector
    rows += [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [None] * 16), (9200, [1.0]), (None, rows[1][1]), (50, rows[2][1])]
    got = {}
    for r in hilbert_ann.neighbours(table(spark, rows), every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 5, 50)
    assert set(got) == set(want)
    hits = total = 0
    for q, lists in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == sorted(list(range(1, 6)) * len(lists))
        for one in lists:
            total += 5
            hits += len({i for i, _ in one} & {x[1] for x in mine})
    assert hits / total > 0.9
    for rank, vec_id, score in got[0]:
        assert vec_id == 4999 + rank and abs(score - 1) < 1e-12


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [0.0, -1.0])]
    got = [(r.query_id, r["rank"], r.vec_id) for r in hilbert_ann.neighbours(table(spark, rows)).collect()]
    assert sorted(got) == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert hilbert_ann.neighbours(table(spark, [])).count() == 0
    assert hilbert_ann.neighbours(table(spark, [(50, [2.0, 1.0])])).count() == 0


def test_reads_less_than_brute_force():
    """On the whole table of random and of grouped vectors, rows read for a query by all curves, at a measured recall."""
    rng = np.random.default_rng(2)
    grouped = rng.normal(size=(60, 64))[rng.integers(0, 60, 60_000)] + 0.3 * rng.normal(size=(60_000, 64))
    for m, most in ((rng.normal(size=(60_000, 64)), 1.0), (grouped, 0.2)):
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        keys = hilbert_ann.Curves(16, 64, 11).keys(m)
        cells = len(m) // 32
        cell = np.stack([np.searchsorted(np.sort(k)[np.arange(1, cells) * 32], k, "right") for k in keys.T], axis=1)
        q = np.arange(0, len(m), 300)
        s = m[q] @ m.T
        s[np.arange(len(q)), q] = -9
        near = np.argsort(-s, axis=1)[:, :5]
        used, reach = hilbert_ann.pick_reach(np.abs(cell[q][:, None] - cell[near]).reshape(-1, 16), cells, 0.93)
        low, high = np.maximum(cell[q, :used] - reach, 0), np.minimum(cell[q, :used] + reach, cells - 1)
        assert ((high - low + 1).sum(axis=1) / cells).mean() < most
