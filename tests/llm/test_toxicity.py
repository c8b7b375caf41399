import numpy as np

from lexloom.llm import toxicity

CLEAN = "river stone cloud meadow table window garden music paper light".split()
BAD = "vilkrat snargol brukhead".split()


def make(n, seed):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(CLEAN, rng.integers(20, 120)))
        toxic = i % 3 == 0
        if toxic:
            for at in rng.integers(0, len(words), max(2, len(words) // 12)):
                words[at] = str(rng.choice(BAD)) + str(rng.choice(["", "a", "en"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = make(900, 1)
    table = spark.createDataFrame([(*d, "old") for d in docs], "doc_id long, text string, severity string")
    truth = {i: t for i, _, t in labels}
    known = spark.createDataFrame([r for r in labels if r[0] < 450], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known, features=64)
    got = toxicity.score(table, model).collect()
    held = [r for r in got if r.doc_id >= 450]
    assert np.mean([r.toxic == bool(truth[r.doc_id]) for r in held]) > 0.98
    assert all(0 <= r.severity <= 3 for r in got) and (np.diff(model.thresholds) > 0).all()
    again = toxicity.score(table.repartition(3), toxicity.fit(table.repartition(5), known, features=64)).collect()
    assert {r.doc_id: r.toxic for r in again} == {r.doc_id: r.toxic for r in got}
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "vilkrat " * 4000), (2, "\t\n")], "doc_id long, text string")
    scores = sorted((str(r.doc_id), r.toxic) for r in toxicity.score(odd, model).collect())
    assert scores == [("1", False), ("1", False), ("2", False), ("None", True)]
    assert toxicity.score(odd.where("false"), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert [r.severity for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [0, 0]


def test_ordinal_recovers_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    noisy = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=3000)
    grade = np.digitize(noisy, [-1.0, 1.0, 3.0])
    w, theta = toxicity.fit_ordinal(x, grade, l2=1e-5, rounds=800)
    assert np.allclose(w, [2, -1, 0], atol=0.2) and np.allclose(theta, [-1, 1, 3], atol=0.25)


def test_grades_follow_strength_and_come_from_unseen_models():
    rng = np.random.default_rng(5)
    toxic = (np.arange(900) % 2).astype(int)
    strength = rng.uniform(0.5, 3, 900) * toxic
    x = rng.normal(size=(900, 6)) * 0.3
    x[:, 0] += strength
    grade = toxicity.grades_of(x, toxic)
    assert (grade[toxic == 0] == 0).all() and set(grade[toxic == 1].tolist()) == {1, 2, 3}
    means = [strength[grade == g].mean() for g in (1, 2, 3)]
    assert means[0] < means[1] < means[2]


def test_scores_are_those_of_the_fitted_model(spark):
    docs, labels = make(300, 3)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), features=64)
    for r in toxicity.score(table, model).collect():
        counts = {}
        for w in r.text.lower().split():
            counts[w] = counts.get(w, 0) + 1
        n = sum(counts.values())
        eta = 0.0
        for i, f in enumerate(model.names):
            k = sum(c for w, c in counts.items() for g in [w.strip(toxicity._EDGE)] if g and (f == g + " " or (not f.endswith(" ") and 2 <= len(f) <= 6 and len(g) > len(f) and g.startswith(f))))
            if k:
                eta += model.weights[i] + model.weights[len(model.names) + i] * np.log1p(500 * k / n)
        at_least = 1 / (1 + np.exp(-(eta - model.thresholds)))
        assert abs(r.severity - at_least.sum()) < 1e-9 and r.toxic == bool(at_least[0] >= 0.5)


def test_a_repeated_id_is_no_larger_sample(spark, monkeypatch):
    docs, labels = make(200, 3)
    table = spark.createDataFrame(docs + [(4, f"river stone {i}") for i in range(3000)] + [docs[5]] * 2000, "doc_id long, text string")
    seen, whole = [], toxicity.grades_of
    monkeypatch.setattr(toxicity, "grades_of", lambda x, toxic: seen.append(len(x)) or whole(x, toxic))
    toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=100, features=64)
    assert 100 < seen[0] < 320  # about 100 of each class, whatever repeats
