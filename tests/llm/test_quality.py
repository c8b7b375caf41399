import math
import zlib

import numpy as np
import pyarrow as pa

from lexloom.llm import quality

WORDS = "river stone cloud meadow table window garden music paper light".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string"


def make(n, seed):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(WORDS, rng.integers(20, 90)).tolist()
        good = i % 4 != 0
        text = " ".join(words) if good else " ".join(w.upper() + "!!" if i % 8 else w + "###" for w in words)
        rows.append((i, text, "en", "good" if good and rng.random() < 0.8 else "bad", len(text), "old"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out(spark):
    rows, labels = make(1200, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(got[i].keep, bool(q)) for i, q, _ in labels if i >= 400]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert all(0 <= r.quality <= 1 and 0 <= r.p_content <= 1 and 0 <= r.p_metadata <= 1 for r in got.values())
    content_only = np.mean([(got[i].p_metadata >= 0.5) == bool(q) for i, q, _ in labels if i >= 400])
    assert content_only > 0.75  # the metadata view learned its weaker signal
    again = quality.score(docs.repartition(3), quality.fit(docs.repartition(5), known)).collect()
    assert all(abs(r.quality - got[r.doc_id].quality) < 1e-6 for r in again)
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (None, "good words here " * 9000, None, "good", -5, "x"), (3, "a\n\nb", "en", "good", 3, "x"), (3, "a\n\nb", "en", "good", 3, "x")], SCHEMA)
    out = quality.score(odd, model).collect()
    assert len(out) == 5 and [r.keep for r in out if r.doc_id == 1] == [False, False]
    assert quality.score(odd.where("false"), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "x"), (2, None, "en", "s", 0, "x")], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert [r.quality for r in quality.score(docs, quality.fit(docs, labels)).collect()] == [1, 0]


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000)
    a, b = (rng.normal(size=(4000, 20)) + np.outer(2 * y - 1, np.r_[0.8, 0.8, np.zeros(18)]) for _ in range(2))
    few = quality.co_train(a[:45], b[:45], y[:45], a[:0], b[:0])
    more = quality.co_train(a[:45], b[:45], y[:45], a[45:2000], b[45:2000])
    right = [np.mean((m.scores(a[2000:], b[2000:])[2] > 0.5) == y[2000:]) for m in (few, more)]
    assert right[1] > right[0] + 0.01


def test_the_pool_holds_no_labelled_document(spark, monkeypatch):
    rows, labels = make(600, 4)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    seen = {}
    whole = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda a, b, y, pa_, pb, rounds: seen.update(pool=pa_, known=a) or whole(a, b, y, pa_, pb, rounds))
    quality.fit(docs, known, pool=10**6)
    assert len(seen["pool"]) == 300 and len(seen["known"]) == 300


def test_scores_are_those_of_the_fitted_model(spark):
    rows, labels = make(200, 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in quality.score(docs, model).collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        shares = np.bincount(quality._CLASS[raw], minlength=quality.CLASSES) / len(raw)
        a = quality.content_view(r.text, shares)
        b = quality.metadata_view(r.source, r.lang, r.n_chars)
        z = [v.slope * (np.clip((x - v.mean) / v.spread, -8, 8) @ v.weights[:-1] + v.weights[-1]) + v.shift for v, x in ((model.content, a), (model.metadata, b))]
        p = 1 / (1 + np.exp(-(model.combine[0] * z[0] + model.combine[1] * z[1] + model.combine[2])))
        assert abs(p - r.quality) < 1e-9 and r.keep == bool(r.quality >= 0.5)


def test_a_repeated_id_is_no_larger_sample(spark, monkeypatch):
    rows, labels = make(300, 6)
    more = [(5, f"river stone {i}", "en", "good", 9, "old") for i in range(2000)] + [(None, f"cloud {i % 900}", "en", "bad", 9, "old") for i in range(1800)]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    seen, whole = {}, quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda a, b, y, pa_, pb, rounds: seen.update(pool=len(pa_), known=len(a)) or whole(a, b, y, pa_, pb, rounds))
    quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=100, pool=100)
    assert 50 < seen["pool"] < 160 and 100 < seen["known"] < 300


def test_features_against_plain_ones(spark):
    """Both views written down anew from their description."""
    texts = ["Some Words, some words.\nA line 12\n\nA line 12", "x", "\n", "é漢😀 !!! ...", "a b a b a b", "UPPER lower 123\t,;", "word " * 900]
    kinds = [str.isupper, str.islower, str.isdigit, lambda c: c in " \t\v\f\r", lambda c: c == "\n", lambda c: c in ".,;:?'\"()-"]
    facts = [("s0", "en", 10), (None, None, None), ("s1", "de", -4), ("s0", None, 0), ("x", "y", 1 << 40), ("é", "fr", 255), ("s", "t", 256)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "source": [f[0] for f in facts], "lang": [f[1] for f in facts], "n_chars": pa.array([f[2] for f in facts], pa.int64())})
    content, metadata = quality._views(batch)
    for i, (t, (source, lang, n)) in enumerate(zip(texts, facts)):
        shares = [0] * 8
        for b in t.encode():
            c = chr(b)
            shares[7 if b >= 128 else next((k for k, f in enumerate(kinds) if f(c)), 6)] += 1
        lines, words = t.split("\n"), t.split()
        pairs = list(zip(words, words[1:]))
        want = [x / len(t.encode()) for x in shares]
        want += [math.log(1 + len(lines)), math.log(1 + sum(map(len, lines)) / len(lines)), math.log(1 + max(map(len, lines))), len(set(lines)) / len(lines)]
        if words:
            k = len(words)
            want += [math.log(1 + k), sum(map(len, words)) / k / 10, len(set(words)) / k, len(set(words)) / math.sqrt(k) / 10, max(map(words.count, words)) / k]
            want += [(len(pairs) - len(set(pairs))) / k, sum(not w[-1].isalnum() for w in words) / k, sum(not any(c.isalnum() for c in w) for w in words) / k]
        else:
            want += [0.0] * 8
        assert np.allclose(content[i], want)
        size = max(0, n or 0)
        plain = np.zeros(32 + 32 + 1 + 24)
        plain[zlib.crc32(f"s{source}".encode()) % 32] = plain[32 + zlib.crc32(f"l{lang}".encode()) % 32] = 1
        plain[64], plain[65 + min(23, len(bin(size)) - 2 if size else 0)] = math.log(1 + size), 1
        assert np.allclose(metadata[i], plain)
