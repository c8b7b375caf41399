import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from lexloom.llm import langid

SYLLABLES = {"de": "sch ung ich keit ver ein ü ß", "en": "th ing ed wh er the ly", "fr": "eau eux ou é è ment que", "es": "ción ar ñ los do mente ue", "xx": "zq vk bz kz"}


def sentence(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split(), rng.integers(1, 4))) for _ in range(n))


def test_held_out(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        lang = list(SYLLABLES)[i % 5]
        rows.append((i, sentence(lang, int(rng.integers(5, 60)), rng), lang, "old"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, langid.fold() != 2)
    assert set(model.families) == {"germanic", "romance", "only xx"} and len(model.pairs) == 2
    got = langid.predict(docs.drop("lang").withColumn("held", langid.fold() == 2), model).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held]
    assert np.mean([r.lang_pred == list(SYLLABLES)[r.doc_id % 5] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "123 !?"), (None, "the thing whed " * 9000), (3, "漢字"), (3, "漢字"), (4, "a")], "doc_id long, text string")
    named = [(str(r.doc_id), r.lang_pred) for r in langid.predict(odd, model).collect()]
    assert [x for x in named if x[1] == "und"] == [("1", "und"), ("1", "und"), ("2", "und")] and ("None", "en") in named
    assert langid.predict(odd.where("false"), model).count() == 0


def test_copies_neither_crowd_out_nor_flood_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, sentence("en", 20, rng), "en") for i in range(60)] + [(1000 + i, sentence("xx", 20, rng), "xx") for i in range(60)]
    for draw in range(2):  # copies of a text, whatever its hash
        copy = sentence("xx", 20, rng)
        seen = []
        monkeypatch.setattr(langid, "fit_machines", lambda x, signs, real=langid.fit_machines: seen.append(len(x)) or real(x, signs))
        docs = spark.createDataFrame(rows + [(5000 + i, copy, "xx") for i in range(4000)], "doc_id long, text string, lang string")
        model = langid.fit(docs, F.lit(True), per_language=100)
        monkeypatch.undo()
        assert seen == [121] and model.languages == ["en", "xx"]
        got = langid.predict(docs.where("doc_id < 2000"), model).collect()
        assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_closest_rival_does_not_sink_with_languages():
    for languages in (["de", "en"], ["da", "de", "en", "nl", "sv", "no"]):
        model = langid.Hierarchy(languages)
        lean = np.log(0.65 / 0.35) / 2  # each machine of "de" is 65 % sure
        margins = np.array([[1.0, *(lean if languages[i] == "de" else -lean if languages[j] == "de" else 0.0 for i, j in model.pairs)]])
        lang, score, closest = model.decide(margins)
        assert languages[lang[0]] == "de" and abs(closest[0] - 0.65) < 1e-9
        assert abs(score[0] - 0.65 ** (len(languages) - 1)) < 1e-9


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert [r.lang_pred for r in langid.predict(docs, model).collect()] == ["und", "und"]


def test_trigrams_stay_in_their_texts():
    texts = ["", "ab", "abc", "The  thing--is!", "x" * 50, "é"]
    body = "".join(texts).encode()
    ends = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    together, at = langid.trigrams(np.frombuffer(body, np.uint8), ends)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        alone, _ = langid.trigrams(raw, np.array([0, len(raw)]))
        assert together[at[i] : at[i + 1]].tolist() == alone.tolist(), t


def plain_buckets(text):
    """Hashed trigrams of a text, written down anew: bytes folded, runs of spaces one, three at a time."""
    body, mask = [], 0xFFFFFFFF
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if b != 32 or not body or body[-1] != 32:
            body.append(b)
    out = []
    for x, y, z in zip(body, body[1:], body[2:]):
        code = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) * 0x27D4EB2F & mask
        out.append(((code ^ code >> 15) * 0x2C1B3C6D & mask) >> 19)
    return out


def test_predictions_are_those_of_the_fitted_machines(spark):
    rng = np.random.default_rng(8)
    langs = list(SYLLABLES)
    docs = [(i, sentence(langs[i % 5], int(rng.integers(3, 40)), rng), langs[i % 5]) for i in range(300)]
    docs += [(900, "The  thing!! whed\n\n" * 3000, "en"), (901, "漢", "xx"), (902, "é", "fr"), (903, "a b", "en")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(table, langid.fold() != 2)
    weights, bias = model.weights.tolist(), model.bias.tolist()
    family = {"de": "germanic", "en": "germanic", "fr": "romance", "es": "romance", "xx": "only xx"}
    families = sorted(set(family.values()))
    pairs = [(a, b) for i, a in enumerate(model.languages) for b in model.languages[i + 1 :] if family[a] == family[b]]
    sure = lambda m: 1 / (1 + math.exp(-2 * max(-30, min(30, m))))
    for r in langid.predict(table, model).collect():
        found = plain_buckets(r.text)
        m = [b + (sum(weights[k][j] for k in found) / len(found) if found else 0) for j, b in enumerate(bias)]
        best = max(range(len(families)), key=lambda f: m[f])
        inside = [x for x in model.languages if family[x] == families[best]]
        score, lang = sure(m[best]), inside[0]
        for j, (a, b) in enumerate(pairs, len(families)):  # two languages in a family here: one machine decides
            if a in inside:
                lang = a if m[j] >= 0 else b
                score *= max(sure(m[j]), 1 - sure(m[j]))
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9, r.doc_id


def test_texts_go_to_the_workers_once(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    df = langid.predict(docs, langid.Hierarchy([]))
    assert df.columns == ["doc_id", "text", "lang_pred", "score"] and {r.lang_pred for r in df.collect()} == {"und"}
    assert df._jdf.queryExecution().analyzed().children().head().output().size() == 2
