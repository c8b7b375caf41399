"""Longest common parts against a plain comparison of each pair."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.operators import fragments, rewrite


def plain(a, b):
    parts = [(-(j - i), i) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b]
    return a[min(parts)[1] :][: -min(parts)[0]] if parts else ""


def plain_hints(text, names, least):
    first = {}
    for pos, name in sorted(names):
        part = plain(text, name)
        if len(part) >= least:
            first.setdefault(part, pos)
    return first


@settings(max_examples=300, deadline=None)
@given(st.text("ab法", max_size=12), st.text("ab法", max_size=12))
def test_pair(a, b):
    assert fragments.longest_part(a, b) == plain(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=14), st.lists(st.text("abc", min_size=1, max_size=8), max_size=6), st.integers(1, 3))
def test_many_names(text, names, least):
    names = sorted(set(names))
    got = {part: n for part, n in fragments.Automaton(names).shared(text, least)}
    assert got == plain_hints(text, list(enumerate(names)), least)


def test_hints_at_every_shard_size(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    texts = [(i, word(20)) for i in range(30)] + [(30, None), (31, "")]
    names = [(p, word(rng.randint(1, 9))) for p in range(40)] + [(40, None), (41, ""), (3, "abcd"), (90, "abcd")]
    want = {(k, h, p) for k, t in texts if t for h, p in plain_hints(t, [(p, n) for p, n in names if n], 2).items()}
    t, n = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(names, "pos long, name string")
    for size in (fragments.SHARD_CHARS, 60):
        assert {tuple(r) for r in fragments.hints(t, n, "k", shard_chars=size).collect()} == want
    assert fragments.hints(t.limit(0), n, "k").count() == fragments.hints(t, n.limit(0), "k").count() == 0
    some = rewrite.name_hints(t, n, "k", stop=["ab"]).collect()
    assert {tuple(r) for r in some} == {x for x in want if x[1] != "ab"}


def test_a_long_text_is_walked_once(spark):
    t = spark.createDataFrame([("ab" * 200_000 + "xyz",)], "text string").selectExpr("1L as k", "text")
    n = spark.createDataFrame([(1, "qxyzq"), (2, "babab")], "pos int, name string")
    assert sorted(tuple(r) for r in fragments.hints(t, n, "k").collect()) == [(1, "babab", 2), (1, "xyz", 1)]


def test_overlaps(spark):
    cases = spark.createDataFrame([(1, "what holds here"), (2, "none"), (3, None), (4, "zz")], "c int, question string")
    gold = spark.createDataFrame([(1, "it holds"), (1, "what else holds"), (2, None), (3, "x"), (4, "ab")], "c int, text string")
    got = {r.c: (r.overlap, r.part) for r in fragments.overlaps(cases, gold, "c").collect()}
    assert got == {1: (7, "t holds"), 2: (None, None), 3: (None, None), 4: (0, "")}


def ratio(a, b):
    """Ratcliff-Obershelp, written out: the longest part, and what is left and right of it."""

    def matched(a, b):
        part = plain(a, b)
        if not part:
            return 0
        i, j = a.index(part), b.index(part)
        return len(part) + matched(a[:i], b[:j]) + matched(a[i + len(part) :], b[j + len(part) :])

    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_ratio_values(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("", "a"), ("rent a car", "car rental"), ("第一条", "第一百条"), (None, "x"), ("same", "same")]
    t = spark.createDataFrame(pairs, "a string, b string")
    got = t.select(rewrite.ratio(t.a, t.b).alias("r")).collect()
    assert [round(r.r, 9) for r in got] == [round(ratio(a or "", b or ""), 9) for a, b in pairs]
