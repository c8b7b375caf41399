import itertools

from lexloom.llm import url_rules
from lexloom.llm.queries import URL_RULES


def plain(url):
    """Host, path, rule and given verdict, straight from the words of the contract."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
    best = None
    for line in URL_RULES:
        verdict, place = line.split(" ")
        h, p = place.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(place) > len(best[0])):
            best = place, verdict
    return host, path, *(best or (None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/12?x=1", "http://example.org", "http://example.org/", "http://myexample.org/es/1", "ftp://x.example.org/en/12#a", "http://x.example.org/en/2", "http://b.com/de/1", "http://com/de/", "http://b.COM/fr/", "http://b.com?u=http://c.org/", "http://É.org/a\nb", "a://b://c.org/x", "http://d.net/de/7", "http://d.net/fr/7"]


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_rules.judge(pages, URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict or rule is None
        assert got[i].verdict in ("allow", "block")
    assert url_rules.judge(pages.where("false"), URL_RULES).count() == 0
    assert [r.verdict for r in url_rules.judge(pages.where("page_id < 3"), URL_RULES).collect()] == ["allow"] * 3


def brute_mine(rows, support, confidence):
    found = {}
    items = sorted({t for ts, _ in rows for t in ts})
    for n in range(1, 4):
        for combo in itertools.combinations(items, n):
            have = [v for ts, v in rows if set(combo) <= set(ts)]
            for verdict in ("allow", "block"):
                k = have.count(verdict)
                if have and k / len(rows) >= support and k / len(have) >= confidence:
                    found[combo, verdict] = (k / len(have), k / len(rows))
    return found


def brute_pruned(rows, support, confidence):
    every = brute_mine(rows, support, confidence)
    part = lambda c, v: [every[q, v][0] for q in itertools.combinations(c, len(c) - 1) if (q, v) in every]
    return {(c, v): x for (c, v), x in every.items() if not any(p >= x[0] for p in part(c, v))}


def test_mining_against_brute_force(spark):
    rows = [(["a", "b"], "block")] * 6 + [(["a", "c", "e", "f"], "allow")] * 5 + [(["b"], "allow")] * 2 + [(["c", "d", "e", "f"], "allow")] * 3 + [(["d"], "block")] * 3
    table = spark.createDataFrame([(t, v) for t, v in rows], "tokens array<string>, given string")
    rules, items = url_rules.mine(table, 0.1, 0.7, least=1)
    assert items == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "c", "f": "c"}
    mined = {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in rules.collect()}
    want = brute_pruned(rows, 0.1, 0.7)
    as_items = {(tuple(sorted({items[t] for t in c})), v): (round(x[0], 9), round(x[1], 9)) for (c, v), x in want.items()}
    assert mined == as_items
    for have in (["a", "b"], ["a", "c", "d"], ["a", "e"], ["f"], ["b"], ["zz"], ["zz", "d"]):
        fits = sorted((-x[0], -x[1], -len(c), c, v) for (c, v), x in mined.items() if set(c) <= {items.get(t) for t in have})
        sets = spark.createDataFrame([(sorted({items[t] for t in have if t in items}),)], "items array<string>")
        got = [(r.by, r.mined) for r in url_rules.matched(sets, rules).collect()]
        assert got == ([(fits[0][4], " & ".join(fits[0][3]))] if fits else [])


def test_mined_rules_judge_the_rest(spark):
    urls = [f"http://h{i % 7}.com/de/{i}" for i in range(60)] + [f"http://h{i % 7}.com/fr/{i}" for i in range(60)] + ["http://x.net/de/3", "http://x.net/fr/3"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(pages, URL_RULES, default="allow").collect()}
    assert got[120].verdict == "block" and got[120].rule is None and got[120].mined
    assert got[121].verdict == "allow"
