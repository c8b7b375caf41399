"""Ordered reasons to build a corpus anew."""

from lexloom.operators import ingest

FACTS = "laws long, unparsed long, files long, first_odd string, articles long, parents long, chunks long, snapshot_rows long, collection_rows long, want_dense boolean, vector_enabled boolean, model string, want_model string, embed_failed boolean"


def test_rules_in_order(spark):
    good = dict(laws=2, unparsed=0, files=2, first_odd=None, articles=9, parents=9, chunks=20, snapshot_rows=20, collection_rows=20, want_dense=True, vector_enabled=True, model="m", want_model="m", embed_failed=False)
    wrong = [
        ({"laws": 0}, "no structure"), ({"unparsed": 1}, "parse missing"), ({"files": 3}, "file count"), ({"first_odd": "new"}, "new file"), ({"first_odd": "changed"}, "file changed"), ({"chunks": None}, "no chunks"),
        ({"parents": 8}, "parents differ"), ({"snapshot_rows": None}, "no snapshot"), ({"collection_rows": None}, "no collection"), ({"collection_rows": 19}, "rows differ"), ({"model": None}, "other model"), ({"vector_enabled": False}, "no vectors"),
    ]
    cases = [good | w for w, _ in wrong]
    worse = dict(good)
    for w, _ in reversed(wrong[:-1]):  # the last needs an index without vectors, which has no model to compare
        worse = worse | w
        cases.append(dict(worse))
    fine = [good, good | {"want_dense": None, "model": "other"}, good | {"vector_enabled": None, "embed_failed": True}, good | {"want_dense": False, "vector_enabled": False}]
    order = FACTS.replace(",", "").split()[::2]
    rows = spark.createDataFrame([tuple(c[k] for k in order) for c in cases + fine], FACTS).coalesce(1)
    assert [r.reason for r in ingest.staleness(rows).collect()] == [x for _, x in wrong] + [x for _, x in reversed(wrong[:-1])] + [None] * 4


def test_facts_of_files(spark):
    manifest = spark.createDataFrame([("a", "f1", 1, "x", 3), ("a", "f2", 2, "y", 4), ("b", "f1", 3, None, None)], "c string, file string, law_id int, sha1 string, articles int")
    parsed = spark.createDataFrame([("a", 1), ("a", 1), ("b", 3), ("z", 9)], "c string, law_id int")
    files = spark.createDataFrame([("a", "f0", "n"), ("a", "f2", "z"), ("b", "f1", None), ("d", "f1", "q")], "c string, file string, sha1 string")
    got = {r.c: (r.laws, r.unparsed, r.articles, r.files, r.first_odd) for r in ingest.build_facts(manifest, parsed, files, ["c"]).collect()}
    assert got == {"a": (2, 1, 7, 2, "new"), "b": (1, 0, 0, 1, None), "d": (0, 0, 0, 1, "new")}
