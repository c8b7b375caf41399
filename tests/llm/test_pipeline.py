import numpy as np
import pytest
from test_langid import sentence
from test_simhash import brute_components, brute_fp
from test_suffix_dedup import brute
from tokenizers import Tokenizer

import corpus_pipeline
from lexloom.llm import common, mixing
from lexloom.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        lang = ["de", "en", "fr", "es"][i % 4]
        rows.append((i, sentence(lang, int(rng.integers(30, 120)), rng), lang, f"s{i % 3}"))
    passage = sentence("en", 60, rng)
    for i in range(160, 170):
        rows.append((i, sentence("en", 30, rng) + " " + passage + " " + sentence("en", 30, rng), "en", None))
    rows += [(170 + i, rows[i][1], rows[i][2], "copy") for i in range(5)]
    rows += [(200, None, None, "s0"), (201, "", "en", "s1"), (202, "12 34 !!", "en", "s2"), (3, rows[3][1], "es", "s0")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, folder)
    assert kept.schema.names == docs.columns
    kept = [r.asDict() for r in kept.collect()]
    assert sorted(str(r) for r in kept) == sorted(str(r) for r in before if r["doc_id"] not in (200, 201, 202))

    docs = spark.createDataFrame([tuple(r.values()) for r in kept], SCHEMA)
    one = [r.asDict() for r in stages["near_dedup"](spark, docs, folder).collect()]
    roots = brute_components([brute_fp(r["text"], 5) for r in kept], [r["doc_id"] for r in kept])
    assert sorted(r["doc_id"] for r in one) == sorted({*roots})

    docs = spark.createDataFrame([tuple(r.values()) for r in one], SCHEMA)
    cut = [r.asDict() for r in stages["suffix_array"](spark, docs, folder).collect()]
    facts = {r["doc_id"]: f for r, f in zip(one, brute([r["text"].encode() for r in one]))}
    assert len(cut) == len(one) and any(f[1] for f in facts.values())
    for r in cut:
        n, removed, _, _ = facts[r["doc_id"]]
        assert n - removed - 6 <= len(r["text"].encode()) <= n - removed and r["n_chars"] == len(r["text"])

    docs = spark.createDataFrame([tuple(r.values()) for r in cut], SCHEMA)
    mixed = stages["mix"](spark, docs, folder)
    assert mixed.columns == docs.columns
    mixed = [r.asDict() for r in mixed.collect()]
    per = {}
    for r in mixing.mix(docs).collect():
        per[r.doc_id] = (r.taken, r.size)
    for i, (taken, size) in per.items():
        mine = [r for r in mixed if r["doc_id"] == i]
        assert sum(len(r["text"].split()) for r in mine) == taken
        source = next(r["text"] for r in cut if r["doc_id"] == i)
        assert all(len(r["text"].split()) < size and r["text"] in source or r["text"] == source for r in mine)

    docs = spark.createDataFrame([tuple(r.values()) for r in mixed], SCHEMA)
    library = Tokenizer.from_file(TOKENIZER)
    ids = sorted((r.doc_id, r.ids, r.decoded) for r in stages["encode"](spark, docs, folder).collect())
    want = [(r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in mixed]
    assert ids == sorted((i, x, library.decode(x, skip_special_tokens=False)) for i, x in want)


def test_run_and_empty(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and all(r.n_tokens == len(r.ids) for r in got)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_pass_through(spark, folder):
    """Names that the operators use inside, maps, nulls and repeated rows, through all stages that return documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3))
    docs = docs.selectExpr("*", "doc_id * 2 as score", "'x' as lang_pred", "1 as closest", "'r' as root", "doc_id as __id", "map('k', doc_id) as facts", "array(1, null) as mark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        rows = got.collect()
        assert rows and all(r.score == 2 * r.doc_id and r.facts == {"k": r.doc_id} and r["__id"] == r.doc_id and r.mark == [1, None] and (r.lang_pred, r.closest, r.root) == ("x", 1, "r") for r in rows), name


def test_batches_are_bounded_by_bytes(spark, folder):
    """Unless the session has a bound of its own."""
    key, bound = common.BATCH
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    try:
        for name, stage in corpus_pipeline.STAGES:
            for own in (None, "3m"):
                spark.conf.unset(key) if own is None else spark.conf.set(key, own)
                stage(spark, docs.limit(0), folder)
                assert spark.conf.get(key) == (own or bound), name
    finally:
        spark.conf.unset(key)
