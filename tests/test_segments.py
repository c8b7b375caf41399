"""Adds, changes and deletions in batches give what a full build gives; nothing is lost in between."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import postings, search
from lexloom.sources import segments

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "key long, text string, law string"


def version(n, seed):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choices(WORDS, k=draw.randrange(0, 30))), f"l{i % 2}") for i in range(n)]


def best(spark, index, asked):
    return sorted(map(tuple, search.top_bm25(index, asked, 5, key="key").collect()))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w3", None), (2, "w4 w59 w1 w1", ["l1"]), (3, "w30", None), (4, "added", None)], "query_id int, text string, laws array<string>")


def full(spark, rows):
    return postings.index_of(postings.shards(spark.createDataFrame(rows, SCHEMA), "key", law="law"))


def test_batches_equal_a_full_build(spark, tmp_path, asked):
    root, state = str(tmp_path / "index"), {r[0]: r for r in version(120, 1)}
    with pytest.raises(FileNotFoundError):
        segments.load(spark, root)
    segments.sync(spark, root, spark.createDataFrame([*state.values()], SCHEMA), shard_documents=50)
    assert best(spark, segments.load(spark, root), asked) == best(spark, full(spark, [*state.values()]), asked)
    loaded = segments.load(spark, root)
    before = best(spark, loaded, asked)

    state |= {r[0]: r for r in version(20, 2)} | {900: (900, "added w1", "l1"), 901: (901, None, None)}
    for k in (30, 31, 32):
        del state[k]
    docs = spark.createDataFrame([*state.values()], SCHEMA)
    found = {r.change: r["count"] for r in segments.changes(spark, root, docs).groupBy("change").count().collect()}
    same = sum(a[1] == b[1] for a, b in zip(version(20, 1), version(20, 2)))
    assert found == {"added": 2, "changed": 20 - same, "deleted": 3, "unchanged": 97 + same}
    made = segments.sync(spark, root, docs)
    assert made.documents == len(state) == 119 and made.generation == 2
    assert best(spark, segments.load(spark, root), asked) == best(spark, full(spark, [*state.values()]), asked)
    assert best(spark, loaded, asked) == before == best(spark, segments.load(spark, root, 1), asked)  # an older generation stays

    for turn in range(3):  # a batch of the stream that comes twice counts once
        state[turn] = (turn, f"turn {turn} w1", "l0")
        for _ in range(2):
            made = segments.apply(spark, root, spark.createDataFrame([state[turn]], SCHEMA), stream="s", batch=turn)
    assert made.generation == 5 and made.batches == {"s": 2}
    want = best(spark, full(spark, [*state.values()]), asked)
    assert best(spark, segments.load(spark, root), asked) == want

    merged = segments.merge(spark, root, fan=3)
    assert merged.generation == 6 and len(merged.segments) < len(made.segments) and merged.documents == len(state)
    assert best(spark, segments.load(spark, root), asked) == want
    assert sorted(map(tuple, segments.live_documents(spark, root).select("key", "text", "law").collect())) == sorted(state.values())
    gone = segments.vacuum(spark, root, keep=1)
    assert gone and segments.generations(spark, root) == [6] and best(spark, segments.load(spark, root), asked) == want
    state.pop(5)
    segments.sync(spark, root, spark.createDataFrame([*state.values()], SCHEMA))
    assert best(spark, segments.load(spark, root), asked) == best(spark, full(spark, [*state.values()]), asked)


def test_a_crash_before_publishing_loses_nothing(spark, tmp_path, asked, monkeypatch):
    root, rows = str(tmp_path / "index"), version(30, 3)
    segments.apply(spark, root, spark.createDataFrame(rows, SCHEMA), stream="s", batch=0)
    before = best(spark, segments.load(spark, root), asked)
    publish = segments._publish

    def crash(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(segments, "_publish", crash)
    more = spark.createDataFrame([(7, "w1 w1 w1", "l1"), (500, "added", "l0")], SCHEMA)
    with pytest.raises(RuntimeError):
        segments.apply(spark, root, more, stream="s", batch=1)
    assert best(spark, segments.load(spark, root), asked) == before
    monkeypatch.setattr(segments, "_publish", publish)
    segments.apply(spark, root, more, stream="s", batch=1)
    want = {r[0]: r for r in rows} | {7: (7, "w1 w1 w1", "l1"), 500: (500, "added", "l0")}
    assert best(spark, segments.load(spark, root), asked) == best(spark, full(spark, [*want.values()]), asked)
    assert len(segments.vacuum(spark, root)) == 3  # what the crashed batch wrote: segment, tombstones, terms
    made = segments.manifest(spark, root)
    with pytest.raises(Exception, match="FileAlreadyExists"):  # a second writer of a generation
        segments._publish(spark, root, made)


def test_a_stream_of_files(spark, tmp_path, asked):
    root, inbox = str(tmp_path / "index"), tmp_path / "inbox"
    inbox.mkdir()
    schema = "key long, text string, law string, version long"

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(inbox))
        segments.follow(spark, source, root, str(tmp_path / "checkpoint"), "files").awaitTermination()

    spark.createDataFrame([(1, "w1", "l0", 1), (1, "w2 w1", "l0", 2), (2, "w3", "l1", 1)], schema).coalesce(1).write.mode("append").json(str(inbox))
    run()
    spark.createDataFrame([(2, "w1 w1", "l1", 3), (3, "w3", None, 1)], schema).coalesce(1).write.mode("append").json(str(inbox))
    run()
    assert segments.manifest(spark, root).batches == {"files": 1}
    assert best(spark, segments.load(spark, root), asked) == best(spark, full(spark, [(1, "w2 w1", "l0"), (2, "w1 w1", "l1"), (3, "w3", None)]), asked)


def test_texts_are_not_shuffled_for_a_few_changes(spark, tmp_path):
    """Also where Spark wouldn't send the keys by itself, as with large tables."""
    draw, root = random.Random(5), str(tmp_path / "index")
    rows = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(400)), "l0") for i in range(500)]
    texts = sum(len(r[1]) for r in rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        segments.sync(spark, root, docs)
        segments.sync(spark, root, docs.where("key > 4").withColumn("text", F.when(F.col("key") < 10, "w1 w2").otherwise(F.col("text"))))
        assert shuffled() - before < texts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    made = segments.manifest(spark, root)
    assert (made.documents, made.words) == (495, 5 * 2 + 490 * 400)
