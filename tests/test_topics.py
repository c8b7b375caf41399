"""Topics of sessions, folded at once and over batches out of order."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexloom.streaming import limits, topics

SCHEMA = "s string, turn long, label string, wanted string, question string, summary string, ts timestamp"


def test_labels():
    def last(label, wanted):
        return topics.fold([[1, "new", None, "how to park a car", None], [2, "new", None, "penalties for noise at night", None], [3, label, wanted, "x", None]])[-1][1]

    assert [last("continue", None), last("resume", "t1"), last("resume", "t9"), last("new", None), last("unsure", None), last(None, None)] == ["t2", "t1", "t2", "t3", "t2", "t2"]


def test_restatement_and_notes():
    rows = [
        [1, "new", None, "How to park a car?", None],
        [2, "new", None, "how to park a cart", "not left, so not kept"],
        [3, "new", None, "noise at night", "  parking  " + "x" * 80],
        [4, "resume", "t1", "again", " "],
        [5, "new", None, None, None],
    ]
    note = "parking  " + "x" * 51
    assert topics.fold(rows) == [[1, "t1", "new", None], [2, "t1", "continue", None], [3, "t3", "new", None], [4, "t1", "resume", note], [5, "t5", "new", None]]
    assert topics.fold([[1, "new", None, "short", None], [2, "new", None, "short", None]])[1][1] == "t2"
    many = [[n, "new", None, None, None] for n in range(1, 13)]
    assert topics.fold([*many, [13, "resume", "t1", None, None]])[-1][1] == "t12"
    assert topics.fold([*many, [13, "resume", "t2", None, None]])[-1][1] == "t2"


@pytest.fixture
def sent(spark, tmp_path):
    """Write batches as files and stream them one by one."""

    def run(batches):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = limits.latest(limits.drained(topics.topics(stream.withColumn("other", F.lit(1)), "s", "ts"), "update"), ["s", "turn"])
        return sorted([r.s, r.turn, r.topic, r.label, r.note] for r in out.collect())

    return run


def _time(days):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=days)


def test_batches_out_of_order(sent):
    dice = random.Random(3)
    rows = [(s, n, dice.choice(["new", "continue", "resume", "unsure", None]), f"t{dice.randint(1, 9)}", dice.choice(["how to park a car", "how to park a cart", None]), dice.choice(["a note", None]), _time(n)) for s in "ab" for n in range(1, 10)]
    want = [[s, *x] for s, g in itertools.groupby(rows, lambda r: r[0]) for x in topics.fold([list(r[1:6]) for r in g])]
    mixed = dice.sample(rows, len(rows))
    assert sent([mixed[:5], mixed[5:11], mixed[11:], mixed[:3], [(None, 1, "new", None, None, None, _time(1)), ("a", None, "new", None, None, None, _time(1)), ("a", 99, "new", None, None, None, None)]]) == want


def test_state_goes_after_its_time(sent):
    got = sent([[("a", 1, "new", None, None, None, _time(0))], [("b", 1, "new", None, None, None, _time(90))], [("a", 2, "continue", None, None, None, _time(91)), ("b", 2, "continue", None, None, None, _time(92))]])
    assert [r[:3] for r in got] == [["a", 1, "t1"], ["a", 2, "t2"], ["b", 1, "t1"], ["b", 2, "t1"]]
