import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import fim
from lexloom.llm.common import flat

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    draw = random.Random(3)
    pieces = ["a", "word", "é", "日本語", "😀", " ", "  ", "\n", "\t", "\x0b", "\x00", "　", " ", "<P", "<", "S>", "<M>"]
    out = ["".join(draw.choice(pieces[:-1] if i % 5 else pieces) for _ in range(draw.randrange(0, 200))) for i in range(300)]
    return [*out, "", " ", "   \n", "x", "x ", " x", "é" * 5000, "long word " * 30000, " " * 9000, "日" * 70000 + " b"]


@pytest.mark.parametrize("every,stretch", [(1, 7), (3, 64), (64, 1 << 20)])
def test_every_cut_is_found(every, stretch):
    some = [t for t in texts() if len(t) < 3000]
    raw, ends = flat(pa.array(some))
    index = fim.count_units(raw, ends, every, stretch)
    base, points = 0, 0
    for i, t in enumerate(some):
        units = UNIT.findall(t)
        assert index.units_before[i] == base and index.points_before[i] == points
        done = ""
        for k, u in enumerate(units, 1):
            done += u
            assert fim.locate(raw, ends, index, base + k) == (ends[i] + len(done.encode()), points + len(done))
        base, points = base + len(units), points + len(t)
    assert index.units_before[-1] == base and len(index.bytes_) == base // every + 1
    assert not np.diff(index.bytes_).min() <= 0


def test_against_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all"), (7, None), (8, "same"), (8, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "map('k', 1) as output", "'kept' as extra")
    got = fim.transform(docs, rate=90, every=16).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.extra for r in got} == {"kept"}
    want = sorted(((i, *plainly(i, t, 90), t or "") for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests(spark):
    docs = spark.createDataFrame([(i, f"a b  c{i} d ") for i in range(60)], "doc_id long, text string")
    for r in fim.digests(docs).collect():
        n, form, prefix, middle, output = plainly(r.doc_id, f"a b  c{r.doc_id} d ")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(f"a b  c{r.doc_id} d ".encode()).hexdigest()
    assert fim.digests(docs.where("false")).count() == 0


def test_sentinels_that_overlap_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>x", "<M>"), ("", "b", "c"), ("ab", "bc", "d"), ("aa", "c", "d")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)
