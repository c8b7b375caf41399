import hashlib
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.WordBPE(open(PATH, encoding="utf-8").read())


def both(texts):
    theirs = LIBRARY.encode_batch(texts, add_special_tokens=False)
    for text, want, (ids, decoded) in zip(texts, theirs, OURS.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == want.ids, text
        assert decoded.decode() == LIBRARY.decode(want.ids, skip_special_tokens=False) == OURS.decode(ids)


def test_plain_and_odd_texts():
    both(["", " ", "Hello, World's 1234 best!", "aaaaaaa aaaa aa", "<|endoftext|>a<|startoftext|> B<|endoftext|>", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ é", "it'S they'LL 'twas", "  tabs\tand\nlines x　y\x1cz\x85w", "漢字かな 👩‍👩‍👧 ½²", "x" * 3000])


def test_every_character():
    """All code points that UTF-8 can hold, assigned or not: in a word, after one of its kind, and after a contraction."""
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [" ".join((f"a{c}b {c}{c} 'S{c} .{c}1" if ord(c) < 0x40000 else f"a{c}b") for c in chars[at : at + 40]) for at in range(0, len(chars), 40)]
    for at in range(0, len(texts), 500):
        both(texts[at : at + 500])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=60), max_size=5))
def test_random_texts(texts):
    both(texts)


def test_cache_may_be_tiny():
    small = bpe.WordBPE(open(PATH, encoding="utf-8").read(), cache_words=3)
    texts = ["one two three four five six", "six seven one two"]
    assert [i for i, _ in small.encode(texts)] == [i for i, _ in OURS.encode(texts)]


def test_block_larger_than_a_warm_cache():
    small = bpe.WordBPE(open(PATH, encoding="utf-8").read(), cache_words=3)
    texts = ["one two", *[""] * 255, "two three four five<|endoftext|> six", *[""] * 255, "six one", "seven"]
    assert [*small.encode(texts)] == [*OURS.encode(texts)] and len(small.cache) <= 3


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "Some words " * 5000, None), (None, "null id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.digests(docs, PATH).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"}
    for r in got:
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode(docs.where("doc_id = 3"), PATH).first()
    assert full.ids == LIBRARY.encode("Some words " * 5000, add_special_tokens=False).ids
    assert bpe.digests(docs.where("false"), PATH).count() == 0


def test_blocks_are_bounded():
    """By texts and by code points, with whole texts in their order."""
    long = "w" * (bpe.BLOCK_CHARS // 2 + 1)
    texts = ["a", long, long, None, long * 3, "b", *[""] * 600]
    blocks = [*OURS.blocks(texts)]
    assert [t for b in blocks for t in b] == texts
    assert all(len(b) <= bpe.BLOCK_TEXTS and (len(b) == 1 or sum(len(t or "") for t in b) <= bpe.BLOCK_CHARS) for b in blocks)


def test_texts_go_to_the_workers_once(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    for df, columns in ((bpe.encode(docs, PATH), ["doc_id", "text"]), (bpe.encode(docs, PATH, keep_text=False), ["doc_id"])):
        assert [r.asDict()["n_tokens"] for r in df.orderBy("doc_id").collect()] == [2, 0] and df.columns == [*columns, "ids", "n_tokens", "decoded"]
        sent = df._jdf.queryExecution().analyzed().children().head().output()
        assert sent.size() == 2


def test_a_task_leaves_no_words_in_its_worker(spark):
    docs = spark.range(8, numPartitions=4).selectExpr("id as doc_id", "concat('word', id) as text")
    assert bpe.digests(docs, PATH).count() == 8

    def held(batches):
        for batch in batches:
            for model in bpe._models.values():
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(model.cache)], pa.int32())})

    found = [r.n for r in spark.range(8, numPartitions=4).mapInArrow(held, "n int").collect()]
    assert found and not any(found)
