"""BPE encoding and decoding by batched merge rounds in numpy.

A batch's new words lie in one flat array of symbols. Each round looks up the rank of every
adjacent pair by binary search in the sorted pair keys, finds each word's lowest rank, and
merges all its occurrences from left to right, until no word has a pair that merges. Words
met before come from a bounded cache of each task, which only saves work.

The tokenizer's file is read on the driver (a parameter; about 2 MB) and sent to the workers.
It must be a BPE model with an end-of-word suffix over byte symbols, such as
``word_bpe_49k.json``: NFC, lower case, words by a pattern, bytes as printable symbols.

Edge cases: a null text is encoded as the empty one; both give no ids and empty text. Texts of
any length are encoded whole. Repeated rows are encoded each. Other columns pass through, the
names of new ones win over old columns of that name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import thrifty

#: Code points that the library's word pattern, which knows Unicode 16, takes for unassigned.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals newer than Python's tables, and their small letters.
SMALL_LETTERS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL_LETTERS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LATER = re.compile(f"[{LATER}]")

#: Words that are merged in one run, and texts and code points that are split at once (one text at least), so that scratch stays small.
LOT, BLOCK_TEXTS, BLOCK_CHARS = 16_384, 256, 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable Latin-1, else from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    symbols, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(spare)
            spare += 1
    return [symbols[b] for b in range(256)]


class WordBPE:
    """Encoder and decoder of one tokenizer file; equal ids to the tokenizers library's."""

    def __init__(self, source: str, cache_words: int = 100_000):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1
        left, right = (np.array([vocab[m[i]] for m in merges], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        self.strings = [b""] * self.size
        for token, i in vocab.items():
            self.strings[i] = token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        # Where a text has code points that our pattern knows and the library's doesn't, without these.
        without = regex.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--[{LATER}]]", pattern)
        self.old_words = regex.compile(without, regex.VERSION1)
        self.cache_words = cache_words
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    # -- text to words -------------------------------------------------------------------
    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, letter by letter (no final sigma). White space is dropped later."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """Words in order; an added token is one that begins with a NUL mark."""
        if self.cut_added is None or not any(t in text for t in self.added):
            return self.found(self.normal(text))
        found: list[str] = []
        for part in self.cut_added.split(text):
            found += ["\0" + part] if part in self.added else self.found(self.normal(part))
        return found

    def found(self, text: str) -> list[str]:
        return (self.words if text.isascii() or not _LATER.search(text) else self.old_words).findall(text)

    # -- words to ids --------------------------------------------------------------------
    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, flat, and each word's number of ids."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.inner[raw]
        ids[np.cumsum(sizes) - 1] = self.final[raw[np.cumsum(sizes) - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        none = np.iinfo(np.int64).max
        while len(ids) > 1:
            keys = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where((self.keys[at] == keys) & (word[:-1] == word[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            ends = np.r_[starts[1:], len(ids)]
            low = np.repeat(lowest, ends - starts)
            hit = (rank == low[:-1]) & (rank != none)
            # Of touching hits (one symbol repeated), every second one merges, from the left.
            p = np.flatnonzero(hit)
            if len(p):
                first = np.r_[True, p[1:] != p[:-1] + 1]
                nth = np.arange(len(p)) - np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
                p = p[nth % 2 == 0]
                ids[p] = self.made[at[p]]
            still = np.repeat(lowest != none, ends - starts)
            keep = np.ones(len(ids), dtype=bool)
            keep[p + 1] = False
            done_ids.append(ids[~still])
            done_word.append(word[~still])
            ids, word = ids[keep & still], word[keep & still]
        done_ids.append(ids)
        done_word.append(word)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids and decoded bytes of words, in one flat run of merge rounds."""
        out, plain = {}, []
        for w in words:
            if w[0] == "\0" and w[1:] in self.added:
                i = self.added[w[1:]]
                out[w] = (i.to_bytes(4, "little"), self.strings[i])
            else:
                plain.append(w)
        if not plain:
            return out
        ids, sizes = self.merged([w.translate(SMALL_LETTERS).encode() for w in plain])
        raw, listed, at = ids.astype("<u4").tobytes(), ids.tolist(), 0
        for w, n in zip(plain, sizes.tolist()):
            out[w] = (raw[4 * at : 4 * (at + n)], b" ".join([self.strings[i] for i in listed[at : at + n]]))
            at += n
        return out

    @staticmethod
    def blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
        start, chars = 0, 0
        for i, text in enumerate(texts):
            n = len(text or "")
            if i > start and (i - start >= BLOCK_TEXTS or chars + n > BLOCK_CHARS):
                yield texts[start:i]
                start, chars = i, 0
            chars += n
        if start < len(texts):
            yield texts[start:]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text, its ids as little-endian 32-bit integers and its decoded bytes."""
        for block in self.blocks(texts):
            split = [self.split(t) if t else [] for t in block]
            known = self.cache
            new = [*{w for words in split for w in words if w not in known}]
            if len(known) + len(new) > self.cache_words:  # what the block needs is held apart; the cache starts anew
                known = {w: known[w] for words in split for w in words if w in known}
                self.cache = {}
            for lot in range(0, len(new), LOT):
                known |= self.learn(new[lot : lot + LOT])
            if known is not self.cache and len(known) <= self.cache_words:
                self.cache = known
            for words in split:
                found = [known[w] for w in words]
                yield b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, as the library does where a file names no decoder."""
        return b" ".join([self.strings[i] for i in np.frombuffer(ids, dtype="<u4")]).decode()


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: bool = True, decoded: bool = True, keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (array<int>), ``n_tokens`` (long) and ``decoded`` (string) to each document; without ``keep_text``, drop its text."""
    return _apply(docs, tokenizer_path, text, [*["ids"] * ids, "n_tokens", *["decoded"] * decoded], keep_text)


def digests(docs: DataFrame, tokenizer_path: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """As :func:`encode`, with the SHA-256 of the ids and of the decoded text in their place."""
    return _apply(docs, tokenizer_path, text, ["n_tokens", "ids_sha256", "decoded_sha256"], keep_text)


_KINDS = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("bigint", pa.int64()), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
_models: dict[str, WordBPE] = {}


def _model(source: str) -> WordBPE:
    if source not in _models:
        _models.clear()
        _models[source] = WordBPE(source)
    return _models[source]


def _apply(docs: DataFrame, tokenizer_path: str, text: str, new: list[str], keep_text: bool) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{text}`").alias("__text")] * (text not in kept))  # the workers get texts once
    read = kept.index(text) if text in kept else len(kept)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {_KINDS[c][0]}" for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        make = {
            "ids": lambda i, d: np.frombuffer(i, dtype="<i4"),
            "n_tokens": lambda i, d: len(i) // 4,
            "decoded": lambda i, d: d.decode(),
            "ids_sha256": lambda i, d: hashlib.sha256(i).hexdigest(),
            "decoded_sha256": lambda i, d: hashlib.sha256(d).hexdigest(),
        }
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    found: dict[str, list] = {c: [] for c in new}
                    for i, d in model.encode(batch.column(read).to_pylist()):
                        for c in new:
                            found[c].append(make[c](i, d))
                    arrays = [*batch.columns[: len(kept)], *(pa.array(found[c], type=_KINDS[c][1]) for c in new)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])
        finally:
            model.cache = {}  # the worker may serve other operators next

    return frame.mapInArrow(thrifty(run), schema)
