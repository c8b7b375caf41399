"""Language identification in two steps: the family first, then the language within it.

Features are counts of letter trigrams, hashed from UTF-8 bytes with A-Z lower-cased and runs of
other ASCII characters as one space. Families are separated by one-versus-rest linear support
vector machines, the languages of one family by one-versus-one machines with votes; all have
squared hinge loss and are fitted together on at most about ``per_language`` distinct texts of each
language, chosen by hash (a documented bound; copies count once). Every whole text is scored: a document's margin
is the mean weight of its trigrams, so one table look-up and sum per byte serves all machines.

The score is the product of the sigmoids of the winning margins, from 0 to 1.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is every text if
nothing could be learned. Rows with a null id are predicted but neither learned from nor held
out. Repeated rows are predicted each and learned from once. Old columns that clash with new ones are replaced. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import flat, slices, thrifty

#: Public language families by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "sinitic": "yue zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS = 13
#: A-Z to lower case; other ASCII that is no letter to a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.partition("-")[0].lower(), f"only {lang}")


def trigrams(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of each text, and len + 1 offsets of the texts in them."""
    body = _FOLD[raw]
    starts_word = np.ones(len(body), dtype=bool)
    starts_word[1:] = body[:-1] == 32
    inner = np.zeros(len(body) + 1, dtype=bool)
    inner[ends[:-1]] = True
    keep = (body != 32) | ~starts_word | inner[:-1]
    new_ends = np.r_[0, np.cumsum(keep)][ends]
    body = body[keep].astype(np.uint32)
    if len(body) < 3:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    code = (body[:-2] * np.uint32(0x9E3779B1) + body[1:-1] * np.uint32(0x85EBCA77) + body[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = (code >> np.uint32(32 - BITS)).astype(np.int64)
    sizes = np.maximum(np.diff(new_ends) - 2, 0)
    inside = np.zeros(len(bucket) + 3, dtype=np.int8)
    np.add.at(inside, new_ends[:-1][sizes > 0], 1)
    np.add.at(inside, (new_ends[1:] - 2)[sizes > 0], -1)
    return bucket[np.cumsum(inside[: len(bucket)]) > 0], np.r_[0, np.cumsum(sizes)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Hierarchy:
    """Weights (buckets x machines), and which machine says what."""

    languages: list[str]
    families: list[str] = field(init=False)
    pairs: list[tuple[int, int]] = field(init=False)
    weights: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.families = sorted({family_of(x) for x in self.languages})
        same = [(i, j) for i in range(len(self.languages)) for j in range(i + 1, len(self.languages))]
        self.pairs = [(i, j) for i, j in same if family_of(self.languages[i]) == family_of(self.languages[j])]

    @property
    def machines(self) -> int:
        return len(self.families) + len(self.pairs)

    def signs(self, lang: np.ndarray) -> np.ndarray:
        """(documents x machines): +1 or -1, 0 where a machine doesn't learn from a document."""
        family = np.array([self.families.index(family_of(x)) for x in self.languages])[lang]
        out = np.zeros((len(lang), self.machines))
        for f in range(len(self.families)):
            out[:, f] = np.where(family == f, 1, -1)
        for k, (i, j) in enumerate(self.pairs, len(self.families)):
            out[lang == i, k], out[lang == j, k] = 1, -1
        return out

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and least score (the family's times the closest rival's only) of each row of margins."""
        sure = 1 / (1 + np.exp(-2 * np.clip(margins, -30, 30)))
        n, rows = len(self.families), np.arange(len(margins))
        family = margins[:, :n].argmax(axis=1)
        score = sure[rows, family] if n > 1 else np.ones(len(margins))
        votes = np.full((len(margins), len(self.languages)), -np.inf)
        for i, lang in enumerate(self.languages):
            votes[family == self.families.index(family_of(lang)), i] = 0
        for k, (i, j) in enumerate(self.pairs, n):
            # A vote, and less than one more by the margin, which breaks ties.
            lean = sure[:, k]
            votes[:, i] += (lean >= 0.5) + 1e-3 * lean
            votes[:, j] += (lean < 0.5) + 1e-3 * (1 - lean)
        lang, alone, closest = votes.argmax(axis=1), score, np.ones(len(margins))
        for k, (i, j) in enumerate(self.pairs, n):
            won = np.where(lang == i, sure[:, k], np.where(lang == j, 1 - sure[:, k], 1))
            score, closest = score * won, np.minimum(closest, won)
        return lang, score, alone * closest


def fit_machines(x: np.ndarray, signs: np.ndarray, l2: float = 1e-3, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Linear machines with squared hinge loss, by accelerated gradient steps on all rows."""
    used = np.maximum((signs != 0).sum(axis=0), 1)
    # Each class weighs the same in each machine.
    plus, minus = np.maximum((signs > 0).sum(axis=0), 1), np.maximum((signs < 0).sum(axis=0), 1)
    share = (np.where(signs > 0, used / (2 * plus), np.where(signs < 0, used / (2 * minus), 0)) / used).astype(x.dtype)
    w, b = np.zeros((x.shape[1], signs.shape[1]), x.dtype), np.zeros(signs.shape[1], x.dtype)
    lipschitz = 2 * ((x**2).sum(axis=1).max() + 1) + l2
    ahead_w, ahead_b, t = w.copy(), b.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - signs * (x @ ahead_w + ahead_b)) * (signs != 0)
        push = (-2 * share * signs * slack).astype(x.dtype)
        new_w = ahead_w - (x.T @ push + l2 * ahead_w) / lipschitz
        new_b = ahead_b - push.sum(axis=0) / lipschitz
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / s * (new_w - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new_w, new_b, s
    return w, b


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_language: int = 400) -> Hierarchy:
    """Learn from the rows of ``docs`` where ``learn`` holds, ``lang`` is not null and ``text`` not empty."""
    known = docs.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    # Copies are one text: marks are counted and drawn, and one row of each drawn mark is taken.
    marks = known.select("lang", "mark").distinct()
    counts = {r.lang: r["count"] for r in marks.groupBy("lang").count().collect()}
    languages = sorted(counts)
    model = Hierarchy(languages)
    if not languages:
        return model
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])[F.col("lang")]
    drawn = known.where(F.pmod("mark", F.lit(1 << 20)) < share * (1 << 20))
    chosen = drawn.groupBy("lang", "mark").agg(F.min("text").alias("text")).select("lang", F.col("text").cast("binary").alias("bytes"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, ends = trigrams(*flat(batch.column("bytes")))
            ats, shares = [], []
            for a, b in zip(ends[:-1], ends[1:]):
                counts = np.bincount(bucket[a:b], minlength=1)
                at = np.flatnonzero(counts)
                ats.append(at.astype(np.int32))
                shares.append(counts[at] / max(1, b - a))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(ats, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))], names=["lang", "at", "share"])

    rows = sorted(chosen.mapInArrow(thrifty(vectors), "lang string, at array<int>, share array<double>").collect(), key=lambda r: (r.lang, r.at, r.share))
    x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r.at] = r.share
    if not len(rows):
        return Hierarchy([])
    # Rare trigrams weigh as much as frequent ones: each is divided by its spread.
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-4
    scale = (1 / spread / np.sqrt(1 << BITS) * 4).astype(np.float32)
    w, b = fit_machines((x - mean) * scale, model.signs(np.array([languages.index(r.lang) for r in rows])))
    model.weights = (w * scale[:, None]).astype(np.float64)
    model.bias = (b - mean @ model.weights).astype(np.float64)
    return model


def predict(docs: DataFrame, model: Hierarchy, text: str = "text", closest: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score``; with ``closest``, also the score by the family and the closest rival alone."""
    new = ["lang_pred", "score", *["closest"] * closest]
    kept = [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string", "score double", *["closest double"] * closest])
    languages, weights, bias = model.languages, model.weights, model.bias
    read = text if text in kept else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Hierarchy(languages, weights, bias)
        names = np.array([*languages, "und"], dtype=object)
        for whole in batches:
            for batch in slices(whole, read, 1 << 18):
                lang, score, near = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                letters = np.array([has_letter(t.as_py() or "") for t in batch.column(read)], dtype=bool)
                if languages and letters.any():
                    bucket, ends = trigrams(*flat(batch.column(read)))
                    sizes = np.diff(ends)
                    margins = np.tile(bias, (batch.num_rows, 1))
                    some = np.flatnonzero(sizes)
                    if len(bucket) > len(weights) and batch.num_rows == 1:  # a long text: the weights once, not once a trigram
                        margins += np.bincount(bucket, minlength=len(weights)) @ weights / len(bucket)
                    elif len(some):
                        margins[some] += np.add.reduceat(weights[bucket], ends[:-1][some], axis=0) / sizes[some, None]
                    found, sure, least = mine.decide(margins)
                    lang, score, near = np.where(letters, found, lang), np.where(letters, sure, 0.0), np.where(letters, least, 0.0)
                added = [pa.array(names[lang].tolist(), pa.string()), pa.array(score), *[pa.array(near)] * closest]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added], names=[*kept, *new])

    frame = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{text}`").alias("__text")] * (text not in kept))  # the workers get texts once
    return frame.mapInArrow(thrifty(run), schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
