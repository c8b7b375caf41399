"""Document quality by co-training two views: a page's text content and its metadata.

The content view holds shares of character classes, word and line statistics and repetition; the
metadata view holds only what a page declares, never its text: the source, the language and the
declared length. Each view has a logistic classifier. In each round both score a pool of unlabelled
documents, and each gives the other the documents it is surest of, as many of each class as
``per_round`` and the class shares allow; neither gives those on which the other firmly
disagrees. The pool holds no labelled document, so that each view is calibrated on labelled
documents that took no part in training, not as pseudo-labels either (Platt scaling), and a logistic combination of both calibrated views, fitted on the same
documents, scores every document. Documents are kept where quality is at least ``keep_above``.

Training reads about ``sample`` labelled documents of each class and ``pool`` unlabelled ones,
chosen by hash (documented bounds); scoring reads every whole text.

Edge cases: a null or empty text has quality 0 and is not kept. A label that is null or not 0 or
1 is ignored; of several labels of an id the smallest counts. Without labels of both classes
every other document has quality 1. Null metadata is a value of its own. Repeated rows are
scored each. Old columns that clash with new ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, flat, slices, thrifty, written

_WORDS = re.compile(WORD)
#: Class of each byte: upper, lower, digit, space, line end, sentence mark, other ASCII, above ASCII.
_CLASS = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 4 if b == 10 else 3 if b == 32 or 9 <= b <= 13 else 5 if b in b".,;:?'\"()-" else 7 if b >= 128 else 6 for b in range(256)], dtype=np.uint8)
CLASSES, HASHED = 8, 32
LINES = 4
CONTENT = CLASSES + LINES + 8
#: Source and language, the declared length, and which of these sizes it is: under 1, 2, 4, ... characters.
SIZES = 24
METADATA = 2 * HASHED + 1 + SIZES


def content_view(text: str | None, class_shares: np.ndarray) -> np.ndarray:
    out = np.zeros(CONTENT)
    out[:CLASSES] = class_shares
    lines = (text or "").split("\n")
    lengths = np.array([len(x) for x in lines], dtype=float)
    out[CLASSES : CLASSES + LINES] = [np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()), len(set(lines)) / len(lines)]
    words = _WORDS.findall(text or "")
    if words:
        counts, n = Counter(words), len(words)
        top = max(counts.values())
        pairs = Counter(zip(words, words[1:]))
        out[CLASSES + LINES :] = [np.log1p(n), sum(map(len, words)) / n / 10, len(counts) / n, len(counts) / np.sqrt(n) / 10, top / n, sum(k - 1 for k in pairs.values()) / n, sum(not w[-1].isalnum() for w in words) / n, sum(not any(map(str.isalnum, w)) for w in counts.elements()) / n]
    return out


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(METADATA)
    size = max(0, n_chars or 0)
    out[zlib.crc32(f"s{source}".encode()) % HASHED] = 1
    out[HASHED + zlib.crc32(f"l{lang}".encode()) % HASHED] = 1
    out[2 * HASHED] = np.log1p(size)
    out[2 * HASHED + 1 + min(SIZES - 1, int(size).bit_length())] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights and a bias, classes weighing the same, by Newton's method."""
    x1 = np.c_[x, np.ones(len(x))]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    ridge = np.r_[np.full(x.shape[1], l2), 1e-9]
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x1 @ w)
        slope = x1.T @ (weight * (p - y)) + ridge * w
        curve = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(curve + 1e-9 * np.eye(len(w)), slope)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class View:
    """A logistic classifier on standardised features, with Platt's two numbers."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray) -> View:
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        return cls(mean, spread, fit_logistic(np.clip((x - mean) / spread, -8, 8), y))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.margin(x) + self.shift


@dataclass
class CoTrained:
    content: View
    metadata: View
    combine: np.ndarray

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.calibrated(content), self.metadata.calibrated(metadata)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, pool_content: np.ndarray, pool_metadata: np.ndarray, rounds: int = 5, per_round: int = 200) -> CoTrained:
    """Two thirds of the labelled rows train, the others calibrate."""
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    views, pools = [content[~held], metadata[~held]], [pool_content, pool_metadata]
    truth = [y[~held].astype(float), y[~held].astype(float)]
    share = y[~held].mean()
    free = np.ones(len(pool_content), dtype=bool)
    models = [View.fitted(v, t) for v, t in zip(views, truth)]
    for _ in range(rounds):
        if not free.any():
            break
        margins = [m.margin(p) for m, p in zip(models, pools)]
        for teacher, pupil in ((0, 1), (1, 0)):
            for label in (1, 0):
                sign = 1 if label else -1
                n = int(per_round * (share if label else 1 - share))
                sure = np.where(free & (sign * margins[teacher] > 2) & (sign * margins[pupil] > -1), sign * margins[teacher], -np.inf)
                at = np.argsort(-sure, kind="stable")[:n]
                at = at[np.isfinite(sure[at])]
                views[pupil] = np.concatenate([views[pupil], pools[pupil][at]])
                truth[pupil] = np.r_[truth[pupil], np.full(len(at), float(label))]
                free[at] = False
        models = [View.fitted(v, t) for v, t in zip(views, truth)]
    test = held if held.any() else np.ones(len(y), dtype=bool)
    for model, v in zip(models, (content, metadata)):
        a = fit_logistic(model.margin(v[test])[:, None], y[test], l2=1e-2)
        model.slope, model.shift = float(a[0]), float(a[1])
    both = np.c_[models[0].calibrated(content[test]), models[1].calibrated(metadata[test])]
    return CoTrained(*models, fit_logistic(both, y[test], l2=1e-2))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, ends = flat(batch.column("text"))
    sizes, n = np.diff(ends), batch.num_rows
    shares = np.bincount(np.repeat(np.arange(n), sizes) * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(sizes, 1)[:, None]
    texts = batch.column("text").to_pylist()
    content = np.array([content_view(t, s) for t, s in zip(texts, shares)]).reshape(n, CONTENT)
    facts = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
    return content, np.array([metadata_view(*f) for f in facts]).reshape(n, METADATA)


_INPUT = ["text", "source", "lang", "n_chars"]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, pool: int = 3000, rounds: int = 5) -> CoTrained | None:
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    some = docs.where(F.length("text") > 0)
    # Copies, and rows of one id, are drawn by their texts, each distinct one once: so the samples bound rows.
    # The pool (y null) holds no text of a document that has a label.
    with_label = labels.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id", "left").withColumn("has", F.lit(1))
    marked = written(some.select("doc_id", F.xxhash64("text").alias("mark")).join(with_label, "doc_id", "left").groupBy("mark").agg(F.min("y").alias("y"), F.max("has").alias("has")).where("y is not null or has is null").select("mark", F.coalesce("y", F.lit(-1)).alias("y")))
    totals = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    if not {0, 1} <= totals.keys():
        return None
    rates = {y: (pool if y == -1 else sample) / n for y, n in totals.items()}
    share = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("y")]
    chosen = marked.where(F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))  # about 2 x sample + pool marks
    rows = some.select(F.xxhash64("text").alias("mark"), *_INPUT).join(F.broadcast(chosen), "mark")
    drawn = rows.groupBy("mark").agg(F.min(F.struct("y", *_INPUT)).alias("row")).select("row.*")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(a), pa.list_(pa.float64())), pa.array(list(b), pa.list_(pa.float64()))], names=["y", "a", "b"])

    got = sorted(drawn.mapInArrow(thrifty(vectors), "y int, a array<double>, b array<double>").collect(), key=lambda r: (r.a, r.b, r.y))
    y = np.array([r.y for r in got])
    a, b = np.array([r.a for r in got]), np.array([r.b for r in got])
    if len(set(y[y >= 0])) < 2:
        return None
    order = np.argsort([zlib.crc32(v.tobytes()) for v in a], kind="stable")
    y, a, b = y[order], a[order], b[order]
    return co_train(a[y >= 0], b[y >= 0], y[y >= 0], a[y < 0], b[y < 0], rounds)


def score(docs: DataFrame, model: CoTrained | None, keep_above: float = 0.5) -> DataFrame:
    """Add ``p_content``, ``p_metadata``, ``quality`` and ``keep``."""
    new = {"p_content": "double", "p_metadata": "double", "quality": "double", "keep": "boolean"}
    kept = [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {k}" for c, k in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 21):
                some = np.diff(flat(batch.column("text"))[1]) > 0
                found = model.scores(*_views(batch)) if model else [np.ones(batch.num_rows)] * 3
                found = [np.where(some, f, 0.0) for f in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, found), pa.array(found[2] >= keep_above)], names=[*kept, *new])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(thrifty(run), schema)
