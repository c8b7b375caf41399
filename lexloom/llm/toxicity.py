"""Expected severity of toxic language by cumulative-link ordinal regression.

Features are words and their beginnings of 2 to 6 characters, in lower case; each has two
values, 1 where it occurs and log(1 + 500 rate), its rate being its share of the text's words. They are chosen by how
surely they lean to documents labelled toxic, and only ``features`` of them stay, so vectors
are sparse. Labels say only whether a document is toxic. Toxic documents are graded 1 to 3 by
how far a plain logistic model that has not seen them puts them on the toxic side: the terciles
of the margins that three models give, each to the third that it was not fitted on. The others
have grade 0.
One weight vector serves all grades, P(grade >= k) = sigmoid(w x - theta_k) with rising
thresholds; the expected severity is the sum over k. A document is called toxic where
P(grade >= 1) is at least one half.

The model is fitted on at most about ``sample`` labelled documents of each class, by a hash of
their ids (a documented bound); every document is scored on its whole text.

Edge cases: a null or empty text has severity 0 and is not toxic. A label that is null or not 0
or 1 is ignored; of several labels of an id the largest counts. Without labels of both classes,
or where no feature leans to toxic documents by more than chance, every severity is 0. Repeated rows are scored each. Old columns that clash with new ones are
replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, thrifty, written
from lexloom.llm.quality import fit_logistic

_WORDS = re.compile(WORD)
_EDGE = ".,;:!?\"'()[]{}*#$%&|-"
LONGEST = 6


def parts_of(word: str) -> list[str]:
    """A word's features: itself, marked by a space, and its beginnings."""
    word = word.strip(_EDGE)
    return [word + " ", *(word[:n] for n in range(2, LONGEST + 1) if len(word) > n)] if word else []


def word_counts(text: str | None) -> Counter:
    return Counter(_WORDS.findall(text.lower())) if text else Counter()


@dataclass
class Ordinal:
    """Weights by feature, and thresholds of the grades."""

    names: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.index = {f: i for i, f in enumerate(self.names)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def vector(self, text: str | None) -> dict[int, float]:
        counts = word_counts(text)
        total, found, cache = sum(counts.values()), {}, self.cache
        for word, n in counts.items():
            at = cache.get(word)
            if at is None:
                if len(cache) >= 200_000:
                    cache.clear()
                at = cache[word] = tuple(self.index[f] for f in parts_of(word) if f in self.index)
            for i in at:
                found[i] = found.get(i, 0) + n
        d = len(self.names)
        return {i: 1.0 for i in found} | {d + i: float(np.log1p(500.0 * n / total)) for i, n in found.items()}

    def severity(self, text: str | None) -> tuple[float, float]:
        """(expected grade, P(grade >= 1))."""
        if not len(self.thresholds):
            return 0.0, 0.0
        x = self.vector(text)
        eta = sum(self.weights[i] * v for i, v in x.items())
        at_least = 1 / (1 + np.exp(-np.clip(eta - self.thresholds, -60, 60)))
        return float(at_least.sum()), float(at_least[0])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int = 4, l2: float = 1e-3, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative logit model, by Adam on all rows."""
    n, d = x.shape
    p = np.zeros(d + grades - 1)
    p[d], p[d + 1 :] = 1.0, 0.0  # first threshold, then logs of the steps
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = np.ones(n)
    for t in range(1, rounds + 1):
        theta = p[d] + np.r_[0.0, np.cumsum(np.exp(p[d + 1 :]))]
        ends = np.r_[-np.inf, theta, np.inf]
        eta = x @ p[:d]
        low, high = (1 / (1 + np.exp(-np.clip(ends[grade + k] - eta, -60, 60))) for k in (0, 1))
        prob = np.maximum(high - low, 1e-9)
        slope = np.zeros_like(p)
        slope[:d] = -(x.T @ (weight * (low + high - 1))) / n + l2 * p[:d]
        by_end = np.zeros(grades + 1)
        np.add.at(by_end, grade + 1, -weight * high * (1 - high) / prob / n)
        np.add.at(by_end, grade, weight * low * (1 - low) / prob / n)
        by_theta = by_end[1:-1]
        slope[d] = by_theta.sum()
        tails = np.cumsum(by_theta[::-1])[::-1]
        slope[d + 1 :] = tails[1:] * np.exp(p[d + 1 :])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.r_[0.0, np.cumsum(np.exp(p[d + 1 :]))]


def grades_of(x: np.ndarray, toxic: np.ndarray, folds: int = 3) -> np.ndarray:
    """0 for what isn't toxic, else 1 to 3: the tercile of its margin, by a model of the other folds."""
    margin = np.zeros(len(x))
    fold = np.zeros(len(x), dtype=int)
    for c in (0, 1):  # rows come in an order of their own, so folds are dealt in turn
        fold[toxic == c] = np.arange((toxic == c).sum()) % folds
    for f in range(folds):
        here, rest = fold == f, fold != f
        if len(set(toxic[rest].tolist())) == 2:
            w = fit_logistic(x[rest], toxic[rest], l2=1e-2)
            margin[here] = x[here] @ w[:-1] + w[-1]
    cuts = np.quantile(margin[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (margin > cuts[0]) + (margin > cuts[1]), 0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = 4000, features: int = 512) -> Ordinal:
    none = Ordinal([], np.zeros(0), np.zeros(0))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Copies, and rows of one id, are drawn by their texts, each distinct one once: so the sample bounds rows.
    marked = docs.select("doc_id", F.xxhash64(text).alias("mark")).join(known, "doc_id").groupBy("mark").agg(F.max("toxic").alias("toxic"))
    marked = written(marked)
    totals = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return none
    share = F.when(F.col("toxic") == 1, F.lit(sample / totals[1])).otherwise(F.lit(sample / totals[0]))
    chosen = marked.where(F.pmod("mark", F.lit(1 << 20)) < share * (1 << 20))  # 2 x sample marks, about
    texts = docs.select(F.xxhash64(text).alias("mark"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "mark")
    frame = texts.groupBy("mark").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, value in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                counts = word_counts(value)
                total, found = sum(counts.values()), Counter()
                for word, n in counts.items():
                    for f in parts_of(word):
                        found[f] += n
                rates = [n / total for n in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(rates, pa.float64())], names=["toxic", "feature", "rate"])

    sample_table = written(frame.select("toxic", "text"))
    sizes = {r.toxic: r["count"] for r in sample_table.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return none
    per = sample_table.mapInArrow(thrifty(spread), "toxic int, feature string, rate double").groupBy("feature").agg(
        *[F.sum(F.when(F.col("toxic") == c, F.col("rate"))).alias(f"r{c}") for c in (0, 1)],
        *[F.sum(F.when(F.col("toxic") == c, F.lit(1))).alias(f"n{c}") for c in (0, 1)],
    )
    # The shares of documents of each class that have a feature, and z of their difference: features
    # that lean to toxic documents by more than chance, and in rate as well.
    part = {c: F.coalesce(F.col(f"n{c}"), F.lit(0)) / sizes[c] for c in (0, 1)}
    mean = {c: F.coalesce(F.col(f"r{c}"), F.lit(0.0)) / sizes[c] for c in (0, 1)}
    pooled = (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0)) + 1.0) / (sizes[0] + sizes[1])
    z = (part[1] - part[0]) / F.sqrt(pooled * F.greatest(F.lit(1e-9), 1 - pooled) * (1.0 / sizes[0] + 1.0 / sizes[1]))
    best = per.withColumn("z", F.round(z, 9)).where((F.col("z") > 4.5) & (mean[1] > 3 * mean[0])).orderBy(F.desc("z"), "feature").limit(features)
    names = [r.feature for r in best.select("feature").collect()]
    if not names:
        return none
    model = Ordinal(names, np.zeros(2 * len(names)), np.zeros(0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [model.vector(v) for v in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([list(x) for x in xs], pa.list_(pa.int32())), pa.array([list(x.values()) for x in xs], pa.list_(pa.float64()))], names=["toxic", "at", "value"])

    rows = sample_table.mapInArrow(thrifty(vectors), "toxic int, at array<int>, value array<double>").collect()
    rows.sort(key=lambda r: (r.toxic, r.at, r.value))
    x = np.zeros((len(rows), 2 * len(names)))
    for i, r in enumerate(rows):
        x[i, r.at] = r.value
    toxic = np.array([r.toxic for r in rows])
    grade = grades_of(x, toxic)
    weights, thresholds = fit_ordinal(x, grade)
    return Ordinal(names, weights, thresholds)


def score(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """Add ``severity`` (0 to 3), ``p_toxic`` and ``toxic``; ``text`` stays."""
    new = {"severity": "double", "p_toxic": "double", "toxic": "boolean"}
    kept = [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {k}" for c, k in new.items())])
    names, weights, thresholds = model.names, model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Ordinal(names, weights, thresholds)
        for batch in batches:
            found = [mine.severity(v.as_py()) for v in batch.column("__text")]
            first = np.array([p for _, p in found], dtype=float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([s for s, _ in found], pa.float64()), pa.array(first), pa.array(first >= 0.5)], names=[*kept, *new])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")).mapInArrow(thrifty(run), schema)
