"""Severity of toxicity by cumulative-link (proportional-odds) ordinal regression.

``P(grade <= k) = sigmoid(theta_k - w.x)``: one weight vector is shared by all thresholds, so a word that
raises the odds of grade 1 raises those of grades 2 and 3 too. ``x`` holds, for the words of a document and
their first four and five letters, ``log(1 + count)``, a sparse vector over features chosen by log-likelihood ratio.

Labels say only toxic or not. Grade 0 is a clean document; toxic ones are graded 1 to ``GRADES - 1`` by how
many of their words the training rows show to be tell-tale, cut at the quantiles of the toxic training rows.
``expected_severity`` is ``sum(k * P(grade = k))``; a document is toxic where ``P(grade >= 1) >= 0.5``.

Defined cases: a null or empty text scores as one without features; labels that are null, absent, empty or
of one class only leave a model that finds nothing; repeated and contradictory labels all count as rows; a null doc_id is
scored and kept as null; a very long text is scored whole; of grades of equal probability the lowest is named; repeated rows
are scored each; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored (``drop_toxic`` keeps them as they are).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, normal_words

#: Labelled rows of either class that a model is fitted on, at most.
TRAIN_PER_CLASS = 2000
FEATURES = 1000
#: A feature counts from this root of its log-likelihood ratio, or from what chance reaches among all features.
MIN_Z = 2.5
GRADES = 4
MIN_DOCS = 3


def word_features(word: str) -> tuple[str, ...]:
    return (word, word[:4] + "*4", word[:5] + "*5") if len(word) > 4 else (word,)


@dataclass
class Ordinal:
    """Weights by feature and the ordered thresholds."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """``P(grade <= k)`` by row and k, the last being 1."""
        got = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return np.hstack([got, np.ones((len(score), 1))])

    def scores(self, column: pa.Array) -> np.ndarray:
        bounds, codes, words = normal_words(column)
        n = len(bounds) - 1
        if not len(codes) or not self.index:
            return np.zeros(n)
        get = self.index.get
        hits = [[i for i in map(get, word_features(w)) if i is not None] for w in words]
        width = np.array([len(h) for h in hits], np.int64)
        flat = np.array([i for h in hits for i in h], np.int64)
        first = np.cumsum(width) - width
        at = np.flatnonzero(width[codes])
        doc = np.searchsorted(bounds, at, "right") - 1
        times = width[codes[at]]
        doc, code = np.repeat(doc, times), np.repeat(codes[at], times)
        nth = np.arange(len(code)) - np.repeat(np.cumsum(times) - times, times)
        key, count = np.unique(doc * len(self.weights) + flat[first[code] + nth], return_counts=True)
        return np.bincount(key // len(self.weights), self.weights[key % len(self.weights)] * np.log1p(count), n)


def signed_root(a: int, n: int, b: int, m: int) -> float | None:
    """Root of the log-likelihood ratio of a feature in ``a`` of ``n`` and ``b`` of ``m`` rows, if it is commoner in the first."""
    if a * m <= b * n:
        return None
    share = (a + b) / (n + m)
    cells = ((a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share)))
    return float(np.sqrt(2 * sum(x * np.log(x / e) for x, e in cells if x)))


def fit(texts: list[str], toxic: list[int], features: int = FEATURES, grades: int = GRADES, steps: int = 200) -> Ordinal:
    """Choose features by log-likelihood ratio, grade the toxic rows, and fit by Adam on the log-likelihood."""
    y = np.asarray(toxic, int)
    nothing = Ordinal({}, np.zeros(0), np.arange(1.0, grades) * 10)
    if not len(y) or y.min() == y.max():
        return nothing
    bounds, codes, words = normal_words(pa.array(texts, pa.string()))
    of = [word_features(w) for w in words]
    counts = [Counter() for _ in texts]
    for d, c in enumerate(counts):
        for code, k in zip(*np.unique(codes[bounds[d] : bounds[d + 1]], return_counts=True), strict=True):
            for f in of[code]:
                c[f] += int(k)
    df = [Counter(), Counter()]
    for c, label in zip(counts, y, strict=True):
        df[label].update(c.keys())
    n = [int((y == k).sum()) for k in (0, 1)]
    odds = {f: z for f in df[0].keys() | df[1].keys() if df[0][f] + df[1][f] >= MIN_DOCS and (z := signed_root(df[1][f], n[1], df[0][f], n[0])) is not None}
    # the largest of so many features of pure chance would reach about this
    least = max(MIN_Z, float(np.sqrt(2 * np.log(max(2, len(odds))))))
    chosen = [f for f in sorted(odds, key=lambda f: (-odds[f], f))[:features] if odds[f] > least]
    if not chosen:
        return nothing
    index = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for d, c in enumerate(counts):
        for f, k in c.items():
            if (i := index.get(f)) is not None:
                x[d, i] = np.log1p(k)
    strength = x @ np.array([odds[f] for f in chosen], np.float32)
    cuts = np.quantile(strength[y == 1], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, strength, "left"), 0)

    w, theta = np.zeros(len(chosen)), np.linspace(1.0, 3.0, grades - 1)
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    m = [np.zeros_like(w), np.zeros_like(theta)]
    v = [np.zeros_like(w), np.zeros_like(theta)]
    for step in range(1, steps + 1):
        cdf = 1 / (1 + np.exp(-np.clip(theta[None, :] - (x @ w.astype(np.float32))[:, None].astype(float), -40, 40)))
        full = np.hstack([np.zeros((len(y), 1)), cdf, np.ones((len(y), 1))])
        rows = np.arange(len(y))
        p = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-9)
        slope = full * (1 - full)
        up, down = slope[rows, grade + 1], slope[rows, grade]
        gw = (share * (up - down) / p).astype(np.float32) @ x + 2e-4 * w
        gt = np.zeros(grades + 1)
        np.add.at(gt, grade + 1, -share * up / p)
        np.add.at(gt, grade, share * down / p)
        for i, (at, g) in enumerate(((w, gw), (theta, gt[1:-1]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            at -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        theta.sort()
    used = np.abs(w) > 1e-3
    return Ordinal({f: i for i, f in enumerate(f for f, u in zip(chosen, used, strict=True) if u)}, w[used], theta)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Ordinal:
    """Fit on at most ``per_class`` labelled rows of either class, the same ones each time."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    order = (F.xxhash64("_id"), "_id")
    picked = usable.where("_toxic = 1").orderBy(*order).limit(per_class).unionAll(usable.where("_toxic = 0").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where("text is not null").select("doc_id", "text", "_toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r._toxic, r.text))
    return fit([r.text for r in rows], [r._toxic for r in rows])


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """One row a document: expected severity, likeliest grade, probability and verdict of toxicity."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m: Ordinal = held.value
        upto = m.at_most(m.scores(batch.column("text")))
        p = np.diff(upto, axis=1, prepend=0.0)
        bad = 1 - upto[:, 0]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1).astype(np.int32)), pa.array(bad), pa.array((bad >= 0.5).astype(np.int32))],
            names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic int")


def drop_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m: Ordinal = held.value
        yield batch.filter(pa.array(m.at_most(m.scores(batch.column("text")))[:, 0] > 0.5))

    return arrow_map(docs, run, docs.schema)
