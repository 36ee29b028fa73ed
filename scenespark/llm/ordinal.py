"""Cumulative-link (proportional odds) regression on sparse hashed features.

P(grade <= k) = logistic(t_k - w.x) with one weight vector for all grades and ordered
thresholds t_1 < t_2 < ... Weights are fitted by follow-the-regularised-leader with an
L1 and an L2 penalty, so features without evidence stay exactly zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# smallest distance between neighbouring thresholds
GAP = 1e-3


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return float(self.weights[idx] @ val)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.. as columns, one row per score."""
        return logistic(scores[:, None] - self.thresholds[None, :])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Mean grade: the lowest grade plus the steps times their tail probabilities."""
        steps = np.diff(np.asarray(self.grades, dtype=float))
        base = float(self.grades[0]) if self.grades else 0.0
        return base + self.tails(scores) @ steps


def fit(
    rows: Sequence[tuple[np.ndarray, np.ndarray]], grades: Sequence[int], dims: int,
    epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1, seed: int = 7,
) -> Ordinal:
    """Fit on (indices, values) rows with whole-number grades.

    No row gives a model without grades, whose scores are zero; one grade alone gives a
    model that always expects it.
    """
    levels = sorted(set(int(g) for g in grades))
    k = len(levels)
    z, n, w = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    if k < 2:
        return Ordinal(levels, w, np.zeros(0))
    place = {g: i for i, g in enumerate(levels)}
    y = np.array([place[int(g)] for g in grades])
    share = np.array([(y <= i).mean() for i in range(k - 1)])
    share = np.clip(share, 1e-6, 1 - 1e-6)
    t = np.log(share / (1 - share))
    tn = np.ones(k - 1)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(y)):
            idx, val = rows[r]
            zi, ni = z[idx], n[idx]
            wi = -np.where(np.abs(zi) > l1, zi - np.sign(zi) * l1, 0.0) / ((beta + np.sqrt(ni)) / alpha + l2)
            s = float(wi @ val)
            g = y[r]
            upper = logistic(t[g] - s) if g < k - 1 else 1.0
            lower = logistic(t[g - 1] - s) if g > 0 else 0.0
            p = max(upper - lower, 1e-9)
            # d loss / d s of -log(upper - lower)
            gi = (1.0 - upper - lower) * val
            sigma = (np.sqrt(ni + gi * gi) - np.sqrt(ni)) / alpha
            z[idx] = zi + gi - sigma * wi
            n[idx] = ni + gi * gi
            if g < k - 1:
                d = -upper * (1 - upper) / p
                tn[g] += d * d
                t[g] -= 0.1 * d / np.sqrt(tn[g])
            if g > 0:
                d = lower * (1 - lower) / p
                tn[g - 1] += d * d
                t[g - 1] -= 0.1 * d / np.sqrt(tn[g - 1])
            for i in range(1, k - 1):
                t[i] = max(t[i], t[i - 1] + GAP)
    w = -np.where(np.abs(z) > l1, z - np.sign(z) * l1, 0.0) / ((beta + np.sqrt(n)) / alpha + l2)
    return Ordinal(levels, w, t)


def labelled_sample(labels: DataFrame, docs: DataFrame, grade, max_rows: int, text: str = "text") -> DataFrame:
    """(grade, text) of at most ``max_rows`` labelled ids, chosen by a hash of the id.

    Labels without a grade or id are left out; of several labels of one id the lowest grade
    counts. An id that many rows share brings all of them: callers bound the rows as well.
    """
    picked = (
        labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null")
        .groupBy("doc_id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("grade", "text")
