"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Hashed text features share one weight vector across the ordered thresholds; documents are
selected by expected grade or by the probability of reaching a grade.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common, ordinal

DIMS = 1 << 16
# bound of the labelled sample the model is fitted on
MAX_LABELLED = 12_000
# a document is selected from this probability of a grade above the lowest
KEEP_FROM = 0.5
_SPACE = re.compile(rb"[\x09-\x0d\x20]+")
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _classes() -> bytes:
    """Letters become a or A, digits 0, bytes of other scripts a; the rest stays."""
    out = bytearray(range(256))
    for b in range(256):
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            out[b] = ord("a")
        elif "A" <= c <= "Z":
            out[b] = ord("A")
        elif "0" <= c <= "9":
            out[b] = ord("0")
    return bytes(out)


_CLASS = _classes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text.

    Word forms (letter case, digits, attached symbols) and words as the square root of
    their share, repeated neighbours and repeated lines as shares. Null and empty texts,
    and texts of white space, have one feature that says so.
    """
    raw = (text or "").encode("utf-8", "replace")
    words = [w for w in _SPACE.split(raw) if w]
    if not words:
        return np.array([zlib.crc32(b"empty") & (DIMS - 1)], np.int32), np.ones(1, np.float32)
    n = len(words)
    counts: Counter = Counter()
    for form, k in Counter(_SPACE.split(raw.translate(_CLASS))).items():
        if form:
            counts[b"f:" + _RUN.sub(rb"\1", form)[:12]] += k
    for w, k in Counter(_WORD.findall(raw.lower())).items():
        counts[b"w:" + w] += k
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = {f: (k / n) ** 0.5 for f, k in counts.items()}
    shares[b"s:neighbours"] = 3.0 * (same / n) ** 0.5
    shares[b"s:lines"] = 1.0 - len(set(lines)) / len(lines)
    shares[b"s:length%d" % min(int(np.log2(n)), 12)] = 0.3
    idx = np.fromiter((zlib.crc32(f) & (DIMS - 1) for f in shares), np.int64, len(shares))
    cells, at = np.unique(idx, return_inverse=True)
    return cells.astype(np.int32), np.bincount(at, list(shares.values())).astype(np.float32)


def rating() -> Column:
    """Grades of the label table: 0 poor, 1 good but toxic, 2 good and clean."""
    return F.col("quality") * (F.lit(2) - F.coalesce(F.col("toxic"), F.lit(0)))


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, max_rows: int = MAX_LABELLED) -> ordinal.Ordinal:
    """Fit on the whole texts of at most ``max_rows`` labelled documents; ``grade`` is a whole number."""

    @F.pandas_udf("idx binary, val binary")
    def packed(text: pd.Series) -> pd.DataFrame:
        got = [features(t) for t in text]
        return pd.DataFrame({"idx": [i.tobytes() for i, _ in got], "val": [v.tobytes() for _, v in got]})

    common.prepare(docs.sparkSession)
    sample = ordinal.labelled_sample(labels, docs, rating() if grade is None else grade, max_rows)
    got = (
        sample.select("grade", packed("text").alias("x")).select("grade", "x.idx", "x.val")
        .orderBy(F.xxhash64("idx", "val", "grade"), "grade").limit(max_rows).collect()
    )
    rows = [(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32).astype(float)) for r in got]
    return ordinal.fit(rows, [r.grade for r in got], DIMS, epochs=6, alpha=0.5, l1=0.05)


def score(docs: DataFrame, model: ordinal.Ordinal, keep_from: float = KEEP_FROM, text: str = "text") -> DataFrame:
    """Add expected_grade, tails (array, P(grade >= k)), p_good (the first tail) and kept.

    Null and empty texts are scored by their own feature. A model without grades (no
    labels) keeps all. A text is read as a whole, however long; no rows give no rows; a
    probability equal to the bound keeps. Repeated rows are scored alike; input columns
    named like a result give way to it.
    """
    common.prepare(docs.sparkSession)
    used = np.flatnonzero(model.weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds, model.grades))

    @F.pandas_udf("expected_grade double, p_good double, tails array<double>")
    def judged(text: pd.Series) -> pd.DataFrame:
        used, weights, thresholds, grades = shared.value
        dense = np.zeros(DIMS)
        dense[used] = weights
        m = ordinal.Ordinal(grades, dense, thresholds)
        scores = np.array([m.score(*features(t)) for t in text])
        tails = m.tails(scores)
        return pd.DataFrame({
            "expected_grade": m.expected(scores),
            "p_good": tails[:, 0] if tails.shape[1] else np.ones(len(scores)),
            "tails": list(tails),
        })

    name = common.tmp(docs, "_judged")
    out = docs.withColumn(name, judged(F.col(f"`{text}`")))
    got = common.replaced(out, {
        "expected_grade": F.col(f"{name}.expected_grade"), "p_good": F.col(f"{name}.p_good"),
        "tails": F.col(f"{name}.tails"), "kept": F.col(f"{name}.p_good") >= F.lit(keep_from),
    })
    return got.drop(name)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "expected_grade", "p_good", "tails", "kept")
