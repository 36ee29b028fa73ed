"""Toxicity: cumulative-link ordinal regression on sparse text features.

Every document gets an expected severity and the probability of each grade; one weight
vector is shared by all grades, the thresholds are ordered.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common, ordinal

DIMS = 1 << 20
# bound of the labelled sample the model is fitted on
MAX_LABELLED = 12_000
# a document is toxic from this probability of any severity above the lowest
TOXIC_FROM = 0.5
PREFIXES = (4, 5)
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_LETTER_START = re.compile(rb"[a-z\x80-\xff]")


def features(text: str | None) -> np.ndarray:
    """Sorted hashed features of a whole text: its words and the word beginnings.

    Every feature counts once however often it occurs, so the length of a text does not
    dilute a single slur. Null and empty texts have none.
    """
    if not text:
        return np.zeros(0, np.int32)
    words = set(_WORDS.findall(text.lower().encode("utf-8", "replace")))
    found = set(words)
    for size in PREFIXES:
        found.update(b"^" + w[:size] for w in words if len(w) > size)
    out = np.fromiter((zlib.crc32(f) & (DIMS - 1) for f in found), np.int32, len(found))
    return np.unique(out)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", max_rows: int = MAX_LABELLED) -> ordinal.Ordinal:
    """Fit on the whole texts of at most ``max_rows`` labelled documents.

    ``grade`` is a whole-number severity, 0 harmless; any number of grades will do.
    """

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(t).tobytes())

    common.prepare(docs.sparkSession)
    sample = ordinal.labelled_sample(labels, docs, F.col(grade), max_rows)
    got = sample.select("grade", packed("text").alias("x")).orderBy(F.xxhash64("x", "grade"), "grade").limit(max_rows).collect()
    found = [np.frombuffer(r.x, np.int32) for r in got]
    # every feature has the value 1; the rows share one array of them
    ones = np.ones(max(map(len, found), default=0))
    rows = [(idx, ones[:len(idx)]) for idx in found]
    return ordinal.fit(rows, [r.grade for r in got], DIMS, epochs=6, alpha=1.0, l1=4.0)


def score(docs: DataFrame, model: ordinal.Ordinal, toxic_from: float = TOXIC_FROM, text: str = "text") -> DataFrame:
    """Add severity (expected grade), p_toxic, tails (array, P(grade >= k)) and toxic.

    Null or empty text: no features, so the prior of the lowest grade decides. A model
    without grades (no labels) finds nothing toxic. A text is read as a whole, however long; no rows give no
    rows; a probability equal to the bound is toxic. Repeated rows are scored alike.
    Input columns named like a result give way to it.
    """
    common.prepare(docs.sparkSession)
    used = np.flatnonzero(model.weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds, model.grades))

    @F.pandas_udf("severity double, p_toxic double, tails array<double>")
    def judged(text: pd.Series) -> pd.DataFrame:
        used, weights, thresholds, grades = shared.value
        dense = np.zeros(DIMS)
        dense[used] = weights
        m = ordinal.Ordinal(grades, dense, thresholds)
        scores = np.array([dense[features(t)].sum() for t in text])
        tails = m.tails(scores)
        return pd.DataFrame({
            "severity": m.expected(scores),
            "p_toxic": tails[:, 0] if tails.shape[1] else np.zeros(len(scores)),
            "tails": list(tails),
        })

    name = common.tmp(docs, "_judged")
    out = docs.withColumn(name, judged(F.col(f"`{text}`")))
    got = common.replaced(out, {
        "severity": F.col(f"{name}.severity"), "p_toxic": F.col(f"{name}.p_toxic"), "tails": F.col(f"{name}.tails"),
        "toxic": F.col(f"{name}.p_toxic") >= F.lit(toxic_from),
    })
    return got.drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "severity", "p_toxic", "toxic")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: toxic documents go, the others pass with the columns of ``documents``, any more are dropped."""
    source = common.table(spark, sf_dir, "documents")
    model = fit(source, common.table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", "lang", "source", "n_chars"), model).where("not toxic").select(
        "doc_id", "text", "lang", "source", "n_chars")
