"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained by follow-the-regularised-leader with an L1 and an L2 penalty, the
temperature afterwards on texts the weights have not seen. Document frequencies come from
all training documents; the weights from a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common

DIMS = 1 << 15
ORDERS = (1, 2, 3)
# bound of the labelled sample the weights are fitted on; a fifth of it sets the temperature
MAX_LABELLED = 6_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, occurrences) of the hashed n-grams of a whole lower-cased text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0)
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(DIMS, np.int64)
    code = np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(chars):
            break
        code = (code[:len(chars) - n + 1] + chars[n - 1:] + np.uint32(n)) * np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        if n in ORDERS:
            total += np.bincount((code >> np.uint32(7)) & np.uint32(DIMS - 1), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMS x languages, sparse in value
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text)
        val = (1.0 + np.log(np.maximum(n, 1))) * self.idf[at]
        norm = np.sqrt(val @ val)
        return at, val / norm if norm else val

    def logits(self, at: np.ndarray, val: np.ndarray) -> np.ndarray:
        return val @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.vector(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(documents per feature, documents) over all rows; one partial sum per task leaves the executors."""
    common.prepare(docs.sparkSession)

    def partial(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                at, _ = counts(t)
                total[at] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([
            pa.array(np.concatenate(([-1], at)), pa.int64()), pa.array(np.concatenate(([n], total[at])), pa.int64())],
            names=["f", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(partial, "f long, n long").groupBy("f").agg(
        F.sum("n").alias("n")).collect()  # DIMS rows at most
    out, n = np.zeros(DIMS), 0
    for r in rows:
        if r["f"] < 0:
            n = r["n"]
        else:
            out[r["f"]] = r["n"]
    return out, n


def fit(
    docs: DataFrame, max_rows: int = MAX_LABELLED, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0,
    l1: float = 0.02, l2: float = 0.001, seed: int = 5,
) -> Model:
    """Fit on (doc_id, text, lang); null languages and null texts teach nothing.

    The sample is chosen by a hash of the id, at most ``max_rows`` documents. Without any
    the model knows no language and answers ``und``.
    """
    taught = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    frequency, n = document_frequencies(taught)
    picked = (
        taught.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_rows)
        .select("doc_id").distinct()
    )

    @F.pandas_udf("at binary, n binary")
    def packed(text: pd.Series) -> pd.DataFrame:
        got = [counts(t) for t in text]
        return pd.DataFrame({"at": [a.astype(np.int32).tobytes() for a, _ in got],
                             "n": [c.astype(np.int32).tobytes() for _, c in got]})

    rows = (
        taught.join(F.broadcast(picked), "doc_id").select("doc_id", "lang", packed("text").alias("x"))
        .select("lang", "x.at", "x.n").orderBy(F.xxhash64("at", "n", "lang"), "lang").limit(max_rows).collect()
    )
    languages = sorted({r.lang for r in rows})
    idf = np.log((1.0 + n) / (1.0 + frequency)) + 1.0
    k = len(languages)
    model = Model(languages, np.zeros((DIMS, k)), np.zeros(k), idf)
    if k < 2:
        return model
    place = {x: i for i, x in enumerate(languages)}
    data = []
    for r in rows:
        at = np.frombuffer(r.at, np.int32)
        val = (1.0 + np.log(np.maximum(np.frombuffer(r.n, np.int32), 1))) * idf[at]
        data.append((at, val / max(np.sqrt(val @ val), 1e-12), place[r.lang]))
    cut = max(1, len(data) // 5)
    held, train = data[:cut], data[cut:]
    z, m = np.zeros((DIMS, k)), np.zeros((DIMS, k))
    bz, bm = np.zeros(k), np.zeros(k)
    order = np.random.default_rng(seed)

    def solved(z, m):
        return -np.where(np.abs(z) > l1, z - np.sign(z) * l1, 0.0) / ((beta + np.sqrt(m)) / alpha + l2)

    for _ in range(epochs):
        for r in order.permutation(len(train)):
            at, val, y = train[r]
            w, b = solved(z[at], m[at]), -bz / ((beta + np.sqrt(bm)) / alpha + l2)
            g = softmax(val @ w + b)
            g[y] -= 1.0
            gw = val[:, None] * g[None, :]
            z[at] += gw - (np.sqrt(m[at] + gw * gw) - np.sqrt(m[at])) / alpha * w
            m[at] += gw * gw
            bz += g - (np.sqrt(bm + g * g) - np.sqrt(bm)) / alpha * b
            bm += g * g
    model.weights = solved(z, m)
    model.bias = -bz / ((beta + np.sqrt(bm)) / alpha + l2)
    logits = np.array([model.logits(at, val) for at, val, _ in held])
    truth = np.array([y for _, _, y in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(5.0), 60))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score (the calibrated probability).

    Null texts and texts without a letter are ``und`` with score 0. A text is read as a
    whole, however long; of equally likely languages the first in order counts; no rows give
    no rows. Repeated rows get the same answer; input columns named like a result give way to it.
    """
    common.prepare(docs.sparkSession)
    used = np.flatnonzero(np.abs(model.weights).sum(1))
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, used, model.weights[used], model.bias, model.idf, model.temperature))

    @F.pandas_udf("lang_pred string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, used, weights, bias, idf, temperature = shared.value
        dense = np.zeros((DIMS, len(languages)))
        dense[used] = weights
        m = Model(languages, dense, bias, idf, temperature)
        for batch in batches:
            yield pd.DataFrame([m.predict(t) for t in batch], columns=["lang_pred", "score"])

    name = common.tmp(docs, "_judged")
    out = docs.withColumn(name, judged(F.col(f"`{text}`")))
    return common.replaced(out, {"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).drop(name)


def held_out(ident: Column) -> Column:
    """The third of the ids that is never learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
