"""The trained operators against slow statements of their updates, and on labels they have not seen."""

import math
import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from scenespark.llm import language_id, ordinal, quality_classifier, toxicity

LARGER = "/root/testdata/sf0.01"


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def solved(z, n, alpha, beta, l1, l2):
    return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)


def plain_ordinal(rows, grades, epochs, alpha, beta, l1, l2, seed):
    """Follow the regularised leader on -log(P(grade)), a feature at a time."""
    levels = sorted(set(grades))
    y = [levels.index(g) for g in grades]
    k, z, n = len(levels), {}, {}
    share = [min(max(sum(v <= i for v in y) / len(y), 1e-6), 1 - 1e-6) for i in range(k - 1)]
    t, tn = [math.log(s / (1 - s)) for s in share], [1.0] * (k - 1)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(y)):
            features, g = rows[r], y[r]
            w = {i: solved(z.get(i, 0.0), n.get(i, 0.0), alpha, beta, l1, l2) for i in features}
            s = sum(w[i] * v for i, v in features.items())
            upper = sigmoid(t[g] - s) if g < k - 1 else 1.0
            lower = sigmoid(t[g - 1] - s) if g > 0 else 0.0
            p = max(upper - lower, 1e-9)
            for i, v in features.items():
                step = (1 - upper - lower) * v
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + step - (math.sqrt(before + step * step) - math.sqrt(before)) / alpha * w[i]
                n[i] = before + step * step
            for at, d in ((g, -upper * (1 - upper) / p), (g - 1, lower * (1 - lower) / p)):
                if 0 <= at < k - 1:
                    tn[at] += d * d
                    t[at] -= 0.1 * d / math.sqrt(tn[at])
            for i in range(1, k - 1):
                t[i] = max(t[i], t[i - 1] + ordinal.GAP)
    return {i: solved(z[i], n[i], alpha, beta, l1, l2) for i in z}, t


@pytest.mark.parametrize("levels", [2, 4])
def test_ordinal_fit_is_the_slow_statement(levels):
    rng = np.random.default_rng(levels)
    rows = [{int(i): float(v) for i, v in zip(rng.choice(50, 6, replace=False), rng.random(6))} for _ in range(200)]
    grades = [int(min(levels - 1, sum(v for i, v in r.items() if i < 20))) * 3 for r in rows]
    want, t = plain_ordinal(rows, grades, 3, 0.4, 1.0, 0.2, 0.1, 11)
    packed = [(np.array(sorted(r)), np.array([r[i] for i in sorted(r)])) for r in rows]
    got = ordinal.fit(packed, grades, 50, epochs=3, alpha=0.4, beta=1.0, l1=0.2, l2=0.1, seed=11)
    assert got.grades == sorted(set(grades)) and got.thresholds == pytest.approx(t, abs=1e-9)
    assert {i: w for i, w in enumerate(got.weights) if w} == pytest.approx({i: w for i, w in want.items() if w}, abs=1e-9)
    for idx, val in packed[:20]:
        s = sum(want[int(i)] * v for i, v in zip(idx, val))
        tails = [sigmoid(s - x) for x in t]
        steps = [b - a for a, b in zip(got.grades, got.grades[1:])]
        expected = got.grades[0] + sum(a * b for a, b in zip(tails, steps))
        assert got.expected(np.array([got.score(idx, val)]))[0] == pytest.approx(expected, abs=1e-9)


def test_language_fit_is_the_slow_statement(spark):
    docs = spark.read.parquet(os.path.join(LARGER, "documents.parquet")).where("doc_id < 60").withColumn("text", F.substring("text", 1, 300))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    alpha, beta, l1, l2, seed = 2.0, 1.0, 0.02, 0.001, 5
    got = language_id.fit(docs, epochs=1, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=seed)
    texts = {r.doc_id: r for r in docs.collect()}
    held = {i: language_id.counts(r.text) for i, r in texts.items()}
    frequency = {}
    for at, _ in held.values():
        for f in at.tolist():
            frequency[f] = frequency.get(f, 0) + 1
    rows = spark.createDataFrame(
        [(texts[i].lang, at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()) for i, (at, n) in held.items()],
        "lang string, at binary, n binary").orderBy(F.xxhash64("at", "n", "lang"), "lang").collect()
    languages = sorted({r.lang for r in rows})
    data = []
    for r in rows:
        at, n = np.frombuffer(r.at, np.int32).tolist(), np.frombuffer(r.n, np.int32).tolist()
        x = {f: (1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + frequency[f])) + 1) for f, c in zip(at, n)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        data.append(({f: v / norm for f, v in x.items()}, languages.index(r.lang)))
    train = data[max(1, len(data) // 5):]
    k, z, m = len(languages), {}, {}
    bz, bm = [0.0] * k, [0.0] * k
    for r in np.random.default_rng(seed).permutation(len(train)):
        x, y = train[r]
        b = [-bz[c] / ((beta + math.sqrt(bm[c])) / alpha + l2) for c in range(k)]
        w = {(f, c): solved(z.get((f, c), 0.0), m.get((f, c), 0.0), alpha, beta, l1, l2) for f in x for c in range(k)}
        s = [b[c] + sum(w[f, c] * v for f, v in x.items()) for c in range(k)]
        e = [math.exp(v - max(s)) for v in s]
        for c in range(k):
            g = e[c] / sum(e) - (c == y)
            for f, v in x.items():
                step, before = g * v, m.get((f, c), 0.0)
                z[f, c] = z.get((f, c), 0.0) + step - (math.sqrt(before + step * step) - math.sqrt(before)) / alpha * w[f, c]
                m[f, c] = before + step * step
            bz[c] += g - (math.sqrt(bm[c] + g * g) - math.sqrt(bm[c])) / alpha * b[c]
            bm[c] += g * g
    assert got.languages == languages
    want = np.zeros((language_id.DIMS, k))
    for (f, c), v in z.items():
        want[f, c] = solved(v, m[f, c], alpha, beta, l1, l2)
    assert got.weights == pytest.approx(want, abs=1e-9)
    assert got.bias == pytest.approx([-bz[c] / ((beta + math.sqrt(bm[c])) / alpha + l2) for c in range(k)], abs=1e-9)


@pytest.fixture(scope="module")
def halves(spark):
    docs = spark.read.parquet(os.path.join(LARGER, "documents.parquet"))
    labels = spark.read.parquet(os.path.join(LARGER, "labels.parquet"))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs, labels.where(even), labels.where(~even)


def test_toxicity_of_unseen_documents(halves):
    docs, seen, unseen = halves
    got = toxicity.score(docs, toxicity.fit(docs, seen)).join(unseen.withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    truth = got.truth == 1
    accuracy, recall, false = (got.toxic == truth).mean(), got.toxic[truth].mean(), got.toxic[~truth].mean()
    print("toxicity, unseen:", len(got), accuracy, recall, false)
    # few toxic documents are labelled in half of this small table
    assert accuracy > 0.9 and recall > 0.35 and false < 0.03


def test_quality_of_unseen_documents(halves):
    docs, seen, unseen = halves
    got = quality_classifier.score(docs, quality_classifier.fit(docs, seen)).join(unseen, "doc_id").toPandas()
    kept = (got.kept == (got.quality == 1)).mean()
    grade = got.quality * (2 - got.toxic)
    hit = (got.expected_grade.round() == grade)
    print("quality, unseen:", len(got), kept, hit.mean(), hit[grade == 1].mean())
    # good but toxic is a grade of its own in the labels; form and words of a text do not tell it from good
    assert kept > 0.97 and hit[grade != 1].mean() > 0.95
