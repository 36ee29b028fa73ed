"""Classifiers per feed: splits against brute force, labels, folds, and feeds that cannot be trained."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.operators import feed_forest as FF

SCHEMA = "feed_id long, frame_id long, label_text string, " + ", ".join(f"{c} float" for c in C.FEATURES)


def rows_of(spark, label, feeds=(0, 1), n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for feed in feeds:
        for i in range(n):
            x = [float(rng.randrange(12)) for _ in C.FEATURES]
            rows.append((feed, i, label(feed, i, x), *x))
    return spark.createDataFrame(rows, SCHEMA)


def gini_gain(left, right):
    def impurity(c):
        return 1 - sum((k / sum(c)) ** 2 for k in c)
    whole = [a + b for a, b in zip(left, right)]
    n = sum(whole)
    return impurity(whole) - sum(left) / n * impurity(left) - sum(right) / n * impurity(right)


def test_splits_are_the_best_of_their_candidates(spark):
    df = rows_of(spark, lambda f, i, x: ["LOW", "HIGH", "MEDIUM"][int(x[2] > 4) + int(x[f] > 7)])
    told, _ = FF.binned(df, 7, 0)
    nodes = {(r["feed_id"], r["model"], r["tree"], r["node"]): r for r in FF.grown(told, 3, 3, 7, 0).collect()}
    weighed = told.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({
        "model": F.lit(0), "w": FF._weight(FF._uniform("feed_id", "frame_id", F.lit(0), "tree", F.lit(7)))}).filter("w > 0").collect()
    drawn = spark.createDataFrame([k for k in nodes], "feed_id long, model int, tree int, node int").select(
        *FF.NODE, F.transform(F.slice(F.array_sort(F.array(*[
            F.struct(F.xxhash64(*FF.NODE, F.lit(i), F.lit(9)).alias("h"), F.lit(i).alias("i")) for i in range(len(C.FEATURES))])),
            1, FF.CANDIDATES), lambda s: s["i"]).alias("features")).collect()
    features = {tuple(r)[:4]: r["features"] for r in drawn}
    inner = 0
    for key, node in nodes.items():
        feed, _, tree, number = key
        here = []
        for r in weighed:
            if (r["feed_id"], r["tree"]) == (feed, tree):
                at = 1
                while at != number and at in {k[3] for k in nodes if k[:3] == key[:3]} and nodes[feed, 0, tree, at]["feature"] >= 0:
                    n = nodes[feed, 0, tree, at]
                    at = 2 * at + (r["bins"][n["feature"]] > n["bin"])
                if at == number:
                    here.append(r)
        counts = [sum(r["w"] for r in here if r["label"] == k) for k in range(FF.CLASSES)]
        assert counts == [node[c] for c in FF.COUNTS]
        if number >= 8:
            assert node["feature"] == -1
            continue
        best = 0.0
        for f, b in itertools.product(features[key], range(FF.BINS)):
            left = [sum(r["w"] for r in here if r["label"] == k and r["bins"][f] <= b) for k in range(FF.CLASSES)]
            right = [c - x for c, x in zip(counts, left)]
            if sum(left) and sum(right):
                best = max(best, gini_gain(left, right))
        assert node["gain"] == pytest.approx(best if best > 1e-12 else 0.0, abs=1e-9)
        inner += node["feature"] >= 0
    assert inner > 6


def test_each_feed_learns_its_own_rule(spark, tmp_path):
    df = rows_of(spark, lambda f, i, x: "HIGH" if (x[0] > 5) == (f == 0) else "LOW", n=150)
    model = FF.fit(df, trees=40, depth=6).cache()
    for r in model.collect():
        assert r["labels"] == ["HIGH", "LOW"] and r["n_samples"] == 150 and r["accuracy"] > 0.97 and r["cv_accuracy"] > 0.85
    fresh = rows_of(spark, lambda f, i, x: "HIGH" if (x[0] > 5) == (f == 0) else "LOW", n=200, seed=5)
    FF.save(model, str(tmp_path / "m"))
    got = FF.classify(fresh, FF.load(spark, str(tmp_path / "m"))).collect()
    assert len(got) == 400 and sum(r["threat_label"] == r["label_text"] for r in got) > 360
    assert all(abs(sum(r["threat_proba"].values()) - 1) < 1e-3 for r in got)


def test_feeds_that_cannot_be_trained(spark):
    few = rows_of(spark, lambda f, i, x: "LOW" if f == 0 else ["HIGH", "LOW"][i % 2], feeds=(0, 1), n=6)
    model = FF.fit(few, trees=5, depth=3).cache()
    by_feed = {r["feed_id"]: r for r in model.collect()}
    assert by_feed[0]["nodes"] is None and by_feed[0]["accuracy"] == 1.0 and by_feed[0]["labels"] == ["LOW"]
    assert by_feed[1]["cv_accuracy"] is None and by_feed[1]["nodes"]
    frames = few.unionByName(rows_of(spark, lambda f, i, x: "LOW", feeds=(2,), n=3))
    got = FF.classify(frames, model).collect()
    assert {r["threat_label"] for r in got if r["feed_id"] == 0} == {"LOW"}
    assert {(r["threat_label"], len(r["threat_proba"])) for r in got if r["feed_id"] == 2} == {("UNKNOWN", 0)}
    assert FF.classify(frames, FF.fit(few.limit(0))).filter("threat_label <> 'UNKNOWN'").count() == 0


def test_blocks_of_frames_change_nothing(spark, monkeypatch):
    df = rows_of(spark, lambda f, i, x: "HIGH" if x[3] > 5 else "LOW")
    model = FF.fit(df, trees=5, depth=4, folds=0).cache()
    a = FF.classify(df, model).select("feed_id", "frame_id", "threat_label", F.to_json("threat_proba").alias("p"))
    monkeypatch.setattr(FF, "LABELLED_ROWS", 7)
    monkeypatch.setattr(FF, "WALKED", 3)
    b = FF.classify(df, model).select("feed_id", "frame_id", "threat_label", F.to_json("threat_proba").alias("p"))
    assert a.exceptAll(b).count() == 0 and b.count() == 120


def test_weights_are_a_bootstrap(spark):
    u = spark.range(200_000).select(FF._weight(FF._uniform("id", F.lit(1))).alias("w"))
    r = u.agg(F.avg("w"), F.avg((F.col("w") == 0).cast("int"))).head()
    assert r[0] == pytest.approx(1.0, abs=0.01) and r[1] == pytest.approx(0.368, abs=0.01)


def test_one_group_grows_what_levels_grow(spark, monkeypatch):
    df = rows_of(spark, lambda f, i, x: ["LOW", "HIGH", "MEDIUM"][int(x[2] > 4) + int(x[f] > 7)]).unionByName(
        rows_of(spark, lambda f, i, x: ["HIGH", "LOW"][i % 2], feeds=(7,), n=6)).cache()

    def of():
        return {r["feed_id"]: r.asDict(recursive=True) for r in FF.fit(df, trees=3, depth=3, folds=3).collect()}

    together = of()
    monkeypatch.setattr(FF, "TOGETHER", 0)
    assert together == of() and all(r["nodes"] for r in together.values())


def test_hashes_are_those_of_the_engine(spark):
    rows = spark.range(-3, 40).select("id", F.xxhash64(F.col("id") * (1 << 55), F.col("id").cast("int"), F.lit(-9)).alias("h")).collect()
    for r in rows:
        wide = (r["id"] << 55) % (1 << 64)
        wide -= (wide >> 63) << 64
        h = FF._hashed(FF._hashed(FF._hashed(42, wide, 8), r["id"], 4), -9, 4)
        assert int(h.astype("int64")) == r["h"]
