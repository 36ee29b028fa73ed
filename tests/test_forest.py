"""Forests of long baselines: bounded samples, exact quantiles, and path lengths walked by SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.operators import iforest


@pytest.fixture(scope="module")
def long_baseline(spark):
    """100,000 frames of one feed, 40 of another and too few of a third."""
    rows = spark.range(100_000).selectExpr("cast(0 as long) as feed_id", "id as frame_id").unionAll(
        spark.range(40).selectExpr("cast(1 as long)", "id")).unionAll(spark.range(29).selectExpr("cast(2 as long)", "id"))
    values = [(F.pmod(F.xxhash64("feed_id", "frame_id", F.lit(i)), F.lit(1000)) / 1000.0).cast("float").alias(c)
              for i, c in enumerate(C.FEATURES)]
    return rows.select("feed_id", "frame_id", *values).cache()


def test_samples_are_bounded_and_the_smallest_hashes(spark, long_baseline):
    keyed = long_baseline.withColumn("_key", F.concat_ws("_", "feed_id", "frame_id"))
    drawn = iforest.samples(keyed, trees=7)
    sizes = {(r["feed_id"], r["tree"]): r["count"] for r in drawn.groupBy("feed_id", "tree").count().collect()}
    assert sizes == {**{(0, t): C.FOREST_SAMPLE for t in range(7)}, (1, None): 40}
    # a bound that misses some is noticed
    again = iforest.samples(keyed, trees=7, ahead=0.5)
    both = [sorted(map(tuple, d.filter("feed_id = 0").select("tree", "frame_id").collect())) for d in (drawn, again)]
    assert both[0] == both[1]
    rows = keyed.filter("feed_id = 0").withColumn("h", F.xxhash64("feed_id", "_key", F.lit(3), F.lit(C.SEED)).bitwiseAND(F.lit((1 << 62) - 1)))
    want = sorted(r["frame_id"] for r in rows.orderBy("h").limit(C.FOREST_SAMPLE).collect())
    assert sorted(r["frame_id"] for r in drawn.filter("feed_id = 0 AND tree = 3").collect()) == want


@pytest.mark.parametrize("few", [50, 4096])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(3)
    groups = {
        0: -rng.random(5000), 1: np.full(3000, -0.25), 2: np.repeat([-0.5, -0.1], [10, 4000]), 3: np.array([-0.3]),
        4: -0.4 - 1e-13 * rng.integers(0, 50, 2000), 5: np.concatenate((np.zeros(20), np.full(20, -1.0))),
    }
    df = spark.createDataFrame([(f, float(v)) for f, vs in groups.items() for v in vs], "feed_id long, score double").repartition(5)
    for share in (0.05, 1.0):
        got = {r["feed_id"]: r["offset"] for r in iforest.quantiles(df, share, few=few).collect()}
        assert got == {f: pytest.approx(np.quantile(v, share), abs=1e-15) for f, v in groups.items()}
    assert iforest.quantiles(df.limit(0), 0.5).count() == 0


def test_long_baseline_has_the_wanted_share_of_anomalies(spark, long_baseline):
    model = iforest.fit(long_baseline, trees=10, contamination=0.05).cache()
    rows = {r["feed_id"]: r for r in model.drop("nodes").collect()}
    assert set(rows) == {0, 1} and rows[0]["n_train"] == 100_000 and rows[0]["sample_size"] == 256 and rows[1]["sample_size"] == 40
    s = iforest.score(long_baseline, model)
    share = {r["feed_id"]: r["x"] for r in s.groupBy("feed_id").agg(F.avg((F.col("model_score") < 0).cast("int")).alias("x")).collect()}
    assert share[0] == pytest.approx(0.05, abs=1e-4) and set(share) == {0, 1}
    blocks = iforest.score(long_baseline, model, block_rows=500)
    assert blocks.exceptAll(s).count() == 0 and blocks.count() == s.count()


def test_one_forest_of_all_feeds_uses_every_frame(spark, long_baseline):
    model = iforest.fit(long_baseline, trees=5, scope="global")
    r = model.head()
    assert (r["feed_id"], r["n_train"], r["sample_size"]) == (-1, 100_069, 256)
    assert iforest.score(long_baseline, model, scope="global").count() == 100_069


def test_path_lengths_are_those_of_a_recursive_walk(spark, long_baseline):
    model = iforest.fit(long_baseline, trees=6).cache()
    some = long_baseline.filter("frame_id < 60")
    nodes = iforest.nodes(model).toPandas()  # noqa: F841  read by the statement below
    frames = some.toPandas()  # noqa: F841
    value = "CASE n.feature " + " ".join(f"WHEN {i} THEN f.{c}" for i, c in enumerate(C.FEATURES)) + " END"
    walked = duckdb.sql(f"""
        WITH RECURSIVE walk AS (
          SELECT f.feed_id, f.frame_id, n.tree, n.node, n.feature, n.depth, n.sample_size, n.offset
          FROM frames f JOIN nodes n ON n.feed_id = f.feed_id AND n.node = n.tree
          UNION ALL
          SELECT w.feed_id, w.frame_id, c.tree, c.node, c.feature, c.depth, c.sample_size, c.offset
          FROM walk w JOIN nodes n ON n.feed_id = w.feed_id AND n.node = w.node
          JOIN frames f ON f.feed_id = w.feed_id AND f.frame_id = w.frame_id
          JOIN nodes c ON c.feed_id = w.feed_id AND c.node = CASE WHEN {value} > n.threshold THEN n."right" ELSE n."left" END
          WHERE w.feature >= 0)
        SELECT feed_id, frame_id, avg(depth) AS depth, any_value(sample_size) AS size, any_value("offset") AS off
        FROM walk WHERE feature < 0 GROUP BY 1, 2""").fetchall()
    got = {(r["feed_id"], r["frame_id"]): r["model_score"] for r in iforest.score(some, model).collect()}
    assert len(walked) == len(got)
    for feed, frame, depth, size, off in walked:
        norm = float(iforest.average_path([size])[0])
        assert got[feed, frame] == pytest.approx(-(2.0 ** (-depth / norm)) - off, abs=1e-12)
