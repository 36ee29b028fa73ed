"""Zone sets as tables, against a plain walk over the zones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.operators import frames as FR, zones as Z
from scenespark.plans import session as S
from scenespark.sources import derived as D

LEVELS = ["RESTRICTED", "BUFFER", "OBSERVATION", "SAFE"]


def some_zones(n, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w = rng.random(), rng.random(), rng.choice([0.001, 0.01, 0.02, 0.05, 0.1] * 6 + [0.6])
        out.append({"name": f"z{i}", "polygon": [(x, y), (x + w, y), (x + w / 2, y + w)], "level": rng.choice(LEVELS)})
    return out


def inside(x, y, polygon):
    odd = False
    for (xi, yi), (xj, yj) in zip(polygon, polygon[-1:] + polygon[:-1]):
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi + 1e-12) + xi:
            odd = not odd
    return odd


def walk(zones, x, y):
    return next((z["name"] for z in zones if inside(x, y, z["polygon"])), None)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(6)
    rows = [(f % 2, f, i, rng.choice(["person", "vehicle"]), 0.5 + i / 1000, rng.random(), rng.random())
            for i, f in enumerate(rng.choices(range(1, 9), k=300))]
    # a crowd on one spot
    rows += [(0, 2, 300 + i, "person", 0.5, 0.31, 0.47) for i in range(50)]
    return spark.createDataFrame(
        rows, "feed_id long, frame_id long, det_id long, class_name string, confidence double, center_x double, center_y double"
    ).withColumn("ts", F.lit("2024-01-01 12:00:00").cast("timestamp")).cache()


def test_mixed_sizes_equal_a_walk(spark, points):
    zones = some_zones(2000)
    got = {r["det_id"]: r["zone_name"] for r in Z.assign_zones(points, zones).collect()}
    want = {r["det_id"]: walk(zones, r["center_x"], r["center_y"]) for r in points.collect()}
    assert got == want and len(set(want.values())) > 50


def test_points_outside_and_without_a_place(spark, points):
    zones = Z.zone_table(spark, some_zones(100))
    odd = points.limit(1).select(*[c for c in points.columns if c not in ("det_id", "center_x", "center_y")]).crossJoin(
        spark.createDataFrame([(1, None, 0.5), (2, -9e9, 9e9), (3, float("nan"), 0.5)], "det_id long, center_x double, center_y double"))
    assert [r["zone_name"] for r in Z.join_zones(odd, zones).collect()] == [None] * 3
    assert Z.join_zones(odd, zones.limit(0)).count() == 3
    assert Z.join_zones(odd.limit(0), zones).count() == 0


def test_hits_and_risk_are_those_of_the_zones_as_code(spark, points):
    zones = some_zones(40)
    frames = points.select("feed_id", "frame_id", "ts").distinct().withColumns(
        {"motion_score": F.lit(1.0), "inference_ms": F.lit(1.0)})
    det = points.withColumns({"width_norm": F.lit(0.1), "threat_level": F.lit("low")})
    code = Z.zone_risk(FR.frame_facts(frames, Z.assign_zones(det, zones), Z.zone_aggregates(zones)), zones)
    table = Z.zone_table(spark, zones)
    joined = Z.assign_zones(det, table)
    rows = Z.zone_risk(FR.frame_facts(frames, joined, Z.zone_aggregates(table)), table, hits=Z.zone_hits(joined))
    a, b = ({(r["feed_id"], r["frame_id"]): r for r in df.collect()} for df in (code, rows))
    assert a.keys() == b.keys()
    for key, r in a.items():
        assert b[key]["zone_scores"] == {k: n for k, n in r["zone_scores"].items() if n}
        for c in ("violation_count", "max_severity", "zone_risk", "zone_reasons"):
            assert b[key][c] == r[c], c
    x, y = ({r["feed_id"]: r for r in Z.zone_summary(df, z).collect()} for df, z in ((code, zones), (rows, table)))
    for feed, r in x.items():
        assert {k: n for k, n in r["violations_by_zone"].items() if n} == {
            k: n for k, n in y[feed]["violations_by_zone"].items() if n}
        assert (r["total_violations"], r["zones_defined"]) == (y[feed]["total_violations"], y[feed]["zones_defined"])


def test_hits_are_needed(spark, points):
    table = Z.zone_table(spark, some_zones(3))
    with pytest.raises(ValueError):
        Z.zone_risk(points, table)


def test_session_with_thousands_of_zones(spark, sf):
    zones = some_zones(2000)
    options = S.Options(zones=Z.zone_table(spark, zones))
    det = FR.build_detections(D.raw_detections(spark, sf)).filter("frame_id <= 40")
    frames = D.frames(spark, sf).filter("frame_id <= 40")
    table = S.frame_table(frames, det, options)
    hit = {}
    for r in det.select("feed_id", "frame_id", "center_x", "center_y").collect():
        name = walk(zones, r["center_x"], r["center_y"])
        if name:
            at = hit.setdefault((r["feed_id"], r["frame_id"]), {})
            at[name] = at.get(name, 0) + 1
    got = {(r["feed_id"], r["frame_id"]): r["zone_scores"] for r in table.select("feed_id", "frame_id", "zone_scores").collect()}
    assert {k: v for k, v in got.items() if v} == hit and len(got) == frames.count()
    safe = {z["name"] for z in zones if z["level"] == "SAFE"}
    total = sum(n for at in hit.values() for z, n in at.items() if z not in safe)
    assert S.session_summary(table).agg(F.sum("total_zone_violations")).head()[0] == total


def test_missing_fields_get_defaults(spark):
    zones = spark.createDataFrame([(0, "a", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "zone_order int, name string, polygon array<struct<x:double,y:double>>")
    r = Z.as_table(spark, zones).head()
    assert (r["level"], r["label"], r["color"]) == ("OBSERVATION", "a", "#ffffff")
    assert C.ZONE_LEVELS[r["level"]][0] == "MEDIUM"


@pytest.mark.parametrize("name", ["zone_table_risk", "zone_table_summary"])
def test_zones_are_not_sent_to_the_driver(spark, sf, name):
    """A zone table derived from a small file is no small table: its rows and cells are never broadcast."""
    from scenespark.plans import queries_frames  # noqa: F401
    from scenespark.plans.registry import QUERIES

    plan = re.sub(r"#\d+L?", "", QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString())
    for keys in ("feed_id, _level, _cx, _cy", "feed_id, name", "feed_id, _fx, _fy"):
        assert f"BroadcastHashJoin [{keys}]" not in plan
    assert "SortMergeJoin [feed_id, _level, _cx, _cy]" in plan
