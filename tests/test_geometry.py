import math

import pytest
from pyspark.sql import functions as F

from scenespark.functions import geometry as G, scores, sql, text
from scenespark.functions.numbers import exact_round, fixed, stored


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


@pytest.mark.parametrize("a, b, want", [
    ((0, 0, 10, 10), (0, 0, 10, 10), 1.0),
    ((0, 0, 10, 10), (20, 20, 30, 30), 0.0),
    ((0, 0, 10, 10), (0, 0, 5, 5), 0.25),
    ((0, 0, 0, 0), (0, 0, 0, 0), 0.0),
])
def test_iou(spark, a, b, want):
    assert one(spark, G.iou(tuple(map(float, a)), tuple(map(float, b))))[0] == want


SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.25), (0.0, 0.25)]
TRIANGLE = [(0.0, 0.0), (1.0, 0.0), (0.5, 1.0)]


@pytest.mark.parametrize("x, y, ring, want", [
    (0.5, 0.1, SQUARE, True), (0.5, 0.5, SQUARE, False), (0.0, 0.1, SQUARE, True), (1.0, 0.1, SQUARE, False),
    (0.5, 0.25, SQUARE, False), (0.5, 0.0, SQUARE, True), (0.5, 0.5, TRIANGLE, True), (0.05, 0.9, TRIANGLE, False),
])
def test_point_in_polygon_three_ways(spark, x, y, ring, want):
    sql.register(spark)
    arr = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring])
    r = one(spark, G.in_polygon(x, y, ring).alias("a"), G.in_polygon_array(x, y, arr).alias("b"),
            F.call_function("point_in_polygon", F.lit(x), F.lit(y), arr).alias("c"))
    assert (r["a"], r["b"], r["c"]) == (want, want, want)


def test_letterbox_of_wide_image(spark):
    box = G.letterbox_box(*map(F.lit, (0.5, 0.5, 0.2, 0.2)), 1280, 720)
    r = one(spark, *[c.alias(n) for n, c in box.items()])
    assert (r["cx"], r["cy"]) == (0.5, 0.5)
    assert math.isclose(r["w"], 0.2) and math.isclose(r["h"], 0.2 * 720 / 1280)


@pytest.mark.parametrize("side, want", [
    (300, [0]), (640, [0]), (641, [0, 1]), (1120, [0, 480]), (1600, [0, 480, 960]), (1700, [0, 480, 960, 1060]),
])
def test_tile_offsets(spark, side, want):
    assert one(spark, G.tile_offsets(F.lit(side)))[0] == want


def test_tiles_holding_equals_scan(spark):
    rows = [(s, c / 2.0) for s in (300, 641, 1120, 1700, 2719) for c in range(0, 2 * s, 37)]
    df = spark.createDataFrame(rows, "side int, c double")
    naive = F.filter(G.tile_offsets("side"), lambda t: (t <= F.col("c")) & (F.col("c") < t + 640))
    assert df.filter(G.tiles_holding("c", "side") != naive).count() == 0


def test_oriented_box(spark):
    r = one(spark, *[c.alias(n) for n, c in G.oriented_to_corners(
        F.array(*map(F.lit, (5.0, 1.0, 9.0, 4.0, 6.0, 8.0, 2.0, 5.0)))).items()])
    assert (r["xmin"], r["ymin"], r["xmax"], r["ymax"]) == (2.0, 1.0, 9.0, 8.0)


def test_box_validity_edges(spark):
    def ok(*v):
        return one(spark, G.box_is_valid(*map(F.lit, v)))[0]
    assert ok(0.5, 1.0, 1.0, 0.1) and not ok(0.0, 0.5, 0.1, 0.1) and not ok(0.5, 0.5, 1.01, 0.1)
    assert one(spark, G.label_is_valid(F.lit(0), *map(F.lit, (0.0, 1.0, 1.0, 0.1))))[0]
    assert not one(spark, G.label_is_valid(F.lit(7), *map(F.lit, (0.5, 0.5, 0.1, 0.1))))[0]


def test_rounding_agrees_with_python(spark):
    values = [k / 160 for k in range(1, 60)] + [0.125, 12.25, 12.35, -0.00625, 2.675, 1e-9, 123456.78905]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", exact_round("v", 4).alias("r"), stored("v", 4).alias("s"), fixed("v", 1).alias("t"))
    for r in df.collect():
        assert r["r"] == r["s"] == round(r["v"], 4)
        assert r["t"] == f"{r['v']:.1f}"


def test_scores(spark):
    s = F.lit(-0.18)
    r = one(spark, scores.alert_level(s).alias("a"), scores.alert_level(F.lit(-0.1801)).alias("b"),
            scores.anomaly_prob(F.lit(0.0)).alias("p"), scores.threat_label(F.lit(0.05)).alias("l"),
            scores.priority(F.lit("normal"), F.lit(8.0)).alias("q"), scores.priority(F.lit("normal"), F.lit(8.1)).alias("m"))
    assert tuple(r) == ("high", "critical", 0.5, "LOW", "LOW", "MEDIUM")


def test_texts(spark):
    r = one(spark,
            text.violation_reason(F.lit("person"), F.lit(0.87), F.lit("Gate"), F.lit(True)).alias("v"),
            text.sudden_text(F.lit(5.75), F.lit(0.5), F.lit(6)).alias("s"),
            text.cooldown_keys(F.array(F.lit("crowd gathering detected"), F.lit("x"))).alias("k"),
            text.cooldown_keys(F.array(F.lit("x"))).alias("g"))
    assert r["v"] == "person (87%) detected in Gate [HIGH THREAT]"
    assert r["s"] == "Sudden appearance: 5 new objects detected (was 0, now 6)"
    assert r["k"] == ["crowd"] and r["g"] == ["generic"]
