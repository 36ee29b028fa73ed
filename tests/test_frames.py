"""Zones, windows, tracks, scores and alerts on small hand-made scenes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import brute_cooldown, brute_tracks, overlap
from scenespark.operators import alerts as A, anomaly, cooldown, frames as FR, temporal as T, tracking as K, zones as Z
from scenespark.operators.ordering import with_hash_position, with_position, with_sorted_position
from scenespark.plans import session as S

DET = "feed_id long, frame_id long, det_id long, class_name string, confidence double, center_x double, center_y double"


def scene(spark, rows, n_frames=None, frame_ids=None, motion=None):
    """rows: (frame, class, cx, cy) -> (frames, detections) of feed 0."""
    dets = spark.createDataFrame(
        [(0, f, i, c, 0.8, x, y) for i, (f, c, x, y) in enumerate(rows)], DET
    ).withColumns({
        "x1": F.col("center_x") * 640 - 20, "y1": F.col("center_y") * 640 - 30,
        "x2": F.col("center_x") * 640 + 20, "y2": F.col("center_y") * 640 + 30,
        "width_norm": F.lit(40 / 640), "ts": F.timestamp_seconds(F.lit(43200) + F.col("frame_id")),
        "threat_level": F.when(F.col("class_name").isin("military_vehicle", "suspicious_object"), "critical").otherwise("low"),
    })
    ids = frame_ids or list(range(1, (n_frames or max(r[0] for r in rows)) + 1))
    frames = spark.createDataFrame([(0, i, motion) for i in ids], "feed_id long, frame_id long, motion_score double")
    return frames.withColumn("ts", F.timestamp_seconds(F.lit(43200) + F.col("frame_id"))).withColumn(
        "inference_ms", F.lit(100.0)), dets


def temporal(spark, rows, window=30, **kw):
    frames, dets = scene(spark, rows, **kw)
    facts = FR.frame_facts(frames, dets)
    obs = K.observations(dets, facts)
    return K.temporal_frames(T.window_stats(facts, window), K.track_facts(K.live_tracks(obs, frames))).cache()


def kinds(df):
    return {(r["frame_id"], r["alert_type"]): r for r in K.temporal_alerts(df).collect()}


def test_zone_edges_and_first_match(spark):
    _, d = scene(spark, [(1, "person", 0.5, 0.1), (1, "vehicle", 0.5, 0.25), (1, "person", 1.0, 0.5), (1, "ship", 0.5, 1.0)])
    got = {r["det_id"]: r for r in Z.assign_zones(d).collect()}
    assert [got[i]["zone_name"] for i in range(4)] == ["border_zone", "buffer_zone", None, None]
    assert got[0]["is_high_threat"] and got[0]["priority"] == "CRITICAL" and not got[1]["is_high_threat"]
    safe_first = [{"name": "s", "polygon": [(0, 0), (1, 0), (1, 1), (0, 1)], "level": "SAFE"},
                  {"name": "r", "polygon": [(0, 0), (1, 0), (1, 1), (0, 1)], "level": "RESTRICTED"}]
    rows = Z.assign_zones(d, safe_first).filter("zone_name IS NOT NULL").collect()
    assert {r["zone_name"] for r in rows} == {"s"} and not any(r["is_violation"] for r in rows)


def test_zone_table_per_feed(spark):
    _, d = scene(spark, [(1, "person", 0.5, 0.1)])
    other = d.withColumn("feed_id", F.lit(1).cast("bigint"))
    zones = Z.zone_table(spark).withColumn("feed_id", F.lit(0).cast("bigint"))
    got = {r["feed_id"]: r["zone_name"] for r in Z.join_zones(d.unionByName(other), zones).collect()}
    assert got == {0: "border_zone", 1: None}


def test_many_zones_equal_a_walk_over_them(spark):
    rng = random.Random(4)
    zones = []
    for i in range(200):
        # some far larger than the rest, so that they reach many cells
        x, y, w = rng.random(), rng.random(), rng.choice([0.01, 0.03, 0.4])
        zones.append({"name": f"z{i}", "polygon": [(x, y), (x + w, y), (x + w / 2, y + w)], "level": "BUFFER"})
    _, d = scene(spark, [(1, "person", rng.random() * 1.2 - 0.1, rng.random() * 1.2 - 0.1) for _ in range(400)])
    few = {r["det_id"]: None for r in d.collect()}
    for start in range(0, 200, 50):
        for r in Z.assign_zones(d, zones[start:start + 50]).collect():
            few[r["det_id"]] = few[r["det_id"]] or r["zone_name"]
    got = {r["det_id"]: r["zone_name"] for r in Z.assign_zones(d, zones).collect()}
    assert got == few and len(set(few.values())) > 20


def test_zone_risk_and_night(spark):
    frames, d = scene(spark, [(1, "person", 0.5, 0.1), (1, "person", 0.4, 0.1)], n_frames=2)
    f = FR.frame_facts(frames, Z.assign_zones(d), Z.zone_aggregates())
    r = Z.zone_risk(f).orderBy("frame_id").collect()
    # two restricted, both high threat, one extra in the same zone
    assert r[0]["zone_risk"] == pytest.approx(1.0) and r[1]["zone_risk"] == 0.0 and r[1]["max_severity"] == "SAFE"
    one = Z.assign_zones(d.filter("det_id = 0"))
    at_night = FR.frame_facts(frames.withColumn("ts", F.lit("2024-01-01 22:00:00").cast("timestamp")), one, Z.zone_aggregates())
    assert Z.zone_risk(at_night).filter("frame_id = 1").head()["zone_risk"] == pytest.approx(0.45 * 1.3)


def test_empty_frame_features(spark):
    frames, d = scene(spark, [(1, "person", 0.5, 0.1)], n_frames=2)
    r = FR.features(FR.frame_facts(frames, d)).filter("frame_id = 2").head()
    assert r["avg_center_x"] == 0.5 and r["detection_count"] == 0 and r["motion"] == 0.0


def test_burst_alerts_and_gradual_rise_does_not(spark):
    burst = [(6, "vehicle", 0.1 * i, 0.5) for i in range(1, 9)]
    assert (6, "sudden_appearance") in kinds(temporal(spark, burst))
    gradual = [(f, "vehicle", 0.09 * i, 0.9) for f in range(1, 11) for i in range(1, f)]
    assert not any(k == "sudden_appearance" for f, k in kinds(temporal(spark, gradual)) if f > 4)


def test_steady_scene_alerts_while_window_is_short(spark):
    steady = [(f, "vehicle", 0.15 * i, 0.5) for f in range(1, 9) for i in range(1, 6)]
    assert [f for f, k in sorted(kinds(temporal(spark, steady))) if k == "sudden_appearance"] == [3, 4]


def test_crowd_buildup(spark):
    ramp = [(f, "person", 0.1 * i, 0.6) for f in range(1, 11) for i in range(f - 1)]
    t = temporal(spark, ramp, window=15)
    assert t.filter("frame_id = 10").head()["detection_trend"] == pytest.approx(1.0)
    assert any(k == "crowd_buildup" for _, k in kinds(t))


def test_loitering_and_approach(spark):
    static = [(f, "person", 0.5, 0.5) for f in range(1, 16)]
    t = kinds(temporal(spark, static))
    assert min(f for f, k in t if k == "loitering") == 10 and not any(k == "approach_trajectory" for _, k in t)
    moving = [(f, "person", 0.05 * f, 0.5) for f in range(1, 16)]
    assert not any(k == "loitering" for _, k in kinds(temporal(spark, moving)))
    up = [(f, "person", 0.5, 0.9 - 0.04 * f) for f in range(1, 8)]
    a = kinds(temporal(spark, up))
    assert a[(3, "approach_trajectory")]["severity"] == "CRITICAL"
    down = [(f, "person", 0.5, 0.1 + 0.04 * f) for f in range(1, 8)]
    assert not any(k == "approach_trajectory" for _, k in kinds(temporal(spark, down)))


def test_coordinated_movement(spark):
    side = [(f, "vehicle", 0.1 + 0.02 * f, 0.2 + 0.25 * i) for f in range(1, 6) for i in range(3)]
    a = kinds(temporal(spark, side))
    assert (3, "coordinated_movement") in a
    assert a[(3, "coordinated_movement")]["description"].startswith("Coordinated movement: 3 objects")


def test_track_survives_gap_and_is_pruned(spark):
    rows = [(1, "person", 0.5, 0.5), (2, "person", 0.5, 0.5), (7, "person", 0.5, 0.5)]
    frames, d = scene(spark, rows, n_frames=9)
    obs = {r["frame_id"]: r["track_id"] for r in K.observations(d, FR.frame_facts(frames, d)).collect()}
    assert obs == {1: 0, 2: 0, 7: 0}
    late = [(1, "person", 0.5, 0.5), (8, "person", 0.5, 0.5)]
    frames, d = scene(spark, late, n_frames=9)
    assert [r["track_id"] for r in K.observations(d, FR.frame_facts(frames, d)).orderBy("frame_id").collect()] == [0, 1]
    # pruning needs a processed frame in between
    frames, d = scene(spark, late, frame_ids=[1, 8])
    assert [r["track_id"] for r in K.observations(d, FR.frame_facts(frames, d)).orderBy("frame_id").collect()] == [0, 0]


def random_scene(seed, frames=90, busy=0.9):
    rng, rows = random.Random(seed), []
    spots = [(rng.random(), rng.random()) for _ in range(6)]
    for f in range(1, frames + 1):
        if rng.random() < busy:
            for _ in range(rng.randint(0, 6)):
                # coarse positions make exact ties between tracks
                x, y = spots[rng.randrange(6)]
                rows.append((f, rng.choice(["person", "vehicle"]), round(x * 20) / 20 + rng.choice([0, 0.01, 0.02]), round(y * 20) / 20))
    return rows


@pytest.mark.parametrize("seed, skip, block", [(1, 1, 16384), (2, 3, 16384), (3, 1, 12), (4, 2, 9)])
def test_tracks_equal_brute_force(spark, seed, skip, block):
    rows = [r for r in random_scene(seed) if r[0] % skip == 0]
    ids = [i for i in range(1, 91) if i % skip == 0]
    frames, d = scene(spark, rows, frame_ids=ids)
    by_frame = {}
    for r in d.orderBy("frame_id", "det_id").collect():
        by_frame.setdefault(r["frame_id"], []).append((r["det_id"], (r["x1"], r["y1"], r["x2"], r["y2"])))
    want, live = brute_tracks(ids, by_frame)
    obs = K.observations(d, FR.frame_facts(frames, d), block).cache()
    assert {r["det_id"]: r["track_id"] for r in obs.collect()} == want
    got = {}
    for r in K.live_tracks(obs, frames).collect():
        got.setdefault(r["frame_id"], []).append(r["track_id"])
    assert {f: sorted(v) for f, v in got.items()} == {f: v for f, v in live.items() if v}


@pytest.mark.parametrize("block", [16384, 10])
def test_cooldown_equals_brute_force(spark, block):
    rng = random.Random(block)
    names, t, rows = ["crowd", "aircraft", "military_vehicle", "other"], 0, []
    for i in range(120):
        t += rng.choice([1, 5, 20, 50]) if i % 40 else 500
        rows.append((f"a{i:03d}", 0, i, t, "HIGH", [f"{c} seen" for c in rng.sample(names, rng.randint(1, 2))]))
    df = spark.createDataFrame(rows, "alert_id string, feed_id long, frame_id long, s long, priority string, reasons array<string>")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    known = {"crowd", "aircraft", "military_vehicle", "suspicious_object"}
    keys = [sorted({c.split()[0] for c in r[5]} & known) or ["generic"] for r in rows]
    want = brute_cooldown(list(zip([r[3] for r in rows], keys)), 45)
    got = {r["alert_id"]: r["notify"] for r in cooldown.notifications(df, 45, block).collect()}
    assert [got[r[0]] for r in rows] == want


def test_two_classes_one_hot_blocks_both(spark):
    rows = [("a", 0, 1, 0, "HIGH", ["crowd"]), ("b", 0, 2, 10, "HIGH", ["aircraft and crowd"]), ("c", 0, 3, 20, "HIGH", ["aircraft"])]
    df = spark.createDataFrame(rows, "alert_id string, feed_id long, frame_id long, s long, priority string, reasons array<string>")
    got = {r["alert_id"]: r["notify"] for r in cooldown.notifications(df.withColumn("ts", F.timestamp_seconds("s")), 45).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_boosts(spark):
    rows = [(1, "military_vehicle", 0.5, 0.5), (2, "suspicious_object", 0.5, 0.5), (3, "crowd", 0.5, 0.5),
            (4, "crowd", 0.2, 0.5), (4, "aircraft", 0.8, 0.5), (5, "vehicle", 0.5, 0.5)]
    frames, d = scene(spark, rows, motion=15.0)
    r = {x["frame_id"]: x for x in anomaly.score_frames(FR.frame_facts(frames, d)).collect()}
    assert r[1]["anomaly_score"] == pytest.approx(-0.23) and r[1]["alert_level"] == "critical"
    assert r[2]["anomaly_score"] == pytest.approx(-0.20) and r[2]["alert_level"] == "critical"
    assert r[3]["alert_level"] == "high" and "crowd with high motion" in r[3]["anomaly_reasons"]
    assert r[4]["anomaly_score"] == pytest.approx(-0.18) and r[5]["alert_level"] == "normal" and r[5]["anomaly_reasons"] == []
    assert "multiple threat classes: aircraft, crowd" in r[4]["anomaly_reasons"]


def test_session_baseline_then_scored(spark):
    rows = [(f, "vehicle", 0.15 * i, 0.7) for f in range(1, 41) for i in range(1, 6)] + [(40, "military_vehicle", 0.9, 0.1)]
    frames, d = scene(spark, rows, motion=5.0)
    table = S.frame_table(frames, d).cache()
    s = S.session_summary(table).head()
    assert (s["baseline_frames"], s["frames_scored"], s["model_fitted"], s["total_detections"]) == (30, 10, False, 201)
    alerts = S.alert_table(table).collect()
    assert [a["frame_id"] for a in alerts] == [40] and alerts[0]["priority"] == "CRITICAL"
    forest = S.frame_table(frames, d, S.Options(scoring="forest", trees=20))
    assert forest.filter("phase = 'scored' AND frame_id = 40").head()["alert_level"] == "critical"
    assert S.session_summary(forest).head()["model_fitted"]
    capped = S.frame_table(frames, d, S.Options(max_frames=12, frame_skip=2))
    assert [r["frame_id"] for r in capped.orderBy("frame_id").collect()] == list(range(2, 26, 2))


def test_frame_report_lists_every_scored_frame_of_long_feeds(spark):
    no_alerts = "cast(array() as array<struct<alert_type:string,severity:string,description:string,details:string>>)"
    table = spark.range(2 * 640).selectExpr(
        "id % 2 AS feed_id", "id div 2 + 1 AS frame_id", "3L AS detection_count", "-0.12345D AS anomaly_score",
        "'high' AS alert_level", "0.5D AS zone_risk", "'BUFFER' AS max_severity", "1L AS violation_count",
        "0D AS temporal_risk", f"{no_alerts} AS alerts", "0 AS tracked_objects", "0D AS detection_trend",
        "if(id div 2 < 30, 'baseline', 'scored') AS phase")
    listed = {(r["feed_id"], r["frame_id"]) for r in S.frame_report(table).collect()}
    assert S.frame_report(table).count() == 2 * 610 and listed == {(g, f) for g in (0, 1) for f in range(31, 641)}
    assert sorted(r["frame_id"] for r in S.frame_report(table, 7).filter("feed_id = 1").collect()) == list(range(31, 38))


def test_zone_critical_upgrades_level_but_not_counters(spark):
    rows = [(f, "vehicle", 0.5, 0.1) for f in range(31, 41)]
    frames, d = scene(spark, rows, n_frames=40)
    table = S.frame_table(frames, d).cache()
    s = S.session_summary(table).head()
    assert s["critical_frames"] == 0 and s["alerts_raised"] == 10 and s["zone_critical_count"] == 10
    a = S.alert_table(table).filter("frame_id = 35").head()
    assert a["alert_level"] == "critical" and a["reasons"][0].startswith("vehicle (80%) detected in Border Zone")


def test_positions_equal_row_number(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 2003).alias("k"),
                                  F.concat(F.lit("name_"), F.col("id") % 997, F.lit("_"), F.col("id")).alias("name"))
    from pyspark.sql import Window
    for got, order in (
        (with_position(df, ["g"], ["k"], F.floor(F.col("k") / 50), total="n"), ["k"]),
        (with_sorted_position(df, ["g"], "name", ranges=16, total="n"), ["name"]),
        (with_hash_position(df, ["g"], "name", 7, total="n"), [F.md5(F.concat("name", F.lit(":7")))]),
    ):
        w = Window.partitionBy("g").orderBy(*order)
        check = got.withColumn("want", F.row_number().over(w)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("g")))
        assert check.count() == 2000 and check.filter("pos <> want OR n <> size").count() == 0


def test_window_blocks_do_not_change_results(spark):
    rows = random_scene(9, 120)
    frames, d = scene(spark, rows, n_frames=120)
    frames = frames.withColumn("motion_score", F.when(F.col("frame_id") % 4 != 0, (F.col("frame_id") * 37 % 101) / 8.0))
    facts = FR.frame_facts(frames, d)
    a, b = T.window_stats(facts, 12), T.window_stats(facts, 12, block_rows=20)
    assert a.drop("ts").exceptAll(b.drop("ts")).count() == 0


def test_log_views(spark):
    rows = [(f"a{i}", i % 2, i, i, ["CRITICAL", "HIGH"][i % 2], [] if i == 9 else [f"r{i}"], i == 8) for i in range(10)]
    df = spark.createDataFrame(rows, "alert_id string, feed_id long, frame_id long, s long, priority string, reasons array<string>, notified boolean")
    df = df.withColumn("ts", F.timestamp_seconds("s")).withColumns({c: F.lit(0.0) for c in ("anomaly_score", "anomaly_prob", "motion_score")}).withColumn("detection_count", F.lit(1))
    assert [r["alert_id"] for r in A.recent_log(df, 3).collect()] == ["a7", "a8", "a9"]
    assert {r["alert_id"] for r in A.rolling_log(df, 2).collect()} == {"a9", "a8", "a7", "a6"}
    # the limit comes before the filter
    assert [r["alert_id"] for r in A.to_notify(df, 4).collect()] == ["a6"]
    shown = A.display_rows(df, ["HIGH"], 2).orderBy("frame_id").collect()
    assert [(r["time_str"], r["reason"]) for r in shown] == [("05:30:07", "r7"), ("05:30:09", "[]")]
    assert {r["priority"]: r["share_pct"] for r in A.priority_share(df).collect()} == {"CRITICAL": 50.0, "HIGH": 50.0, "MEDIUM": 0.0, "LOW": 0.0}
    assert all(r["share_pct"] == 0.0 for r in A.priority_share(df.filter("frame_id < 0")).collect())


def _boxes(spark, boxes):
    """boxes: (frame, x1, y1, x2, y2); frames 1, 4 and 9 were processed."""
    rows = [(1, b[0], i, *b[1:]) for i, b in enumerate(boxes)]
    det = spark.createDataFrame(rows, "feed_id long, frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
    return det, spark.createDataFrame([(1, f) for f in (1, 4, 9)], "feed_id long, frame_id long")


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.7, 1.0])
def test_adjacent_overlaps_of_boxes_of_all_sizes(spark, threshold):
    rng = random.Random(5)
    boxes = []
    for _ in range(300):
        w, h = 10 ** rng.uniform(-5, 3.5), 10 ** rng.uniform(-5, 3.5)
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        for frame in (1, 4, 9):
            dx, dy, k = rng.uniform(-.6, .6) * w, rng.uniform(-.6, .6) * h, rng.choice([1, 1, 0.55, 1.8])
            boxes.append((frame, x + dx, y + dy, x + dx + w * k, y + dy + h))
    boxes += [(1, 0.0, 0.0, 8.0, 8.0), (4, 0.0, 0.0, 8.0, 8.0), (4, 0.0, 0.0, 8.0, 8.0), (9, 8.0, 8.0, 0.0, 0.0),
              (9, 0.0, 0.0, 8.0, 0.0), (9, None, 0.0, 8.0, 8.0), (9, 0.0, 0.0, float("nan"), 8.0),
              (4, 0.0, 0.0, float("inf"), 8.0)]
    det, frames = _boxes(spark, boxes)
    before = {4: 1, 9: 4}
    def good(b):
        return b[1] is not None and 0 < b[3] - b[1] < math.inf and b[4] > b[2]
    want = {
        (i, j) for i, a in enumerate(boxes) if good(a) for j, b in enumerate(boxes)
        if good(b) and before.get(a[0]) == b[0] and overlap(a[1:], b[1:]) >= threshold}
    got = [(r["det_id"], r["prev_det_id"]) for r in T.pairwise_iou(det, frames, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 2


def test_a_crowd_of_small_boxes_does_not_meet_pairwise(spark):
    rng, n = random.Random(8), 20_000
    boxes = []
    for _ in range(n):
        x, y, w = rng.uniform(0, 150), rng.uniform(0, 150), rng.uniform(1, 3)
        boxes.append((1, x, y, x + w, y + 2))
        boxes.append((4, x + .3, y - .2, x + w, y + 2))
    boxes += [(f, 0.0, 0.0, 1900.0 + f, 1000.0) for f in (1, 4)]
    det, frames = _boxes(spark, boxes)
    # 20,000 boxes fit into one cell of 160 pixels: 400 million pairs there
    assert T.overlap_candidates(det, frames).count() < 100 * n
    own = T.pairwise_iou(det, frames).filter("det_id = prev_det_id + 1")
    assert own.count() >= 0.99 * n
    with pytest.raises(ValueError):
        T.pairwise_iou(det, frames, 0.0)
