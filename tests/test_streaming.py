"""Streams replay the derived tables in several micro-batches and must equal batch."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from scenespark.operators import alerts as A, cooldown, frames as FR, iforest, temporal as T, tracking as K, zones as Z
from scenespark.sources import derived as D, records
from scenespark.streaming import live, phases

BATCHES = 4


@pytest.fixture(scope="module")
def replay(spark, sf, tmp_path_factory):
    """Frame records of all feeds written as JSON, one file per span of frames."""
    root = tmp_path_factory.mktemp("frames")
    det = FR.build_detections(D.raw_detections(spark, sf))
    frames = D.frames(spark, sf)
    nested = FR.nested_frames(frames, det.drop("ts"))
    row = F.to_json(F.struct(
        "feed_id", "frame_id", (F.unix_micros("ts") / 1e6).alias("timestamp"), "motion_score", "inference_ms",
        F.transform("detections", lambda d: F.struct(
            d["det_id"].alias("det_id"), d["class_id"].alias("class_id"), d["class_name"].alias("class_name"),
            d["confidence"].alias("confidence"), F.array(d["x1"], d["y1"], d["x2"], d["y2"]).alias("bbox"),
            d["center_x"].alias("center_x"), d["center_y"].alias("center_y"), d["width_norm"].alias("width_norm"),
            d["height_norm"].alias("height_norm"), d["area_norm"].alias("area_norm"),
            d["threat_level"].alias("threat_level"))).alias("detections"),
    ))
    rows = nested.select("frame_id", row.alias("j")).orderBy("frame_id").collect()
    step = len(rows) // BATCHES + 1
    for b in range(BATCHES):
        part = rows[b * step:(b + 1) * step]
        file = root / f"part-{b}.json"
        file.write_text("\n".join(r["j"] for r in part) + "\n")
        # the file source reads in order of modification time
        os.utime(file, (1_700_000_000 + b, 1_700_000_000 + b))
    return str(root), frames, det


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    x, y = a.select(cols), b.select(cols)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0
    assert x.count() > 0


def test_batch_records_equal_tables(spark, replay):
    path, frames, det = replay
    f, d = records.split_frames(records.read_frames(spark, path))
    same(f.select("feed_id", "frame_id", "motion_score"), frames.select("feed_id", "frame_id", "motion_score"))
    same(d.select("det_id", "center_x", "x1", "class_name"), det.select("det_id", "center_x", "x1", "class_name"))


def test_violation_stream(spark, replay):
    path, _, det = replay
    got = drain(live.violation_stream(live.read_frame_stream(spark, path, 1)), "violations")
    same(got.drop("ts"), Z.violations(Z.assign_zones(det)).drop("ts"))


def test_violation_stream_with_a_zone_table(spark, sf, replay):
    path, _, det = replay
    zones = D.zone_sets(spark, sf)
    got = drain(live.violation_stream(live.read_frame_stream(spark, path, 1), zones), "table_violations")
    same(got.drop("ts"), Z.violations(Z.assign_zones(det, zones)).drop("ts"))


def test_feature_stream(spark, replay):
    path, frames, det = replay
    got = drain(live.feature_stream(live.read_frame_stream(spark, path, 1)), "features")
    want = FR.features(FR.frame_facts(frames, det))
    j = got.alias("g").join(want.alias("w"), ["feed_id", "frame_id"])
    assert j.count() == want.count()
    from scenespark import constants as C
    far = [F.abs(F.col(f"g.{c}") - F.col(f"w.{c}")) > 1e-6 for c in C.FEATURES]
    assert j.filter(F.array_max(F.array(*far))).count() == 0


def test_temporal_stream_equals_batch(spark, replay):
    path, frames, det = replay
    facts = FR.frame_facts(frames, det)
    batch = K.temporal_frames(T.window_stats(facts), K.track_facts(K.live_tracks(K.observations(det, facts), frames)))
    got = drain(live.temporal_stream(live.read_frame_stream(spark, path, 1)), "temporal")
    cols = ["feed_id", "frame_id", "window_size", "detection_trend", "motion_trend", "tracked_objects",
            "approaching_count", "loitering_count", "alerts", "temporal_reasons",
            F.round("temporal_risk", 9).alias("temporal_risk")]
    same(got.select(cols), batch.select(cols))


def test_late_frames_are_counted(spark, tmp_path):
    def frame(i):
        return json.dumps({"feed_id": 1, "frame_id": i, "timestamp": float(i), "detections": []})

    (tmp_path / "a.json").write_text("\n".join(frame(i) for i in (1, 2, 5)))
    q = live.temporal_stream(live.read_frame_stream(spark, str(tmp_path), 1)).writeStream.format("memory").queryName(
        "late").outputMode("append").start()
    q.processAllAvailable()
    (tmp_path / "b.json").write_text("\n".join(frame(i) for i in (3, 4, 6)))
    q.processAllAvailable()
    q.stop()
    rows = {r["frame_id"]: r["late_frames"] for r in spark.table("late").collect()}
    assert rows == {1: 0, 2: 0, 5: 0, 6: 2}


def _empty_frames(path, frames):
    path.write_text("\n".join(
        json.dumps({"feed_id": 1, "frame_id": i, "timestamp": float(i), "detections": []}) for i in frames))


@pytest.mark.parametrize("ttl_ms, sizes", [(1500, {1: 1, 2: 2, 5: 3, 3: 1, 4: 2, 6: 3}), (600_000, {1: 1, 2: 2, 5: 3, 6: 4})])
def test_idle_feeds_are_forgotten(spark, tmp_path, ttl_ms, sizes):
    (tmp_path / "in").mkdir()
    _empty_frames(tmp_path / "in" / "a.json", (1, 2, 5))
    stream = live.temporal_stream(live.read_frame_stream(spark, str(tmp_path / "in"), 1), ttl_ms=ttl_ms)
    name = f"idle{ttl_ms}"
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()

    def wait_for(n):
        # with processing time the query runs batches without input too, so it never counts as done
        until = time.monotonic() + 60
        while spark.table(name).count() < n and q.isActive and time.monotonic() < until:
            time.sleep(0.5)

    try:
        wait_for(3)
        time.sleep(3)
        _empty_frames(tmp_path / "in" / "b.json", (3, 4, 6))
        wait_for(len(sizes))
    finally:
        q.stop()
    assert {r["frame_id"]: r["window_size"] for r in spark.table(name).collect()} == sizes


def test_tracker_state_has_a_schema(spark, replay, tmp_path):
    path, frames, det = replay
    stream = live.tracked_stream(live.read_frame_stream(spark, path, 1))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    def state(name):
        return spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", name).load()

    counters = state("counters").select("key.feed_id", "value.*")
    assert {r["feed_id"]: r["pos"] for r in counters.collect()} == {
        r["feed_id"]: r["count"] for r in frames.groupBy("feed_id").count().collect()}
    live_tracks = state("tracks").groupBy("key.feed_id").count()
    last = spark.read.parquet(str(tmp_path / "o")).groupBy("feed_id").agg(F.max_by(F.size("tracks"), "frame_id").alias("n"))
    assert {r["feed_id"]: r["count"] for r in live_tracks.collect()} == {
        r["feed_id"]: r["n"] for r in last.collect() if r["n"]}
    assert state("held_rows").count() == 0


def test_few_rows_held_at_once(spark, replay):
    path, _, _ = replay
    whole = drain(live.temporal_stream(live.read_frame_stream(spark, path)), "held_all")
    runs = drain(live.temporal_stream(live.read_frame_stream(spark, path), held=7), "held_few")
    cols = [c for c in whole.columns if c != "late_frames"]
    same(runs.select(cols), whole.select(cols))


def _alerts(spark, n=40):
    classes = ["crowd", "aircraft", "military_vehicle", "nothing"]
    rows = [(f"a{i}", i % 2, i, 1_700_000_000 + i * 13, "CRITICAL" if i % 3 else "HIGH", [f"{classes[i % 4]} seen"])
            for i in range(n)]
    df = spark.createDataFrame(rows, "alert_id string, feed_id long, frame_id long, s long, priority string, reasons array<string>")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_notification_stream(spark, tmp_path):
    alerts = _alerts(spark)
    want = {r["alert_id"]: r["notify"] for r in cooldown.notifications(alerts, 60).collect()}
    for part in range(3):
        alerts.filter((F.col("frame_id") >= part * 15) & (F.col("frame_id") < part * 15 + 15)).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["alert_id"]: r["notify"] for r in drain(live.notification_stream(s, 60, held=4), "notes").collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_hourly_stream(spark, tmp_path):
    alerts = _alerts(spark, 200)
    alerts.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "in"))
    same(drain(live.hourly_stream(s), "hourly", "complete"), A.hourly(alerts))


def _score_all(spark, stream, root, **how):
    q = phases.start_scoring(stream, f"{root}/scores", f"{root}/state", trees=20, **how)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return phases.scores(spark, f"{root}/scores")


def _same_scores(got, want):
    assert got.count() == want.count() > 0
    j = got.alias("g").join(want.alias("w"), ["feed_id", "frame_id"])
    assert j.count() == want.count()
    assert j.filter(F.abs(F.col("g.model_score") - F.col("w.model_score")) > 1e-6).count() == 0


def test_baseline_then_score(spark, replay, tmp_path):
    path, frames, det = replay
    feats = FR.features(FR.frame_facts(frames, det))
    model = iforest.fit(T.baseline_frames(feats), 20).cache()
    stream = live.feature_stream(live.read_frame_stream(spark, path, 1))
    got = _score_all(spark, stream, tmp_path)
    placed = T.with_frame_position(frames.select("feed_id", "frame_id"))
    later = feats.join(placed.filter("pos > 30"), ["feed_id", "frame_id"], "left_semi")
    _same_scores(got, iforest.score(later, model))
    # a second start goes on where the first ended
    assert _score_all(spark, stream, tmp_path).count() == got.count()
    # the state holds the models of the batch fit
    kept = phases.models(spark, f"{tmp_path}/state")
    near = kept.alias("a").join(model.alias("b"), "feed_id").filter(
        "a.sample_size = b.sample_size AND a.n_train = b.n_train AND abs(a.offset - b.offset) < 1e-6"
        " AND transform(a.nodes, n -> n.threshold) = transform(b.nodes, n -> n.threshold)")
    assert near.count() == kept.count() == model.count() > 0


def test_given_models_score_from_the_first_frame(spark, replay, tmp_path):
    path, frames, det = replay
    feats = FR.features(FR.frame_facts(frames, det))
    model = iforest.fit(T.baseline_frames(feats), 20).cache()
    stream = live.feature_stream(live.read_frame_stream(spark, path, 1))
    _same_scores(_score_all(spark, stream, tmp_path, models=model), iforest.score(feats, model))


def test_baseline_over_several_batches_in_any_order(spark, tmp_path):
    from scenespark import constants as C

    names = ["feed_id", "frame_id", *C.FEATURES]
    rows = [(f, i, *[float((i * (k + 3) * 37 + f) % 101) for k in range(len(C.FEATURES))]) for f in (1, 2) for i in range(1, 61)]
    feats = spark.createDataFrame(rows, phases.SCORE_SCHEMA.replace("model_score double", ", ".join(f"{c} float" for c in C.FEATURES)))
    # the second feed never fills its baseline
    feats = feats.filter("feed_id = 1 OR frame_id <= 20").select(names)
    for part in range(6):
        feats.filter(f"frame_id > {part * 10} AND frame_id <= {part * 10 + 10}").orderBy(F.desc("frame_id")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feats.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(phases.scored_stream(stream, 20, need=25, held=3), "several")
    base = feats.filter("feed_id = 1 AND frame_id <= 25")
    forest = iforest.fit_whole(base.orderBy("frame_id").toPandas(), 1, 20)
    later = feats.filter("feed_id = 1 AND frame_id > 25").orderBy("frame_id").toPandas()
    want = iforest.score_samples(later[C.FEATURES].to_numpy(float), forest.nodes, forest.size) - forest.offset
    assert [(r["feed_id"], r["frame_id"]) for r in got.orderBy("frame_id").collect()] == [(1, i) for i in range(26, 61)]
    assert [r["model_score"] for r in got.orderBy("frame_id").collect()] == pytest.approx(want.tolist())
    with pytest.raises(ValueError):
        phases.scored_stream(stream, 20, need=1000)


def test_serving_table(spark, replay, tmp_path):
    path, _, det = replay
    q = live.serve(live.violation_stream(live.read_frame_stream(spark, path)), str(tmp_path / "o"), str(tmp_path / "c"), 1)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "o")).count() == Z.violations(Z.assign_zones(det)).count()
