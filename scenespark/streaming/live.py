"""The analyses on Structured Streaming.

Stateless parts reuse the batch operators on the exploded stream or read the
nested detections of a frame with higher-order functions. State is kept per feed
and bounded: the last window of counters and the live tracks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from scenespark import constants as C
from scenespark.functions import text
from scenespark.functions.numbers import exact_round
from scenespark.operators import zones as Z
from scenespark.operators.alerts import notifiable
from scenespark.operators.cooldown import cooldown_step
from scenespark.operators.frames import KEY, flat_detections
from scenespark.operators.tracking import match_frame, temporal_columns
from scenespark.sources.records import FRAME_SCHEMA, frame_records
from scenespark.streaming.held_rows import HELD_ROWS, HeldRows, in_chunks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of many feeds belongs on disk, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_frame_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Frame records dropped as JSON files."""
    reader = spark.readStream.schema(FRAME_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return frame_records(reader.json(path))


def violation_stream(frames: DataFrame, zones: list[dict] | DataFrame | None = None) -> DataFrame:
    """Zone violations; stateless. A zone table is static."""
    return Z.violations(Z.assign_zones(flat_detections(frames), zones))


def feature_stream(frames: DataFrame) -> DataFrame:
    """The ten frame features from the nested detections; stateless."""
    d = F.col("detections")
    n = F.size(d)

    def mean(field, empty):
        total = F.aggregate(F.transform(d, lambda x: x[field]), F.lit(0.0), lambda a, x: a + x)
        return F.when(n > 0, total / n).otherwise(F.lit(empty))

    names = F.transform(d, lambda x: F.coalesce(x["class_name"], F.lit("")))
    def hits(classes):
        return F.size(F.filter(names, lambda c: c.isin(classes)))

    values = {
        "detection_count": n,
        "class_diversity": F.size(F.array_distinct(names)),
        "avg_confidence": mean("confidence", 0.0),
        "max_confidence": F.coalesce(F.array_max(F.transform(d, lambda x: x["confidence"])), F.lit(0.0)),
        "critical_count": hits(C.THREAT_CLASSES),
        "avg_center_x": mean("center_x", 0.5),
        "avg_center_y": mean("center_y", 0.5),
        "avg_width_norm": mean("width_norm", 0.0),
        "motion": F.coalesce("motion_score", F.lit(0.0)),
        "suspicious_flag": (hits(C.CRITICAL_THREAT_CLASSES) > 0).cast("int"),
    }
    return frames.select(*KEY, "ts", *[values[c].cast("float").alias(c) for c in C.FEATURES])


# --- tracker and window state -----------------------------------------------------

_TRACKED = (
    "feed_id long, frame_id long, ts timestamp, pos long, detection_count long, persons long, motion_score double, "
    "counts array<long>, people array<long>, motions array<double>, late_frames long, "
    "tracks array<struct<track_id: long, class_name: string, frame_count: long, center_x: double, center_y: double, "
    "y_displacement: double, x_range: double, y_range: double, dx: double, dy: double>>"
)


def _track_row(t: dict) -> dict:
    xs, ys = [p[0] for p in t["at"]], [p[1] for p in t["at"]]
    old = t["at"][-3] if len(t["at"]) >= 3 else None
    return {
        "track_id": t["id"], "class_name": t["cls"], "frame_count": t["n"], "center_x": xs[-1], "center_y": ys[-1],
        "y_displacement": ys[-1] - ys[0], "x_range": max(xs) - min(xs), "y_range": max(ys) - min(ys),
        "dx": xs[-1] - old[0] if old else None, "dy": ys[-1] - old[1] if old else None,
    }


class FeedTracker(StatefulProcessor):
    """Ring buffer of frame counters and live tracks of one feed.

    Only what is sequential happens here; alerts and risk are column expressions
    on the emitted rows. Frames at or before the last one seen are dropped and
    counted. Counters are a value, the window a list, the live tracks a map. With
    ``ttl_ms`` a feed that sends nothing for that long is forgotten; its next frame
    is the first of a new feed.
    """

    COUNTERS = "last long, next long, pos long, late long"
    WINDOW = "detections long, persons long, motion double"
    TRACK = "class_name string, box array<double>, last long, n long, xs array<double>, ys array<double>"

    def __init__(self, window: int = C.WINDOW_SIZE, ttl_ms: int | None = None, held: int = HELD_ROWS) -> None:
        self.window, self.ttl_ms, self.held = window, ttl_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counters = handle.getValueState("counters", self.COUNTERS, self.ttl_ms)
        self._window = handle.getListState("window", self.WINDOW, self.ttl_ms)
        self._tracks = handle.getMapState("tracks", "id long", self.TRACK, self.ttl_ms)
        self._rows = HeldRows(handle, ["frame_id"], self.held)

    def _load(self) -> dict:
        # what is left of a feed whose counters have expired is not used
        if not self._counters.exists():
            return {"last": None, "next": 0, "pos": 0, "late": 0, "hist": [], "tracks": [], "stored": set()}
        last, following, pos, late = self._counters.get()
        tracks = [
            {"id": k[0], "cls": v[0], "box": list(v[1]), "last": v[2], "n": v[3], "at": [list(p) for p in zip(v[4], v[5])]}
            for k, v in self._tracks.iterator()]
        return {
            "last": last, "next": following, "pos": pos, "late": late, "hist": [tuple(h) for h in self._window.get()],
            "tracks": sorted(tracks, key=lambda t: t["id"]), "stored": {t["id"] for t in tracks}}

    def _store(self, s: dict) -> None:
        if not s["stored"]:
            self._tracks.clear()
        self._counters.update((s["last"], s["next"], s["pos"], s["late"]))
        self._window.put(s["hist"])
        for gone in s["stored"] - {t["id"] for t in s["tracks"]}:
            self._tracks.removeKey((gone,))
        for t in s["tracks"]:
            xs, ys = zip(*t["at"])
            self._tracks.updateValue((t["id"],), (t["cls"], t["box"], t["last"], t["n"], list(xs), list(ys)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        for chunk in in_chunks(self._rows.ordered(rows)):
            out = [self._frame(key[0], s, r) for r in chunk if self._in_time(s, r)]
            if out:
                yield pd.DataFrame(out)
        if s["last"] is not None:
            self._store(s)

    def _in_time(self, s: dict, r) -> bool:
        late = s["last"] is not None and r.frame_id <= s["last"]
        s["late"] += late
        return not late

    def _frame(self, feed, s: dict, r) -> dict:
        self._step(s, r)
        counts, people, motions = zip(*s["hist"])
        return {
            "feed_id": feed, "frame_id": r.frame_id, "ts": r.ts, "pos": s["pos"], "detection_count": counts[-1],
            "persons": people[-1], "motion_score": motions[-1], "counts": list(counts), "people": list(people),
            "motions": list(motions), "late_frames": s["late"], "tracks": [_track_row(t) for t in s["tracks"]],
        }

    def _step(self, s: dict, r) -> None:
        frame = int(r.frame_id)
        boxes = np.asarray(r.boxes, dtype=float).reshape(-1, 4)
        names = list(r.names)
        motion = None if r.motion_score is None or np.isnan(r.motion_score) else float(r.motion_score)
        s["last"], s["pos"] = frame, s["pos"] + 1
        s["hist"] = [*s["hist"], (len(boxes), names.count("person"), motion)][-self.window:]
        tracks = s["tracks"]
        taken, _ = match_frame(boxes, np.array([t["box"] for t in tracks], dtype=float).reshape(-1, 4))
        for i, hit in enumerate(taken):
            point = [float(r.xs[i]), float(r.ys[i])]
            if hit >= 0:
                t = tracks[hit]
                t.update(box=boxes[i].tolist(), last=frame, n=t["n"] + 1, at=[*t["at"], point][-C.TRACK_POSITIONS:])
        for i, hit in enumerate(taken):
            if hit < 0:
                tracks.append({"id": s["next"], "cls": names[i], "box": boxes[i].tolist(), "last": frame, "n": 1,
                               "at": [[float(r.xs[i]), float(r.ys[i])]]})
                s["next"] += 1
        s["tracks"] = [t for t in tracks if frame - t["last"] <= C.TRACK_MAX_GAP]

    def close(self) -> None:
        pass


def tracked_stream(
    frames: DataFrame, window: int = C.WINDOW_SIZE, ttl_ms: int | None = None, held: int = HELD_ROWS
) -> DataFrame:
    """Frames with their window counters and live tracks."""
    d = F.array_sort(F.transform("detections", lambda x: F.struct(
        x["det_id"], F.coalesce(x["x1"], F.lit(0.0)).alias("x1"), F.coalesce(x["y1"], F.lit(0.0)).alias("y1"),
        F.coalesce(x["x2"], F.lit(0.0)).alias("x2"), F.coalesce(x["y2"], F.lit(0.0)).alias("y2"),
        F.coalesce(x["center_x"], F.lit(0.5)).alias("cx"), F.coalesce(x["center_y"], F.lit(0.5)).alias("cy"),
        F.coalesce(x["class_name"], F.lit("unknown")).alias("cls"))))
    flat = frames.withColumn("_d", d).select(
        *KEY, "ts", "motion_score",
        F.flatten(F.transform("_d", lambda x: F.array(x["x1"], x["y1"], x["x2"], x["y2"]))).alias("boxes"),
        F.transform("_d", lambda x: x["cx"]).alias("xs"), F.transform("_d", lambda x: x["cy"]).alias("ys"),
        F.transform("_d", lambda x: x["cls"]).alias("names"),
    )
    return flat.groupBy("feed_id").transformWithStateInPandas(
        FeedTracker(window, ttl_ms, held), _parse_datatype_string(_TRACKED), "Append",
        "ProcessingTime" if ttl_ms else "None",
    )


def _array_slope(values, positions):
    """Slope of an array of whole numbers against their positions."""
    pairs = F.arrays_zip(positions.alias("x"), values.alias("y"))
    n = F.size(values).cast("bigint")
    def total(f):
        return F.aggregate(F.transform(pairs, f), F.lit(0).cast("bigint"), lambda a, x: a + x)

    sx, sy = total(lambda p: p["x"]), total(lambda p: p["y"])
    sxx, sxy = total(lambda p: p["x"] * p["x"]), total(lambda p: p["x"] * p["y"])
    return F.try_divide((n * sxy - sx * sy).cast("double"), (n * sxx - sx * sx).cast("double"))


def _positions(values):
    return F.transform(values, lambda _, i: i.cast("bigint"))


def temporal_stream(
    frames: DataFrame, window: int = C.WINDOW_SIZE, ttl_ms: int | None = None, held: int = HELD_ROWS
) -> DataFrame:
    """Temporal result per frame, equal to the batch ``temporal_frames``."""
    t = tracked_stream(frames, window, ttl_ms, held)
    size = F.size("counts")
    prev = F.slice("counts", -5, 4)
    avg4 = F.aggregate(prev, F.lit(0.0), lambda a, x: a + x) / 4
    known = F.filter("motions", lambda m: m.isNotNull())
    m4 = F.transform(known, lambda m: F.rint(m * 10000).cast("bigint"))
    zero = F.lit(0.0)
    t = t.withColumns({
        "window_size": size,
        "prev_avg": F.when(size > 4, avg4).otherwise(zero),
        "buildup_rate": F.when(size >= 8, _array_slope(F.col("people"), _positions(F.col("people")))),
        "detection_trend": F.when(
            size >= 5, F.coalesce(_array_slope(F.col("counts"), _positions(F.col("counts"))), zero)).otherwise(zero),
        "motion_trend": F.when(
            (size >= 5) & (F.size(known) >= 5), F.coalesce(_array_slope(m4, _positions(m4)) / 10000.0, zero)).otherwise(zero),
        "window_start_persons": F.get("people", F.lit(0)),
    }).withColumn("increase", F.col("detection_count") - F.col("prev_avg"))
    t = t.withColumns({
        "is_sudden": (size >= 3) & (F.col("prev_avg") < C.SUDDEN_QUIET_BELOW) & (F.col("increase") >= C.SUDDEN_INCREASE),
        "is_buildup": F.coalesce((F.col("buildup_rate") >= C.BUILDUP_RATE) & (F.col("persons") >= 3), F.lit(False)),
    })
    tracks = F.col("tracks")
    active = F.filter(tracks, lambda k: k["frame_count"] >= 3)

    def length(k):
        return F.sqrt(k["dx"] * k["dx"] + k["dy"] * k["dy"])

    directions = F.transform(
        F.filter(active, lambda k: F.coalesce(length(k) > C.MOVING_MIN, F.lit(False))),
        lambda k: F.struct((k["dx"] / length(k)).alias("x"), (k["dy"] / length(k)).alias("y")),
    )
    def is_loitering(k):
        return ((k["frame_count"] >= C.LOITER_OBSERVATIONS) & (k["x_range"] < C.LOITER_RANGE)
                & (k["y_range"] < C.LOITER_RANGE))

    near = F.filter(active, lambda k: k["y_displacement"] < -C.APPROACH_DISPLACEMENT)
    loiter = F.filter(tracks, is_loitering)
    t = t.withColumn("_dirs", directions)
    lead = F.get("_dirs", F.lit(0))
    t = t.withColumns({
        "tracked_objects": F.size(tracks),
        "approaching_count": F.size(F.filter(tracks, lambda k: k["y_displacement"] < -C.APPROACH_DISPLACEMENT)),
        "loitering_count": F.size(loiter),
        "loiterers": F.transform(loiter, lambda k: F.struct(
            k["track_id"].alias("track_id"),
            text.loitering_text(k["class_name"], k["track_id"], k["frame_count"], k["center_x"], k["center_y"]).alias("description"),
            F.to_json(F.struct(
                k["track_id"].alias("track_id"), k["class_name"].alias("class_name"), k["frame_count"].alias("frame_count"),
                exact_round(k["center_x"], 4).alias("center_x"), exact_round(k["center_y"], 4).alias("center_y"))).alias("details"))),
        "approach_n": F.size(near),
        "approach_critical": F.exists(near, lambda k: k["class_name"].isin(C.APPROACH_CRITICAL_CLASSES)),
        "approachers": F.transform(near, lambda k: F.struct(
            k["track_id"].alias("track_id"), k["class_name"].alias("class_name"),
            exact_round(k["y_displacement"], 4).alias("y_displacement"))),
        "active_tracks": F.size(active),
        "moving_count": F.size("_dirs"),
        "coordinated_count": F.size(F.filter(
            F.slice("_dirs", 2, F.greatest(F.size("_dirs"), F.lit(1))),
            lambda k: k["x"] * lead["x"] + k["y"] * lead["y"] > C.COORDINATED_COSINE)) + 1,
    })
    return temporal_columns(t).drop("_dirs", "counts", "people", "motions", "tracks")


# --- cooldown ---------------------------------------------------------------------

class FeedCooldown(StatefulProcessor):
    """Last notification time per threat class of one feed."""

    def __init__(self, wait_us: int, held: int = HELD_ROWS) -> None:
        self.wait_us, self.held = wait_us, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getMapState("last", "cool_key string", "at long")
        self._rows = HeldRows(handle, ["at", "frame_id", "alert_id"], self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = {k[0]: v[0] for k, v in self._last.iterator()}
        for chunk in in_chunks(self._rows.ordered(rows)):
            notify = cooldown_step([r.at for r in chunk], [list(r.cooldown_keys) for r in chunk], last, self.wait_us)
            out = pd.DataFrame(chunk)[["alert_id", "feed_id", "frame_id", "priority"]]
            yield out.assign(notify=notify)
        for k, at in last.items():
            self._last.updateValue((k,), (int(at),))

    def close(self) -> None:
        pass


def notification_stream(
    alerts: DataFrame, cooldown_seconds: float = C.COOLDOWN_SECONDS, held: int = HELD_ROWS
) -> DataFrame:
    """Which high and critical alerts send a message, in event time."""
    rows = notifiable(alerts).select(
        "alert_id", "feed_id", "frame_id", "priority", F.unix_micros("ts").alias("at"), "cooldown_keys")
    return rows.groupBy("feed_id").transformWithStateInPandas(
        FeedCooldown(int(cooldown_seconds * 1_000_000), held),
        _parse_datatype_string("alert_id string, feed_id long, frame_id long, priority string, notify boolean"),
        "Append", "None",
    )


# --- aggregates and serving ----------------------------------------------------------

def hourly_stream(alerts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Alerts per hour and priority; late rows within the watermark still count."""
    return (
        alerts.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("w"), "priority")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .select(F.col("w.start").alias("hour"), "priority", "alerts")
    )



def serve(stream: DataFrame, path: str, checkpoint: str, seconds: int = 5, mode: str = "append"):
    """Write to a serving table every few seconds."""
    return (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
    )
