"""Readers for alert logs, session documents, frame records and feed catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.operators.frames import flat_detections
from scenespark.sources.json_arrays import read_objects

ALERT_SCHEMA = (
    "alert_id string, feed_id long, frame_id long, timestamp double, priority string, anomaly_score double, "
    "anomaly_prob double, alert_level string, reasons array<string>, detection_count long, motion_score double, "
    "notified boolean"
)

# Defaults of absent fields.
ALERT_DEFAULTS = {
    "alert_id": "", "feed_id": 0, "frame_id": 0, "timestamp": 0.0, "priority": "LOW", "anomaly_score": 0.0,
    "anomaly_prob": 0.0, "alert_level": "normal", "detection_count": 0, "notified": False,
}


def complete_alerts(raw: DataFrame) -> DataFrame:
    """Fill absent fields and turn the epoch into an event time."""
    return raw.withColumns({
        **{k: F.coalesce(F.col(k), F.lit(v)) for k, v in ALERT_DEFAULTS.items()},
        "reasons": F.coalesce("reasons", F.array().cast("array<string>")),
    }).withColumn("ts", F.timestamp_micros(F.round(F.col("timestamp") * 1000000).cast("bigint"))).drop("timestamp")


def read_alert_log(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Alert log: a JSON array per file, or one object per line for large logs."""
    raw = spark.read.schema(ALERT_SCHEMA).option("multiLine", multi_line).json(path)
    return complete_alerts(raw)


def read_alert_array(spark: SparkSession, path: str) -> DataFrame:
    """Alert logs of any size that are one JSON array per file, each read by many tasks."""
    return parse_alerts(read_objects(spark, path))


def parse_alerts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alert objects held as JSON text; unreadable text is counted, not hidden:
    such rows come out with ``is_corrupt`` true."""
    schema = ALERT_SCHEMA + ", _corrupt string"
    parsed = lines.withColumn(
        "j", F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    ).select("j.*")
    good = parsed.withColumn("is_corrupt", F.col("_corrupt").isNotNull()).drop("_corrupt")
    return complete_alerts(good)


def read_sessions(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Session documents with the time their file was last changed."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(schema)
    return reader.json(path).select("*", F.col("_metadata.file_modification_time").alias("modified_at"),
                                    F.col("_metadata.file_name").alias("file_name"))


def newest_session(sessions: DataFrame) -> DataFrame:
    """The session whose file changed last."""
    cols = [c for c in sessions.columns]
    return sessions.agg(
        F.max_by(F.struct(*cols), F.struct("modified_at", "file_name")).alias("s")
    ).filter("s IS NOT NULL").select("s.*")


SUMMARY_SCHEMA = (
    "total_frames long, normal_frames long, high_alert_frames long, critical_frames long, alert_rate double, "
    "avg_anomaly_score double, min_anomaly_score double, avg_anomaly_prob double, alert_frame_ids array<long>, "
    "model_fitted boolean, rf_fitted boolean, rf_label_counts map<string,long>"
)


def read_anomaly_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).json(path)


FRAME_SCHEMA = (
    "feed_id long, frame_id long, timestamp double, motion_score double, inference_ms double, "
    "detections array<struct<det_id: long, class_id: int, class_name: string, confidence: double, "
    "bbox: array<double>, center_x: double, center_y: double, width_norm: double, height_norm: double, "
    "area_norm: double, threat_level: string>>"
)


def frame_records(raw: DataFrame) -> DataFrame:
    """Frame records with nested detections, as a live feed drops them."""
    # The box of a detection that has none.
    zero = F.lit([0.0, 0.0, 0.0, 0.0])
    numbered = F.transform("detections", lambda d, i: F.struct(
        F.coalesce(d["det_id"], i.cast("bigint")).alias("det_id"),
        d["class_id"].alias("class_id"), d["class_name"].alias("class_name"),
        d["confidence"].alias("confidence"),
        *[F.coalesce(d["bbox"], zero)[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))],
        *[d[c].alias(c) for c in ("center_x", "center_y", "width_norm", "height_norm", "area_norm", "threat_level")],
    ))
    return raw.select(
        F.coalesce("feed_id", F.lit(0)).cast("bigint").alias("feed_id"),
        F.coalesce("frame_id", F.lit(0)).cast("bigint").alias("frame_id"),
        F.timestamp_micros(F.round(F.col("timestamp") * 1000000).cast("bigint")).alias("ts"),
        "motion_score", "inference_ms",
        F.coalesce(numbered, F.array().cast(numbered_type())).alias("detections"),
    )


def numbered_type() -> str:
    return (
        "array<struct<det_id:bigint,class_id:int,class_name:string,confidence:double,x1:double,y1:double,"
        "x2:double,y2:double,center_x:double,center_y:double,width_norm:double,height_norm:double,"
        "area_norm:double,threat_level:string>>"
    )


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return frame_records(spark.read.schema(FRAME_SCHEMA).json(path))


def split_frames(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frame records -> (frames, detections)."""
    return records.drop("detections"), flat_detections(records)


def feed_catalogue(feeds: DataFrame) -> DataFrame:
    """Feed metadata with duration; zero when the frame rate is unknown."""
    return feeds.withColumn(
        "duration", F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")).otherwise(F.lit(0.0))
    )
