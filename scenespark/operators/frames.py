"""Detection rows and per-frame facts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions.scores import lookup


def class_dim(spark: SparkSession) -> DataFrame:
    """The class dictionary as a table, for joins from SQL."""
    return spark.createDataFrame(C.CLASSES, "class_id int, class_name string, threat_level string")


def name_classes(df: DataFrame) -> DataFrame:
    """Class name and threat level by id, with fallbacks for unknown ids.

    The dictionary is seven constants, so the lookup is a projection.
    """
    return df.withColumn(
        "class_name",
        lookup(C.CLASS_NAMES, "class_id", F.concat(F.lit("class_"), F.col("class_id"))),
    ).withColumn("threat_level", lookup(C.CLASS_THREAT, "class_id", "low"))


def normalise_boxes(df: DataFrame, width=C.FRAME_SIZE, height=C.FRAME_SIZE) -> DataFrame:
    """Centre, size and area of a pixel box as shares of the frame."""
    width = F.col(width) if isinstance(width, str) else F.lit(width)
    height = F.col(height) if isinstance(height, str) else F.lit(height)
    return df.withColumns({
        "center_x": ((F.col("x1") + F.col("x2")) / 2) / width,
        "center_y": ((F.col("y1") + F.col("y2")) / 2) / height,
        "width_norm": (F.col("x2") - F.col("x1")) / width,
        "height_norm": (F.col("y2") - F.col("y1")) / height,
    }).withColumn("area_norm", F.col("width_norm") * F.col("height_norm"))


# Decimals kept when a record is serialised.
DECIMALS = {
    "confidence": 4, "x1": 2, "y1": 2, "x2": 2, "y2": 2, "center_x": 4, "center_y": 4,
    "width_norm": 4, "height_norm": 4, "area_norm": 6, "motion_score": 4, "inference_ms": 2,
    "anomaly_score": 4, "anomaly_prob": 4, "risk_score": 4, "detection_trend": 4, "motion_trend": 4,
}


def rounded(df: DataFrame) -> DataFrame:
    """Round every known measure to its serialised precision."""
    return df.withColumns(
        {c: exact_round(c, d) for c, d in DECIMALS.items() if c in df.columns}
    )


def build_detections(
    raw: DataFrame,
    width=C.FRAME_SIZE,
    height=C.FRAME_SIZE,
    min_confidence: float | None = None,
    classes: Iterable[int] | None = None,
) -> DataFrame:
    """Raw boxes -> canonical detection rows, filtered before any arithmetic."""
    if min_confidence is not None:
        raw = raw.filter(F.col("confidence") >= min_confidence)
    classes = list(classes or [])
    if classes:
        raw = raw.filter(F.col("class_id").isin(classes))
    return rounded(name_classes(normalise_boxes(raw, width, height)))


def keep_every(frames: DataFrame, n: int) -> DataFrame:
    """Every n-th frame by id: n, 2n, 3n ..."""
    return frames.filter(F.col("frame_id") % n == 0)


def first_frames(frames: DataFrame, n: int) -> DataFrame:
    """First n processed frames of each feed.

    Small n are trimmed per task before the shuffle; beyond what Spark trims, the
    two-level position keeps a busy feed spread out.
    """
    from scenespark.operators import ordering

    placed = ordering.with_position(frames, ["feed_id"], ["frame_id"], ordering.frame_bucket(), "_pos")
    return placed.filter(F.col("_pos") <= n).drop("_pos")


KEY = ["feed_id", "frame_id"]


def detection_aggregates() -> dict:
    """Aggregates shared by all per-frame consumers, so detections shuffle once."""
    name = F.col("class_name")
    return {
        "detection_count": F.count(F.lit(1)),
        "persons": F.count_if(name == "person"),
        "classes": F.array_sort(F.collect_set("class_name")),
        "avg_confidence": F.avg("confidence"),
        "max_confidence": F.max("confidence"),
        # whole ten-thousandths: sums of them are exact in any order
        "confidence_units": F.sum(F.rint(F.col("confidence") * 10000).cast("bigint")),
        "critical_count": F.count_if(name.isin(C.THREAT_CLASSES)),
        "avg_center_x": F.avg("center_x"),
        "avg_center_y": F.avg("center_y"),
        "avg_width_norm": F.avg("width_norm"),
        "suspicious": F.max(name.isin(C.CRITICAL_THREAT_CLASSES)),
        "has_critical": F.max(F.col("threat_level") == "critical"),
        "has_high": F.max(F.col("threat_level") == "high"),
    }


# What an empty frame looks like to every consumer.
EMPTY_FRAME = {
    "detection_count": 0, "persons": 0, "confidence_units": 0, "avg_confidence": 0.0, "max_confidence": 0.0,
    "critical_count": 0,    "avg_center_x": 0.5, "avg_center_y": 0.5, "avg_width_norm": 0.0,
    "suspicious": False, "has_critical": False, "has_high": False,
}


def frame_facts(frames: DataFrame, detections: DataFrame, extra: dict | None = None) -> DataFrame:
    """One row per frame, empty frames included.

    ``extra`` adds further aggregates (for example zone counts) to the same
    group-by. Counts are zero-filled; measures that have no value stay null
    unless an empty frame defines one.
    """
    aggs = {**detection_aggregates(), **(extra or {})}
    per_frame = detections.groupBy(*KEY).agg(*[a.alias(n) for n, a in aggs.items()])
    joined = frames.join(per_frame, KEY, "left")
    return joined.withColumns({
        **{k: F.coalesce(F.col(k), F.lit(v)) for k, v in EMPTY_FRAME.items()},
        "classes": F.coalesce("classes", F.array().cast("array<string>")),
    })


def features(facts: DataFrame) -> DataFrame:
    """The ten frame features as FLOAT columns named as in ``constants.FEATURES``."""
    source = {
        "detection_count": F.col("detection_count"),
        "class_diversity": F.size("classes"),
        "motion": F.coalesce("motion_score", F.lit(0.0)),
        "suspicious_flag": F.col("suspicious").cast("int"),
    }
    return facts.select(
        *KEY, *[source.get(c, F.col(c)).cast("float").alias(c) for c in C.FEATURES]
    )


def detection_stats(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Session statistics from frame facts: no second pass over detections.

    Mean confidence is over detections, from exact sums per frame.
    """
    by = ["feed_id"] if by is None else by
    dets = F.sum("detection_count")
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_frames"),
        dets.alias("total_detections"),
        exact_round(dets / F.count(F.lit(1)), 2).alias("detections_per_frame"),
        F.count_if("has_critical").alias("critical_frames"),
        F.count_if("has_high").alias("high_frames"),
        exact_round(
            F.coalesce(F.try_divide(F.sum("confidence_units") / 10000.0, dets.cast("double")), F.lit(0.0)), 4
        ).alias("avg_confidence"),
        exact_round(F.avg("inference_ms"), 2).alias("avg_inference_ms"),
    )


def class_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("feed_id", "class_name").agg(F.count(F.lit(1)).alias("detections"))


def nested_frames(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Frames with their detections as an array in ``det_id`` order."""
    cols = [c for c in detections.columns if c not in ("feed_id", "frame_id", "ts")]
    first = ["det_id", *[c for c in cols if c != "det_id"]]
    packed = detections.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct(*first))).alias("detections")
    )
    return frames.join(packed, KEY, "left")


def flat_detections(nested: DataFrame) -> DataFrame:
    """Inverse of ``nested_frames`` with defaults for missing fields."""
    d = nested.select("feed_id", "frame_id", "ts", F.explode("detections").alias("d")).select(
        "feed_id", "frame_id", "ts", "d.*"
    )
    # Defaults for absent fields.
    defaults = {"center_x": 0.5, "center_y": 0.5, "class_name": "unknown", "confidence": 0.0,
                "width_norm": 0.0, "x1": 0.0, "y1": 0.0, "x2": 0.0, "y2": 0.0}
    return d.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items() if k in d.columns})
