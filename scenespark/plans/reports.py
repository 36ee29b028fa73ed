"""Report queries over alert, frame and detection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions.scores import chart_band


def kpis(alerts: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: totals, criticals, highs, detections, alert rate over scored frames."""
    s = sessions.agg(
        F.sum("total_detections").alias("total_detections"),
        F.sum("frames_scored").alias("scored"),
        F.sum(F.col("high_alert_frames") + F.col("critical_frames")).alias("flagged"),
    )
    a = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("priority") == "CRITICAL").alias("critical"),
        F.count_if(F.col("priority") == "HIGH").alias("high"),
    )
    pick = F.struct("total_detections", "scored", "flagged")
    return a.withColumn("_s", s.select(pick.alias("s")).scalar()).select(
        "total_alerts", "critical", "high",
        F.col("_s.total_detections").alias("total_detections"),
        exact_round(F.col("_s.flagged") / F.greatest(F.col("_s.scored"), F.lit(1)), 4).alias("alert_rate"),
    )


def class_chart(detections: DataFrame) -> DataFrame:
    """Detections per class; classes without any do not show."""
    return detections.groupBy("class_name").agg(F.count(F.lit(1)).alias("detections"))


def density(detections: DataFrame, bins: int = 20) -> DataFrame:
    """Two-dimensional histogram of detection centres; the rim falls in the last bin."""
    def cell(c):
        return F.greatest(F.lit(0), F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)))

    return detections.groupBy(cell("center_x").alias("bin_x"), cell("center_y").alias("bin_y")).agg(
        F.count(F.lit(1)).alias("detections")
    )


def hotspots_by_risk(hotspots: DataFrame) -> DataFrame:
    return hotspots.groupBy("risk").agg(F.count(F.lit(1)).alias("hotspots"))


def anomaly_timeline(frames: DataFrame) -> DataFrame:
    """Score per frame with its chart band, in frame order.

    Output order is per feed: range partitioning by (feed, frame), no single task.
    """
    return frames.select(
        "feed_id", "frame_id", exact_round("anomaly_score", 4).alias("anomaly_score"),
        chart_band("anomaly_score").alias("band"),
    ).orderBy("feed_id", "frame_id")


def motion_timeline(frames: DataFrame) -> DataFrame:
    """Motion per frame; frames without a motion score are left out."""
    return frames.filter(F.col("motion_score").isNotNull()).select(
        "feed_id", "frame_id", "motion_score", (F.col("motion_score") > C.MOTION_MEDIUM).alias("above_medium")
    ).orderBy("feed_id", "frame_id")
