"""Alert fusion, priorities, cooldown, log views and alert statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions import scores, text
from scenespark.operators.ordering import first_rows


# Fixed value: zone and temporal reasons an alert takes over.
REASONS_KEPT = 3


def _reasons(name: str):
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def fuse(frames: DataFrame) -> DataFrame:
    """Zone and temporal findings folded into the anomaly result of a frame.

    Needs ``alert_level, anomaly_reasons, max_severity, zone_reasons,
    temporal_reasons``. The level before the upgrade stays in ``alert_level``;
    ``final_level`` is what alerts use.
    """
    zone_critical = F.col("max_severity") == "RESTRICTED"
    return frames.withColumns({
        "final_level": F.when(F.coalesce(zone_critical, F.lit(False)), "critical").otherwise(F.col("alert_level")),
        "reasons": F.concat(
            _reasons("anomaly_reasons"),
            F.slice(_reasons("zone_reasons"), 1, REASONS_KEPT),
            F.slice(_reasons("temporal_reasons"), 1, REASONS_KEPT),
        ),
    })


def alert_id():
    return F.concat(F.lit("alert_"), F.col("feed_id"), F.lit("_"), F.col("frame_id"))


def create_alerts(fused: DataFrame) -> DataFrame:
    """Alert rows for every non-normal frame."""
    return (
        fused.filter(F.col("final_level") != "normal")
        .select(
            alert_id().alias("alert_id"),
            "feed_id", "frame_id", "ts",
            scores.priority("final_level", "motion_score").alias("priority"),
            exact_round("anomaly_score", 4).alias("anomaly_score"),
            exact_round("anomaly_prob", 4).alias("anomaly_prob"),
            F.col("final_level").alias("alert_level"),
            "reasons", "detection_count",
            exact_round("motion_score", 4).alias("motion_score"),
            F.lit(False).alias("notified"),
        )
    )


# --- log views -------------------------------------------------------------


def newest_first() -> list:
    return [F.desc("ts"), F.desc("feed_id"), F.desc("frame_id")]


def newest(alerts: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` over all feeds (one TakeOrdered, no full sort)."""
    return alerts.orderBy(*newest_first()).limit(n)


def recent_log(alerts: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` shown in log order, oldest first."""
    return newest(alerts, n).orderBy("ts", "feed_id", "frame_id")


def rolling_log(alerts: DataFrame, size: int = C.MAX_LOG_SIZE) -> DataFrame:
    """Newest ``size`` alerts of each feed."""
    return first_rows(alerts, ["feed_id"], newest_first(), size)


def display_rows(alerts: DataFrame, priorities: Iterable[str] = C.PRIORITIES, n: int = 50) -> DataFrame:
    """Newest alerts of the chosen priorities as the report table shows them."""
    picked = newest(alerts.filter(F.col("priority").isin(list(priorities))), n)
    return display_times(picked).select(
        "alert_id", "time_str", "feed_id", "frame_id", "priority", "anomaly_score", "anomaly_prob",
        "detection_count", "motion_score",
        # an empty list shows as its text form
        F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("[]")).alias("reason"),
        "notified",
    )


def display_times(alerts: DataFrame, zone: str = C.DISPLAY_ZONE) -> DataFrame:
    """Clock and date text in the display time zone (session zone must be UTC)."""
    local = F.from_utc_timestamp("ts", zone)
    return alerts.withColumn("time_str", F.date_format(local, "HH:mm:ss")).withColumn(
        "date_str", F.date_format(local, "yyyy-MM-dd")
    )


def to_notify(alerts: DataFrame, n: int = 50) -> DataFrame:
    """Critical, not yet notified alerts among the newest ``n`` (limit first)."""
    return newest(alerts, n).filter("priority = 'CRITICAL' AND NOT notified")


def mark_notified(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Set ``notified`` on the alerts whose id is listed."""
    hits = ids.select("alert_id").distinct().withColumn("_hit", F.lit(True))
    return alerts.join(hits, "alert_id", "left").withColumn(
        "notified", F.coalesce("_hit", "notified")
    ).drop("_hit").select(*alerts.columns)


# --- statistics ------------------------------------------------------------

def by_priority(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("priority").agg(F.count(F.lit(1)).alias("alerts"))


def alert_summary(alerts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return alerts.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("priority") == p).alias(f"{p.lower()}_count") for p in C.PRIORITIES],
    )


def priority_share(alerts: DataFrame) -> DataFrame:
    """All four priorities with their share in percent, zero when there are no alerts."""
    one = alert_summary(alerts)
    total = F.greatest(F.col("total_alerts"), F.lit(1))
    rows = F.array(*[
        F.struct(
            F.lit(p).alias("priority"),
            F.col(f"{p.lower()}_count").alias("alerts"),
            exact_round(F.col(f"{p.lower()}_count") / total * 100, 1).alias("share_pct"),
        )
        for p in C.PRIORITIES
    ])
    return one.select(F.inline(rows))


def hourly(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.date_trunc("hour", "ts").alias("hour"), "priority").agg(
        F.count(F.lit(1)).alias("alerts")
    )


# --- notification cooldown ---------------------------------------------------

def notifiable(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("priority").isin("HIGH", "CRITICAL")).withColumn(
        "cooldown_keys", text.cooldown_keys("reasons")
    )
