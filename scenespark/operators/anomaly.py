"""Anomaly scoring: rules, class boosts, levels, reasons and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions import scores, text
from scenespark.operators.frames import KEY


def rule_score(classes: Column, count: Column, motion: Column) -> Column:
    """Score used while no model is fitted."""
    # Penalties.
    parts = [
        (F.arrays_overlap(classes, F.lit(C.CRITICAL_THREAT_CLASSES)), 0.20),
        (F.arrays_overlap(classes, F.lit(C.HIGH_THREAT_CLASSES)), 0.10),
        (count > 15, 0.08),
        (motion > 15.0, 0.06),
    ]
    score = F.lit(0.0)
    for condition, penalty in parts:
        score = score - F.when(condition, F.lit(penalty)).otherwise(F.lit(0.0))
    return score


def class_boost(score: Column, classes: Column, motion: Column) -> Column:
    """Hard upper bounds for dangerous classes; no model can score above them."""
    # Bounds. ``least`` skips the nulls of conditions not met, and the
    # score appears once, so filters on it stay small when they are pushed down.
    s = F.least(
        score,
        F.when(F.array_contains(classes, "military_vehicle"), F.lit(C.SCORE_CRITICAL - 0.05)),
        F.when(F.array_contains(classes, "suspicious_object"), F.lit(C.SCORE_CRITICAL - 0.02)),
        F.when(F.array_contains(classes, "crowd") & (motion > 12.0), F.lit(C.SCORE_HIGH - 0.05)),
    )
    threats = F.size(F.array_intersect(classes, F.lit(C.THREAT_CLASSES)))
    return s - F.when(threats >= 2, F.lit(0.05)).otherwise(F.lit(0.0))


def score_frames(facts: DataFrame, model_scores: DataFrame | None = None) -> DataFrame:
    """Anomaly columns on frame facts: one projection.

    ``model_scores(feed_id, frame_id, model_score)`` overrides the rule score
    where present; frames without one fall back to the rules.
    """
    classes, motion, count = F.col("classes"), F.col("motion_score"), F.col("detection_count")
    base = rule_score(classes, count, F.coalesce(motion, F.lit(0.0)))
    if model_scores is not None:
        facts = facts.join(model_scores.select(*KEY, "model_score"), KEY, "left")
        base = F.coalesce(F.col("model_score"), base)
    return (
        facts.withColumn("base_score", base)
        .withColumn("anomaly_score", class_boost(F.col("base_score"), classes, motion))
        .withColumn("anomaly_prob", scores.anomaly_prob("anomaly_score"))
        .withColumn("alert_level", scores.alert_level("anomaly_score"))
        .withColumn("anomaly_reasons", text.anomaly_reasons("alert_level", count, classes, motion, F.col("anomaly_score")))
    )


def is_alert(level: str = "alert_level") -> Column:
    return F.col(level).isin("high", "critical")


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Per-feed summary. Only the first 20 alert frames per feed are gathered."""
    from scenespark.operators.ordering import first_rows

    level = F.col("alert_level")
    flagged = F.count_if(is_alert())
    labels = (
        {f"label_{x.lower()}": F.count_if(F.col("threat_label") == x) for x in [*C.PRIORITIES, "UNKNOWN"]}
        if "threat_label" in scored.columns else {}
    )
    never = F.lit(False)
    fitted = F.col("model_score").isNotNull() if "model_score" in scored.columns else never
    labelled = F.col("threat_label") != "UNKNOWN" if "threat_label" in scored.columns else never
    totals = scored.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.count_if(level == "normal").alias("normal_frames"),
        F.count_if(level == "high").alias("high_alert_frames"),
        F.count_if(level == "critical").alias("critical_frames"),
        exact_round(flagged / F.count(F.lit(1)), 4).alias("alert_rate"),
        # billionths as whole numbers: the mean does not depend on the order of rows
        exact_round(F.sum(F.rint(F.col("anomaly_score") * 1e9).cast("bigint")) / F.count(F.lit(1)) / 1e9, 4)
        .alias("avg_anomaly_score"),
        exact_round(F.min("anomaly_score"), 4).alias("min_anomaly_score"),
        exact_round(F.avg("anomaly_prob"), 4).alias("avg_anomaly_prob"),
        F.bool_or(fitted).alias("model_fitted"), F.bool_or(labelled).alias("rf_fitted"),
        *[c.alias(n) for n, c in labels.items()],
    )
    firsts = (
        first_rows(scored.filter(is_alert()).select(*KEY), ["feed_id"], ["frame_id"], 20)
        .groupBy("feed_id")
        .agg(F.array_sort(F.collect_list("frame_id")).alias("alert_frame_ids"))
    )
    return totals.join(firsts, "feed_id", "left").withColumn(
        "alert_frame_ids", F.coalesce("alert_frame_ids", F.array().cast("array<bigint>"))
    )


def standardise(features: DataFrame, by: list[str]) -> DataFrame:
    """Zero mean, unit population deviation per group; constant columns stay centred."""
    moments = features.groupBy(*by).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in C.FEATURES],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}") for c in C.FEATURES],
    )
    joined = features.join(moments, by)
    # a deviation this small against the mean is rounding noise of a constant
    def scale(c):
        s = F.col(f"_s_{c}")
        return F.when(s <= 1e-9 * F.greatest(F.abs(F.col(f"_m_{c}")), F.lit(1e-9)), F.lit(1.0)).otherwise(s)
    return joined.select(
        *[c for c in features.columns if c not in C.FEATURES],
        *[((F.col(c).cast("double") - F.col(f"_m_{c}")) / scale(c)).alias(c) for c in C.FEATURES],
    )
