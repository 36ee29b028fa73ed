"""Scores, levels and ranks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenespark import constants as C


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def lookup(mapping: dict, key, default=None) -> Column:
    """Small constant dictionary lookup; stays a projection."""
    hit = F.try_element_at(literal_map(mapping), _c(key))
    return hit if default is None else F.coalesce(hit, default if isinstance(default, Column) else F.lit(default))


def anomaly_prob(score) -> Column:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(_c(score) * 10))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def alert_level(score) -> Column:
    s = _c(score)
    return (
        F.when(s < C.SCORE_CRITICAL, "critical").when(s < C.SCORE_HIGH, "high").otherwise("normal")
    )


def threat_label(score) -> Column:
    """Training label derived from a score."""
    s = _c(score)
    return (
        F.when(s < C.SCORE_CRITICAL, "CRITICAL")
        .when(s < C.SCORE_HIGH, "HIGH")
        .when(s < C.SCORE_MEDIUM_LABEL, "MEDIUM")
        .otherwise("LOW")
    )


def priority(level, motion) -> Column:
    level, motion = _c(level), _c(motion)
    return (
        F.when(level == "critical", "CRITICAL")
        .when(level == "high", "HIGH")
        .when((level == "normal") & (motion > C.MOTION_MEDIUM), "MEDIUM")
        .otherwise("LOW")
    )


def priority_rank(priority_col) -> Column:
    return lookup(C.PRIORITY_RANK, priority_col, 0)


def severity_rank(level) -> Column:
    return lookup({k: v[1] for k, v in C.ZONE_LEVELS.items()}, level, 0)


def severity_of_rank(rank) -> Column:
    return lookup({v[1]: k for k, v in C.ZONE_LEVELS.items()}, rank, "SAFE")


def is_night(ts) -> Column:
    """Event-time night test in the session time zone."""
    hour = F.hour(_c(ts))
    return (hour >= C.NIGHT_START_HOUR) | (hour < C.NIGHT_END_HOUR)


def night_boost(risk, ts) -> Column:
    factor = F.when(is_night(ts), F.lit(C.NIGHT_FACTOR)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), _c(risk) * factor)


def same_direction(ax, ay, bx, by) -> Column:
    """Cosine of two unit vectors above the coordination threshold."""
    return _c(ax) * _c(bx) + _c(ay) * _c(by) > C.COORDINATED_COSINE


def chart_band(score, high: float = C.CHART_HIGH, critical: float = C.CHART_CRITICAL) -> Column:
    s = _c(score)
    return F.when(s < critical, "CRITICAL").when(s < high, "HIGH").otherwise("NORMAL")


def is_email(text) -> Column:
    return F.trim(_c(text)).rlike(C.EMAIL_PATTERN)
