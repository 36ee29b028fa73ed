"""Human-readable reasons. The wording is fixed: reports compare it as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import fixed


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def violation_reason(class_name, confidence, label, high_threat) -> Column:
    # Wording.
    return F.concat(
        _c(class_name), F.lit(" ("), fixed(_c(confidence) * 100, 0), F.lit("%) detected in "), _c(label),
        F.when(_c(high_threat), " [HIGH THREAT]").otherwise(""),
    )


def sudden_text(increase, prev_avg, count) -> Column:
    # Wording.
    return F.concat(
        F.lit("Sudden appearance: "), _c(increase).cast("bigint"), F.lit(" new objects detected (was "),
        fixed(prev_avg, 0), F.lit(", now "), _c(count), F.lit(")"),
    )


def buildup_text(slope, persons) -> Column:
    # Wording.
    return F.concat(
        F.lit("Crowd buildup detected: person count rising at "), fixed(slope, 2),
        F.lit("/frame (now "), _c(persons), F.lit(" persons)"),
    )


def loitering_text(class_name, track_id, frame_count, cx, cy) -> Column:
    # Wording.
    return F.concat(
        F.lit("Loitering detected: "), _c(class_name), F.lit(" (track #"), _c(track_id),
        F.lit(") stationary for "), _c(frame_count), F.lit(" frames at ("),
        fixed(cx, 2), F.lit(", "), fixed(cy, 2), F.lit(")"),
    )


def approach_text(count, class_names) -> Column:
    """``class_names`` is an array; it is shown distinct and sorted."""
    # Wording.
    return F.concat(
        F.lit("Border approach detected: "), _c(count), F.lit(" object(s) moving toward border zone — "),
        F.array_join(F.array_sort(F.array_distinct(_c(class_names))), ", "),
    )


def coordinated_text(count) -> Column:
    # Wording.
    return F.concat(
        F.lit("Coordinated movement: "), _c(count), F.lit(" objects moving in the same direction")
    )


def boost_reasons(classes, motion) -> Column:
    """Reasons for hard score boosts, from the set of class names in a frame."""
    classes, motion = _c(classes), _c(motion)
    threats = F.array_sort(F.array_intersect(classes, F.lit(C.THREAT_CLASSES)))
    # Wording and order.
    return F.array_compact(F.array(
        F.when(F.array_contains(classes, "military_vehicle"), "military_vehicle detected"),
        F.when(F.array_contains(classes, "suspicious_object"), "suspicious_object detected"),
        F.when(F.array_contains(classes, "crowd") & (motion > 12.0), "crowd with high motion"),
        F.when(F.size(threats) >= 2,
               F.concat(F.lit("multiple threat classes: "), F.array_join(threats, ", "))),
    ))


def anomaly_reasons(level, count, classes, motion, score) -> Column:
    """Ordered reasons of a flagged frame; empty when the frame is normal."""
    level, count, classes, motion, score = map(_c, (level, count, classes, motion, score))
    # Wording and order.
    listed = F.concat(
        boost_reasons(classes, motion),
        F.array_compact(F.array(
            F.when(count > 10, F.concat(F.lit("unusually high detection count ("), count, F.lit(")"))),
            F.when(motion > 10.0, F.concat(F.lit("high motion activity (score="), fixed(motion, 1), F.lit(")"))),
            F.when(F.array_contains(classes, "crowd"), "crowd gathering detected"),
            F.when(F.array_contains(classes, "aircraft"), "aircraft in surveillance zone"),
        )),
    )
    fallback = F.array(F.concat(F.lit("statistical anomaly (IF score="), fixed(score, 3), F.lit(")")))
    return (
        F.when(level == "normal", F.array().cast("array<string>"))
        .when(F.size(listed) > 0, listed)
        .otherwise(fallback)
    )


def cooldown_keys(reasons) -> Column:
    """Threat classes mentioned anywhere in the reasons, or ``generic``."""
    reasons = _c(reasons)
    found = F.filter(
        F.lit(C.COOLDOWN_CLASSES), lambda c: F.exists(reasons, lambda r: F.contains(r, c))
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("generic")))


def label_line(class_id, cx, cy, w, h) -> Column:
    return F.concat_ws(" ", _c(class_id), *[fixed(v, 6) for v in (cx, cy, w, h)])
