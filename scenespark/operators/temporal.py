"""Sliding-window detectors over processed frames (the part that needs no tracks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions import text
from scenespark.operators.ordering import (
    BLOCK_ROWS, block_window, first_rows, frame_bucket, own_rows, with_blocks, with_position,
)

FEED = ["feed_id"]


def with_frame_position(frames: DataFrame) -> DataFrame:
    """``pos``: which processed frame of its feed this is, from 1."""
    return with_position(frames, FEED, ["frame_id"], frame_bucket())


def _slope(y: Column, x: Column, w) -> Column:
    """Least-squares slope of whole numbers from exact integer sums.

    Exact sums make the result independent of how rows are cut into blocks. Rows
    with a null ``y`` do not count.
    """
    x = F.when(y.isNotNull(), x)
    n = F.count(y).over(w)
    sx, sy = F.sum(x).over(w), F.sum(y).over(w)
    sxx, sxy = F.sum(x * x).over(w), F.sum(x * y).over(w)
    return F.try_divide((n * sxy - sx * sy).cast("double"), (n * sxx - sx * sx).cast("double"))


def window_stats(
    facts: DataFrame, window: int = C.WINDOW_SIZE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Window statistics per frame.

    ``facts`` needs ``feed_id, frame_id, detection_count, persons, motion_score``;
    all other columns pass through. Work is split into blocks of frames inside a
    feed, so a busy feed spreads over many tasks.

    Also yields ``prev_frame`` and ``starts_clean`` for the tracker: no track can
    survive into a frame whose previous processed frame already lies more than
    the allowed gap behind the last frame with detections.
    """
    halo = max(window - 1, C.TRACK_MAX_GAP + 1)
    placed = facts if "pos" in facts.columns else with_frame_position(facts)
    blocks = with_blocks(placed, "pos", halo, block_rows)
    run = block_window(FEED, "pos")
    recent = run.rowsBetween(-(window - 1), 0)
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    length = F.least(F.col("pos"), F.lit(window))
    n, persons = F.col("detection_count"), F.col("persons")
    last_busy = F.max(F.when(n > 0, F.col("frame_id"))).over(
        run.rowsBetween(-(C.TRACK_MAX_GAP + 1), -1)
    )
    stats = (
        blocks
        # a small ordinal keeps the integer sums small; slopes ignore shifts
        .withColumn("_x", F.col("pos") - F.col("_block") * block_rows)
        .withColumn("_mx", F.count("motion_score").over(so_far))
        .withColumns({
            "window_size": length,
            "prev_frame": F.lag("frame_id").over(run),
            "_last_busy": last_busy,
            "_prev_avg": F.avg(n).over(run.rowsBetween(-4, -1)),
            "_person_slope": _slope(persons, F.col("_x"), recent),
            "_count_slope": _slope(n, F.col("_x"), recent),
            # motion is serialised with four decimals
            "_motion_slope": _slope(F.rint(F.col("motion_score") * 10000).cast("bigint"), F.col("_mx"), recent) / 10000.0,
            "_motions": F.count("motion_score").over(recent),
            "window_start_persons": F.first("persons").over(recent),
        })
    )
    prev_avg = F.when(length > 4, F.col("_prev_avg")).otherwise(F.lit(0.0))
    return (
        own_rows(stats)
        .withColumns({
            "prev_avg": prev_avg,
            "increase": n - prev_avg,
            "buildup_rate": F.when(length >= 8, F.col("_person_slope")),
            "detection_trend": F.when(length >= 5, F.coalesce("_count_slope", F.lit(0.0))).otherwise(F.lit(0.0)),
            "motion_trend": F.when(
                (length >= 5) & (F.col("_motions") >= 5), F.coalesce("_motion_slope", F.lit(0.0))
            ).otherwise(F.lit(0.0)),
            "starts_clean": F.coalesce(F.col("prev_frame") - F.col("_last_busy") > C.TRACK_MAX_GAP, F.lit(True)),
        })
        .withColumns({
            "is_sudden": (length >= 3) & (F.col("prev_avg") < C.SUDDEN_QUIET_BELOW)
            & (F.col("increase") >= C.SUDDEN_INCREASE),
            "is_buildup": F.coalesce((F.col("buildup_rate") >= C.BUILDUP_RATE) & (persons >= 3), F.lit(False)),
        })
        .drop("_x", "_mx", "_last_busy", "_prev_avg", "_person_slope", "_count_slope", "_motion_slope", "_motions")
    )


def window_alert_list() -> Column:
    """Array of the sudden-appearance and crowd-buildup alerts of a frame."""
    def alert(kind, description, details):
        return F.struct(
            F.lit(kind).alias("alert_type"), F.lit("HIGH").alias("severity"),
            description.alias("description"), F.to_json(details).alias("details"),
        )

    sudden = alert(
        "sudden_appearance", text.sudden_text("increase", "prev_avg", "detection_count"),
        F.struct(exact_round("prev_avg", 1).alias("previous_avg"), F.col("detection_count").alias("current_count"),
                 exact_round("increase", 1).alias("increase")),
    )
    buildup = alert(
        "crowd_buildup", text.buildup_text("buildup_rate", "persons"),
        F.struct(exact_round("buildup_rate", 4).alias("buildup_rate"), F.col("persons").alias("current_persons"),
                 "window_start_persons"),
    )
    return F.array_compact(F.array(
        F.when(F.col("is_sudden"), sudden), F.when(F.col("is_buildup"), buildup)
    ))


def window_alerts(stats: DataFrame) -> DataFrame:
    """Sudden-appearance and crowd-buildup alerts as rows."""
    return (
        stats.filter("is_sudden OR is_buildup")
        .select("feed_id", "frame_id", "ts", F.explode(window_alert_list()).alias("a"))
        .select("feed_id", "frame_id", "ts", "a.*")
    )


def temporal_risk(
    severities: dict[str, Column], detection_trend: Column, motion_trend: Column,
    approaching: Column, loitering: Column,
) -> Column:
    """Composite risk; ``severities`` maps a severity to its alert count."""
    # Weights.
    score = (
        0.30 * severities["CRITICAL"] + 0.20 * severities["HIGH"] + 0.10 * severities["MEDIUM"]
        + F.when(detection_trend > 0, F.least(F.lit(0.10), detection_trend * 0.05)).otherwise(F.lit(0.0))
        + F.when(motion_trend > 0, F.least(F.lit(0.10), motion_trend * 0.02)).otherwise(F.lit(0.0))
        + 0.10 * approaching + 0.05 * loitering
    )
    return F.least(F.lit(1.0), score)


def baseline_frames(frames: DataFrame, n: int = C.BASELINE_FRAMES) -> DataFrame:
    return first_rows(frames, FEED, ["frame_id"], n)


def effective_fps(frames: DataFrame) -> DataFrame:
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    seconds = span / F.lit(1e6)
    return frames.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("frames"),
        seconds.alias("elapsed_seconds"),
        (F.count(F.lit(1)) / F.greatest(seconds, F.lit(0.001))).alias("effective_fps"),
    )


def overlap_candidates(detections: DataFrame, frames: DataFrame, threshold: float = C.IOU_MATCH) -> DataFrame:
    """Box pairs of adjacent processed frames that lie close and are of similar size.

    An overlap of ``t`` needs longer sides whose ratio is at least ``t``. Sides are put in
    levels a little wider than ``1 / t``, so the boxes of a pair are of one level or of two
    that follow each other. A level has a grid whose cell is the longest side it allows; a
    box enters the grids of its level and of the next, at most four cells of each. Cells
    therefore suit the boxes in them, whatever the scale of a frame, and a crowd of small
    boxes does not meet in one cell. A pair is met once: in the grid of its larger box, in
    the cell of its intersection's corner. Boxes without an area have no partner.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    base = 1.01 * max(2.0, 1.0 / threshold)
    placed = with_frame_position(frames.select("feed_id", "frame_id"))
    prev = own_rows(
        with_blocks(placed, "pos", 1).withColumn(
            "prev_frame", F.lag("frame_id").over(block_window(FEED, "pos"))
        )
    ).select("feed_id", "frame_id", "prev_frame")
    corners = ["x1", "y1", "x2", "y2"]
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    unbounded = F.lit(float("inf"))
    boxes = detections.select("feed_id", "frame_id", "det_id", *[F.col(c).cast("double") for c in corners]).filter(
        (width > 0) & (height > 0) & (width < unbounded) & (height < unbounded)
    ).withColumn("level", F.greatest(
        F.lit(FINEST_LEVEL), F.ceil(F.log(F.greatest(width, height)) / F.log(F.lit(base)))).cast("int"))

    def gridded(rows: DataFrame) -> DataFrame:
        cell = F.pow(F.lit(base), F.col("grid"))

        def span(low: str, high: str):
            return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

        rows = rows.withColumn("grid", F.explode(F.array("level", F.col("level") + 1)))
        return rows.withColumn("gx", span("x1", "x2")).withColumn("gy", span("y1", "y2"))

    now = gridded(boxes.join(prev.filter("prev_frame IS NOT NULL"), FEED + ["frame_id"]))
    names = {c: f"p_{c}" for c in ("det_id", *corners, "level")}
    before = gridded(boxes).withColumnsRenamed(names).withColumnRenamed("frame_id", "prev_frame")
    cell = F.pow(F.lit(base), F.col("grid"))
    return now.join(before, ["feed_id", "prev_frame", "grid", "gx", "gy"]).filter(
        (F.col("grid") == F.greatest("level", "p_level"))
        & (F.col("gx") == F.floor(F.greatest("x1", "p_x1") / cell))
        & (F.col("gy") == F.floor(F.greatest("y1", "p_y1") / cell))
    )


def pairwise_iou(detections: DataFrame, frames: DataFrame, threshold: float = C.IOU_MATCH) -> DataFrame:
    """Box pairs of adjacent processed frames that overlap enough."""
    from scenespark.functions.geometry import iou

    box, prior = ["x1", "y1", "x2", "y2"], ["p_x1", "p_y1", "p_x2", "p_y2"]
    return (
        overlap_candidates(detections, frames, threshold)
        .withColumn("iou", iou(box, prior))
        .filter(F.col("iou") >= threshold)
        .select("feed_id", "frame_id", "prev_frame", "det_id", F.col("p_det_id").alias("prev_det_id"), "iou")
    )


# smaller boxes share the cells of this level
FINEST_LEVEL = -6
