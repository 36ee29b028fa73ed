"""Object tracks: greedy IoU matching of detections over the frames of a feed.

Matching is the only sequential step. It runs per *chunk* of frames:

* where every track must have expired the state is known to be empty, so a new
  chunk starts clean and chunks are independent;
* a feed that never goes quiet is also cut every ``block_rows`` frames. Such a
  chunk starts from the tracks its predecessor leaves behind. All chunks run in
  parallel from a guess, then only those whose guess was wrong run again, until
  none is. The result is the sequential one.

Everything after matching (track numbers, positions, live rows, per-frame
counts) is windows and group-bys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions import text
from scenespark.operators.chained import CHUNK, run_chained
from scenespark.operators.checkpoints import cut
from scenespark.operators.frames import KEY
from scenespark.operators.ordering import (
    BLOCK_ROWS, block_window, frame_bucket, own_rows, with_blocks, with_position,
)
from scenespark.operators.temporal import FEED, temporal_risk, window_alert_list, with_frame_position

BOX = ["x1", "y1", "x2", "y2"]
TRACK = ["feed_id", "root_frame", "root_det"]


def chunk_frames(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Chunk of each frame that has detections, with its previous processed frame.

    ``part`` 0 continues the previous block; higher parts start clean.
    Needs ``feed_id, frame_id, detection_count``.
    """
    gap = C.TRACK_MAX_GAP
    placed = frames if "pos" in frames.columns else with_frame_position(frames)
    run = block_window(FEED, "pos")
    busy = F.col("detection_count") > 0
    near = run.rowsBetween(-(gap + 1), -1)
    marked = with_blocks(placed.select(*KEY, "detection_count", "pos"), "pos", gap + 1, block_rows).withColumns({
        "prev_frame": F.lag("frame_id").over(run),
        "_last": F.max(F.when(busy, F.col("frame_id"))).over(near),
    })
    clean = busy & F.coalesce(F.col("prev_frame") - F.col("_last") > gap, F.lit(True))
    return (
        marked.filter("_own")
        .withColumn("part", F.sum(clean.cast("int")).over(run))
        .filter(busy)
        .select(*KEY, "pos", "prev_frame", F.col("_block").alias("block"), "part")
    )


# --- matching inside one chunk ------------------------------------------------

def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    side = np.maximum(
        0.0, np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    )
    inter = side[..., 0] * side[..., 1]

    def area(x):
        return np.maximum(0.0, x[:, 2] - x[:, 0]) * np.maximum(0.0, x[:, 3] - x[:, 1])

    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def match_frame(boxes: np.ndarray, live_box: np.ndarray) -> tuple[list[int], bool]:
    """Live track taken by each detection in order, -1 for none; and whether an
    exact tie went to the older track."""
    if not len(live_box):
        return [-1] * len(boxes), False
    overlap, taken, tie = _iou_matrix(boxes, live_box), [], False
    best = overlap.argmax(axis=1)
    top = overlap[np.arange(len(best)), best]
    hit = top >= C.IOU_MATCH
    # where no two want one track and none has two to choose from, order does not matter
    wanted = best[hit]
    if len(set(wanted.tolist())) == len(wanted) and int((overlap[hit] == top[hit, None]).sum()) == len(wanted):
        return np.where(hit, best, -1).tolist(), False
    for row in overlap:
        best = int(row.argmax())
        if row[best] >= C.IOU_MATCH:
            tie = tie or int((row == row[best]).sum()) > 1
            overlap[:, best] = -1.0
            taken.append(best)
        else:
            taken.append(-1)
    return taken, tie


def match_chunk(
    frame: np.ndarray, prev: np.ndarray, boxes: np.ndarray, start_boxes: np.ndarray, start_last: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Track number of every detection, rows sorted by frame then detection.

    Numbers below ``len(start_boxes)`` are inherited tracks; higher ones are
    created here in order. Also returns the tracks alive at the end (numbers,
    boxes, last frames) and whether an exact tie was decided by track order.
    """
    number = np.empty(len(frame), dtype=np.int64)
    live = np.arange(len(start_boxes), dtype=np.int64)
    live_box, live_last = start_boxes.reshape(-1, 4), start_last
    created, tie = len(start_boxes), False
    edges = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1], True]) if len(frame) else np.array([0])
    for lo, hi in zip(edges[:-1], edges[1:]):
        keep = prev[lo] - live_last <= C.TRACK_MAX_GAP
        if not keep.all():
            live, live_box, live_last = live[keep], live_box[keep], live_last[keep]
        taken, tied = match_frame(boxes[lo:hi], live_box)
        tie = tie or tied
        took = np.array(taken)
        old = took >= 0
        if old.any():
            at = took[old]
            number[lo:hi][old] = live[at]
            live_box[at], live_last[at] = boxes[lo:hi][old], frame[lo]
        fresh = lo + np.flatnonzero(~old)
        if len(fresh):
            number[fresh] = np.arange(created, created + len(fresh))
            live = np.concatenate([live, number[fresh]])
            live_box = np.concatenate([live_box, boxes[fresh]])
            live_last = np.concatenate([live_last, frame[fresh]])
            created += len(fresh)
    return number, live, live_box, live_last, tie


_MATCH_SCHEMA = (
    "feed_id long, block long, part long, kind string, frame_id long, det_id long, "
    "from_idx long, root_frame long, root_det long, idx long, "
    "x1 double, y1 double, x2 double, y2 double, last_frame long, tie boolean"
)


def _run_chunks(rows: pd.DataFrame, start: pd.DataFrame | None, carry: list[str]) -> pd.DataFrame:
    """Whole chunks, a single one if there is a start state: ``obs`` rows say which track each
    detection belongs to and repeat its ``carry`` columns, ``out`` rows are the tracks left at the
    end. A track is named by its first detection or, when inherited, by its place in the start state."""
    rows = rows.sort_values([*CHUNK, "frame_id", "det_id"], kind="stable")
    if start is None or start.empty:
        boxes0, last0 = np.empty((0, 4)), np.empty(0, dtype=np.int64)
    else:
        start = start.sort_values("idx")
        boxes0, last0 = start[BOX].to_numpy(float), start["last_frame"].to_numpy(np.int64)
    frame, det = rows["frame_id"].to_numpy(np.int64), rows["det_id"].to_numpy(np.int64)
    prev = rows["prev_frame"].fillna(-(1 << 40)).to_numpy(np.int64)
    boxes, chunk = rows[BOX].to_numpy(float), rows[CHUNK].to_numpy(np.int64)
    begin = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]).any(axis=1)])
    found = []
    for lo, hi in zip(begin, [*begin[1:], len(rows)]):
        number, live, *left, tie = match_chunk(frame[lo:hi], prev[lo:hi], boxes[lo:hi], boxes0.copy(), last0.copy())
        # the tracks of a chunk are no more than its rows, so numbers of chunks stay apart
        found.append((number + lo, live + lo, *left, np.arange(len(live)), tie))
    number, live, box, last, idx = (np.concatenate([f[i] for f in found]) for i in range(5))
    tracks, first = np.unique(number, return_index=True)
    ends = np.repeat(begin, [len(f[1]) for f in found])

    def table(kind, at, nums=None, **cols):
        """Rows of the chunks that the rows ``at`` belong to; ``nums`` are their tracks."""
        names = {}
        if nums is not None:
            inherited = nums < len(boxes0)
            seen = first[np.minimum(np.searchsorted(tracks, nums), len(first) - 1)]
            names = {
                "from_idx": pd.array(nums, dtype="Int64"), "root_frame": pd.array(frame[seen], dtype="Int64"),
                "root_det": pd.array(det[seen], dtype="Int64"),
            }
            names["from_idx"][~inherited] = pd.NA
            names["root_frame"][inherited] = pd.NA
            names["root_det"][inherited] = pd.NA
        return pd.DataFrame({**{c: chunk[at, i] for i, c in enumerate(CHUNK)}, "kind": kind, **names, **cols})

    both = pd.concat([
        table("obs", np.arange(len(rows)), number, frame_id=frame, det_id=det, **{c: rows[c].to_numpy() for c in carry}),
        table("out", ends, live, idx=idx, **{c: box[:, i] for i, c in enumerate(BOX)}, last_frame=last),
        table("end", begin, tie=[f[-1] for f in found]),
    ], ignore_index=True)
    order = [f.split()[0] for f in _MATCH_SCHEMA.split(", ")]
    return both.reindex(columns=[*order, *carry])


def _match_chained(chunked: DataFrame, carry: list[str]) -> DataFrame:
    """Chunks may continue their predecessor; exact ties make track order matter."""
    more = "".join(f", {c} {chunked.schema[c].dataType.simpleString()}" for c in carry)
    chained = run_chained(
        chunked, lambda rows, start: _run_chunks(rows, start, carry), _MATCH_SCHEMA + more,
        ["idx", *BOX, "last_frame"], order_col="idx", fresh=lambda rows: _run_chunks(rows, None, carry))
    if not chained.continues:
        return chained.result.filter("kind = 'obs'").select("feed_id", "frame_id", "det_id", "root_frame", "root_det", *carry)
    return _resolve_names(chained.result, chained.tails, carry)


def _resolve_names(result: DataFrame, tails: DataFrame, carry: list[str]) -> DataFrame:
    """Follow inherited tracks back to their first detection by pointer doubling.

    Only the observations of inherited tracks are joined; the others know their track.
    """
    name = ["root_frame", "root_det", "to_block", "to_idx"]
    links = cut(
        result.filter("kind = 'out'").join(tails, CHUNK)
        .select(
            "feed_id", (F.col("block") + 1).alias("block"), "idx", "root_frame", "root_det",
            F.when(F.col("from_idx").isNotNull(), F.col("block")).alias("to_block"),
            F.col("from_idx").alias("to_idx"),
        )
    )
    while links.filter("to_idx IS NOT NULL").head(1):
        hop = links.select("feed_id", F.col("block").alias("to_block"), F.col("idx").alias("to_idx"),
                           *[F.col(c).alias(f"n_{c}") for c in name])
        joined = links.join(hop, ["feed_id", "to_block", "to_idx"], "left")
        moved = F.col("to_idx").isNotNull()
        links = cut(joined.select(
            "feed_id", "block", "idx",
            *[F.when(moved, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in name],
        ))
    seen = result.filter("kind = 'obs'")
    columns = ["feed_id", "frame_id", "det_id", "root_frame", "root_det", *carry]
    roots = links.select("feed_id", "block", F.col("idx").alias("from_idx"),
                         F.col("root_frame").alias("l_frame"), F.col("root_det").alias("l_det"))
    inherited = seen.filter("from_idx IS NOT NULL").drop("root_frame", "root_det").join(
        roots, ["feed_id", "block", "from_idx"], "left").withColumnsRenamed({"l_frame": "root_frame", "l_det": "root_det"})
    return seen.filter("from_idx IS NULL").select(columns).unionAll(inherited.select(columns))


def match_tracks(
    detections: DataFrame, frames: DataFrame, block_rows: int = BLOCK_ROWS, carry: list[str] | None = None
) -> DataFrame:
    """First detection of the track every detection belongs to, and its ``carry`` columns.

    ``frames`` needs ``feed_id, frame_id, detection_count`` for all processed
    frames. Feeds of any length take the same way.
    """
    carry = carry or []
    chunks = chunk_frames(frames, block_rows)
    chunked = (
        detections.select(*KEY, "det_id", *BOX, *carry)
        .join(chunks.select(*KEY, "prev_frame", "block", "part"), KEY)
    )
    return _match_chained(chunked, carry)


# --- after matching ------------------------------------------------------------

def observations(
    detections: DataFrame, frames: DataFrame, block_rows: int = BLOCK_ROWS, materialise: bool = True
) -> DataFrame:
    """One row per tracked detection with the state of its track after it.

    The matched rows feed three branches (numbers, positions, windows), so they
    are materialised instead of matching three times.
    """
    rows = match_tracks(detections, frames, block_rows, ["class_name", "center_x", "center_y"])
    if materialise:
        rows = cut(rows)
    created = rows.filter("frame_id = root_frame AND det_id = root_det").select(
        *TRACK, F.col("class_name").alias("track_class")
    )
    numbered = with_position(created, FEED, ["root_frame", "root_det"], frame_bucket("root_frame", 512), "track_no")
    return (
        track_motion(rows.drop("class_name"), TRACK, block_rows)
        .join(numbered, TRACK)
        .withColumn("track_id", F.col("track_no") - 1)
        .drop("track_no", "root_frame", "root_det")
        .withColumnRenamed("track_class", "class_name")
    )


def track_motion(rows: DataFrame, track: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """State of a track after each of its observations.

    ``rows`` needs the ``track`` columns, ``frame_id, det_id, center_x, center_y``.
    Positions older than the retained number do not count. Long tracks are cut
    into blocks like long feeds.
    """
    cap = C.TRACK_POSITIONS
    placed = with_position(rows, track, ["frame_id", "det_id"], frame_bucket("frame_id"), "frame_count")
    run = block_window(track, "frame_count")
    kept = run.rowsBetween(-(cap - 1), 0)
    state = with_blocks(placed, "frame_count", cap - 1, max(block_rows, 2 * cap), ahead=1).withColumns({
        "next_frame": F.lead("frame_id").over(run),
        "y_displacement": F.col("center_y") - F.first("center_y").over(kept),
        "x_range": F.max("center_x").over(kept) - F.min("center_x").over(kept),
        "y_range": F.max("center_y").over(kept) - F.min("center_y").over(kept),
        "_dx": F.col("center_x") - F.lag("center_x", 2).over(run),
        "_dy": F.col("center_y") - F.lag("center_y", 2).over(run),
    })
    mag = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    moving = mag > C.MOVING_MIN
    return (
        own_rows(state)
        .withColumns({
            "is_approaching": F.col("y_displacement") < -C.APPROACH_DISPLACEMENT,
            "is_loitering": (F.col("frame_count") >= C.LOITER_OBSERVATIONS)
            & (F.col("x_range") < C.LOITER_RANGE) & (F.col("y_range") < C.LOITER_RANGE),
            "dir_x": F.when(moving, F.col("_dx") / mag),
            "dir_y": F.when(moving, F.col("_dy") / mag),
        })
        .drop("_dx", "_dy")
    )


def live_tracks(obs: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per processed frame and track alive in it, seen there or not.

    A track lives from an observation until its next one or until the gap limit,
    so an observation reaches at most six frames: an explode and an equi-join.
    """
    last = F.least(
        F.col("seen_frame") + C.TRACK_MAX_GAP, F.coalesce(F.col("next_frame") - 1, F.lit((1 << 62)))
    )
    spread = obs.withColumnRenamed("frame_id", "seen_frame").withColumn(
        "frame_id", F.explode(F.sequence(F.col("seen_frame"), last))
    )
    return spread.join(frames.select(*KEY), KEY)


def track_listing(obs: DataFrame, frames: DataFrame, keep: int = 10) -> DataFrame:
    """Live tracks per frame with their latest positions, rounded."""
    run = Window.partitionBy("feed_id", "track_id", "_block").orderBy("frame_count").rowsBetween(-(keep - 1), 0)
    point = F.struct(exact_round("center_x", 4).alias("x"), exact_round("center_y", 4).alias("y"))
    with_points = own_rows(
        with_blocks(obs, "frame_count", keep - 1).withColumn("positions", F.collect_list(point).over(run))
    )
    return live_tracks(with_points, frames).select(
        *KEY, "track_id", "class_name",
        exact_round("center_x", 4).alias("center_x"), exact_round("center_y", 4).alias("center_y"),
        "frame_count", "is_approaching", "is_loitering", "positions",
    )


def track_facts(live: DataFrame) -> DataFrame:
    """Per-frame track counts and the material of track alerts: one shuffle."""
    frame = Window.partitionBy(*KEY)
    active = F.col("frame_count") >= 3
    moving = active & F.col("dir_x").isNotNull()
    lead = F.min_by(
        F.when(moving, F.struct("dir_x", "dir_y")), F.when(moving, F.col("track_id"))
    ).over(frame)
    cosine = F.col("dir_x") * F.col("_lead.dir_x") + F.col("dir_y") * F.col("_lead.dir_y")
    followed = moving & (F.col("track_id") != F.col("_lead_id")) & (cosine > C.COORDINATED_COSINE)
    near = F.col("is_approaching") & active
    loiter = F.struct(
        "track_id",
        text.loitering_text("class_name", "track_id", "frame_count", "center_x", "center_y").alias("description"),
        F.to_json(F.struct(
            "track_id", "class_name", "frame_count",
            exact_round("center_x", 4).alias("center_x"), exact_round("center_y", 4).alias("center_y"),
        )).alias("details"),
    )
    approach = F.struct("track_id", "class_name", exact_round("y_displacement", 4).alias("y_displacement"))
    return (
        live.withColumn("_lead", lead)
        .withColumn("_lead_id", F.min(F.when(moving, F.col("track_id"))).over(frame))
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("tracked_objects"),
            F.count_if("is_approaching").alias("approaching_count"),
            F.count_if("is_loitering").alias("loitering_count"),
            F.array_sort(F.collect_list(F.when(F.col("is_loitering"), loiter))).alias("loiterers"),
            F.count_if(near).alias("approach_n"),
            F.coalesce(
                F.max(F.when(near, F.col("class_name").isin(C.APPROACH_CRITICAL_CLASSES))), F.lit(False)
            ).alias("approach_critical"),
            F.array_sort(F.collect_list(F.when(near, approach))).alias("approachers"),
            F.count_if(active).alias("active_tracks"),
            F.count_if(moving).alias("moving_count"),
            (F.count_if(followed) + 1).alias("coordinated_count"),
        )
    )


def temporal_frames(stats: DataFrame, tracks: DataFrame) -> DataFrame:
    """Window statistics and track facts of a frame as one temporal result.

    ``alerts`` lists all alerts of the frame in order; ``temporal_reasons`` are
    their descriptions and ``temporal_risk`` the composite risk.
    """
    return temporal_columns(stats.join(tracks, KEY, "left"))


def temporal_columns(j: DataFrame) -> DataFrame:
    """Alerts, reasons and risk from columns of window statistics and track facts."""
    zero = ["tracked_objects", "approaching_count", "loitering_count", "approach_n", "active_tracks",
            "moving_count", "coordinated_count"]
    j = j.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    ready = F.col("window_size") >= 3
    enough = (F.col("active_tracks") >= C.COORDINATED_MIN) & (F.col("moving_count") >= C.COORDINATED_MIN)
    is_approach = ready & (F.col("approach_n") > 0)
    is_coordinated = ready & enough & (F.col("coordinated_count") >= C.COORDINATED_MIN)

    def alert(kind, severity, description, details):
        return F.struct(
            F.lit(kind).alias("alert_type"), severity.alias("severity"),
            description.alias("description"), F.to_json(details).alias("details"),
        )

    high, none = F.lit("HIGH"), F.array().cast(
        "array<struct<alert_type:string,severity:string,description:string,details:string>>"
    )
    classes = F.transform("approachers", lambda a: a["class_name"])
    window_part = window_alert_list()
    loiter_part = F.when(ready & (F.col("loitering_count") > 0), F.transform("loiterers", lambda l: F.struct(
        F.lit("loitering").alias("alert_type"), F.lit("MEDIUM").alias("severity"),
        l["description"].alias("description"), l["details"].alias("details"),
    ))).otherwise(none)
    track_part = F.array_compact(F.array(
        F.when(is_approach, alert(
            "approach_trajectory", F.when(F.col("approach_critical"), "CRITICAL").otherwise("HIGH"),
            text.approach_text("approach_n", classes),
            F.struct(F.col("approach_n").alias("approaching_count"),
                     F.array_sort(F.array_distinct(classes)).alias("classes"),
                     F.col("approachers").alias("tracks")))),
        F.when(is_coordinated, alert(
            "coordinated_movement", high, text.coordinated_text("coordinated_count"),
            F.struct("coordinated_count", F.col("moving_count").alias("total_moving")))),
    ))
    bit = {
        "CRITICAL": (is_approach & F.col("approach_critical")).cast("int"),
        "HIGH": F.col("is_sudden").cast("int") + F.col("is_buildup").cast("int")
        + (is_approach & ~F.col("approach_critical")).cast("int") + is_coordinated.cast("int"),
        "MEDIUM": F.when(ready, F.col("loitering_count")).otherwise(F.lit(0)),
    }
    bit["CRITICAL"] = F.coalesce(bit["CRITICAL"], F.lit(0))
    bit["HIGH"] = F.coalesce(bit["HIGH"], F.col("is_sudden").cast("int") + F.col("is_buildup").cast("int"))
    return (
        j.withColumn("alerts", F.concat(window_part, loiter_part, track_part))
        .withColumn("temporal_reasons", F.transform("alerts", lambda a: a["description"]))
        .withColumn("temporal_risk", temporal_risk(
            bit, F.col("detection_trend"), F.col("motion_trend"),
            F.col("approaching_count"), F.col("loitering_count")))
        .drop("loiterers", "approachers", "approach_critical", "approach_n", "active_tracks", "moving_count",
              "coordinated_count")
    )


def temporal_alerts(frames: DataFrame) -> DataFrame:
    """Alerts of ``temporal_frames`` as rows, numbered in order within the frame."""
    return frames.select(*KEY, "ts", F.posexplode("alerts").alias("alert_no", "a")).select(
        *KEY, "ts", "alert_no", "a.alert_type", "a.severity", "a.description", "a.details"
    )


def temporal_summary(frames: DataFrame) -> DataFrame:
    """Frames, alerts by type (zero-filled) and tracks alive at the end, per feed."""
    kinds = {
        k: F.sum(F.size(F.filter("alerts", lambda a: a["alert_type"] == k))).alias(k)  # noqa: B023
        for k in C.TEMPORAL_ALERT_TYPES
    }
    return frames.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.sum(F.size("alerts")).alias("total_temporal_alerts"),
        *kinds.values(),
        F.max_by("tracked_objects", "frame_id").alias("active_tracks"),
    )
