"""The full analysis of many feeds: frames -> zones, tracks, scores -> alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.operators import alerts as A
from scenespark.operators import anomaly, feed_forest, frames as FR, iforest, temporal, threat_model, tracking, zones as Z
from scenespark.operators.checkpoints import cut
from scenespark.operators.frames import KEY
from scenespark.operators.ordering import BLOCK_ROWS, first_rows


@dataclass
class Options:
    """What one run may vary. All have working defaults."""

    zones: list[dict] | DataFrame | None = None  # or a zone table, with a set per feed if it has feed_id
    night_boost: bool = True
    window: int = C.WINDOW_SIZE
    baseline: int = C.BASELINE_FRAMES
    frame_skip: int = 1
    max_frames: int = 0
    scoring: str = "rules"  # rules | forest
    model: DataFrame | None = None  # fitted forest: skips the baseline phase
    trees: int = C.FOREST_TREES
    contamination: float = C.CONTAMINATION
    threat: DataFrame | threat_model.ThreatModel | None = None  # a classifier per feed, or one for all
    fit_threat: bool = False  # fit a classifier per feed on the forest scores of its baseline
    block_rows: int = BLOCK_ROWS
    extra: dict = field(default_factory=dict)


def select_frames(frames: DataFrame, opts: Options) -> DataFrame:
    if opts.frame_skip > 1:
        frames = FR.keep_every(frames, opts.frame_skip)
    if opts.max_frames > 0:
        frames = FR.first_frames(frames, opts.max_frames)
    return frames


def frame_table(frames: DataFrame, detections: DataFrame, opts: Options | None = None) -> DataFrame:
    """One row per processed frame with every finding and the fused level.

    Detections shuffle once for all per-frame facts and once for the tracker. The
    facts are small next to the detections and feed several branches, so they are
    materialised. ``phase`` is ``baseline`` for the frames a model is fitted on.
    """
    opts = opts or Options()
    chosen = select_frames(frames, opts)
    if opts.frame_skip > 1 or opts.max_frames > 0:
        detections = detections.join(chosen.select(*KEY), KEY, "left_semi")
    zoned = Z.assign_zones(detections, opts.zones)
    facts = FR.frame_facts(chosen, zoned, Z.zone_aggregates(opts.zones))
    hits = Z.zone_hits(zoned) if Z.is_table(opts.zones) else None
    facts = Z.zone_risk(facts, opts.zones, opts.night_boost, keep_reasons=A.REASONS_KEPT, hits=hits)
    facts = cut(temporal.with_frame_position(facts))

    stats = temporal.window_stats(facts, opts.window, opts.block_rows)
    obs = tracking.observations(detections, facts, opts.block_rows)
    found = tracking.temporal_frames(stats, tracking.track_facts(tracking.live_tracks(obs, facts)))

    scores = None
    if opts.scoring == "forest":
        feats = FR.features(facts)
        model = opts.model
        if model is None:
            first = facts.filter(F.col("pos") <= opts.baseline).select(*KEY)
            model = cut(iforest.fit(feats.join(first, KEY), opts.trees, opts.contamination))
        scores = iforest.score(feats, model)
    scored = anomaly.score_frames(found, scores)
    scored = scored.withColumn(
        "model_fitted", F.col("model_score").isNotNull() if scores is not None else F.lit(False))
    threat = opts.threat
    if threat is None and opts.fit_threat and scores is not None:
        base = FR.features(facts).join(facts.filter(F.col("pos") <= opts.baseline).select(*KEY), KEY)
        threat = cut(feed_forest.fit(threat_model.training_rows(base, scores)))
    if threat is not None:
        classify = feed_forest.classify if isinstance(threat, DataFrame) else threat_model.classify
        labels = classify(FR.features(facts), threat).select(*KEY, "threat_label")
        scored = scored.join(labels, KEY, "left")
    else:
        scored = scored.withColumn("threat_label", F.lit("UNKNOWN"))
    warm = opts.model is not None
    return A.fuse(scored).withColumn(
        "phase", F.lit("scored") if warm else F.when(F.col("pos") <= opts.baseline, "baseline").otherwise("scored")
    )


def scored_frames(table: DataFrame) -> DataFrame:
    return table.filter("phase = 'scored'")


def alert_table(table: DataFrame) -> DataFrame:
    return A.create_alerts(scored_frames(table))


def frame_report(table: DataFrame, n: int | None = None) -> DataFrame:
    """All scored frames as the report lists them; with ``n`` the first so many of each feed."""
    picked = scored_frames(table)
    if n is not None:
        picked = first_rows(picked, ["feed_id"], ["frame_id"], n)
    return picked.select(
        *KEY, "detection_count",
        exact_round("anomaly_score", 4).alias("anomaly_score"), "alert_level",
        exact_round("zone_risk", 4).alias("zone_risk"), F.col("max_severity").alias("zone_severity"),
        F.col("violation_count").alias("zone_violations"),
        exact_round("temporal_risk", 4).alias("temporal_risk"), F.size("alerts").alias("temporal_alerts"),
        "tracked_objects", exact_round("detection_trend", 4).alias("detection_trend"),
    )


def session_summary(table: DataFrame, timings: list[str] | None = None) -> DataFrame:
    """One row of counters per feed.

    Zone and temporal counters cover all frames, level counters only scored ones,
    with the level before any zone upgrade. ``timings`` names optional per-frame
    millisecond columns to average over scored frames.
    """
    scored = F.col("phase") == "scored"
    n_scored = F.count_if(scored)
    level = F.col("alert_level")
    flagged = F.count_if(scored & anomaly.is_alert())
    has_violation, has_alert = F.col("violation_count") > 0, F.size("alerts") > 0
    restricted = F.col("max_severity") == "RESTRICTED"
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)
    total = F.count(F.lit(1))
    return table.groupBy("feed_id").agg(
        total.alias("total_frames"),
        F.count_if(~scored).alias("baseline_frames"),
        n_scored.alias("frames_scored"),
        F.bool_or(F.col("model_fitted") if "model_fitted" in table.columns else F.lit(False)).alias("model_fitted"),
        F.sum("detection_count").alias("total_detections"),
        F.count_if(scored & (level == "normal")).alias("normal_frames"),
        F.count_if(scored & (level == "high")).alias("high_alert_frames"),
        F.count_if(scored & (level == "critical")).alias("critical_frames"),
        F.count_if(scored & (F.col("final_level") != "normal")).alias("alerts_raised"),
        exact_round(flagged / F.greatest(n_scored, F.lit(1)), 4).alias("alert_rate"),
        F.sum("violation_count").alias("total_zone_violations"),
        F.count_if(has_violation & restricted).alias("zone_critical_count"),
        F.count_if(has_violation & ~restricted).alias("zone_buffer_count"),
        F.sum(F.size("alerts")).alias("total_temporal_alerts"),
        F.coalesce(F.sum(F.when(has_alert, F.col("approaching_count"))), F.lit(0)).alias("temporal_approach_count"),
        F.coalesce(F.sum(F.when(has_alert, F.col("loitering_count"))), F.lit(0)).alias("temporal_loiter_count"),
        exact_round(F.avg("inference_ms"), 2).alias("avg_inference_ms"),
        exact_round(seconds, 2).alias("elapsed_seconds"),
        exact_round(total / F.greatest(seconds, F.lit(0.001)), 2).alias("effective_fps"),
        *[exact_round(F.sum(F.when(scored, F.col(t))) / F.greatest(n_scored, F.lit(1)), 2).alias(f"avg_{t}")
          for t in timings or []],
    )


def capped_records(
    rows: DataFrame, order: str, per_frame: int, per_feed: int = 200, last: int | None = None
) -> DataFrame:
    """First rows of each frame, then first rows of each feed, then its tail.

    Both ranks keep at most a constant number per group and are trimmed before
    their shuffle.
    """
    some = first_rows(rows, KEY, [order], per_frame)
    capped = first_rows(some, ["feed_id"], ["frame_id", order], per_feed)
    if last is None:
        return capped
    tail = Window.partitionBy("feed_id").orderBy(F.desc("frame_id"), F.desc(order))
    return capped.withColumn("_rn", F.row_number().over(tail)).filter(F.col("_rn") <= last).drop("_rn")


def analysis_log(table: DataFrame, zones: list[dict] | DataFrame | None = None, frames: int = 500) -> DataFrame:
    """``feed_id, document``: JSON of the first scored frames of a feed, its zone summary and its temporal summary.

    A feed has ``frames`` entries at most, so a document is bounded however long the feed is.
    """
    report = frame_report(table, frames)
    columns = [c for c in report.columns if c != "feed_id"]
    listed = report.groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("frames"))

    def packed(summary: DataFrame, name: str) -> DataFrame:
        return summary.select("feed_id", F.struct(*[c for c in summary.columns if c != "feed_id"]).alias(name))

    both = packed(Z.zone_summary(table, zones), "zone_summary").join(
        packed(tracking.temporal_summary(table), "temporal_summary"), "feed_id").join(listed, "feed_id", "left")
    body = F.struct(
        F.lit("enhanced").alias("pipeline_type"), F.col("zone_summary.total_frames").alias("total_frames"),
        F.coalesce("frames", F.array().cast(listed.schema["frames"].dataType)).alias("frames"), "zone_summary", "temporal_summary")
    return both.select("feed_id", F.to_json(body).alias("document"))


def session_documents(
    table: DataFrame, alerts: DataFrame, violations: DataFrame, temporal_rows: DataFrame
) -> DataFrame:
    """JSON per feed: one ``session`` row with counters, last violations and last temporal
    alerts, and one ``alert`` row for each alert, however many there are. The lists are
    capped before they are gathered, by their operators' own limits; alerts never are."""
    def packed(rows, name, order):
        cols = [c for c in rows.columns if c != "feed_id"]
        return rows.groupBy("feed_id").agg(
            F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias(name)
        )

    v = capped_records(violations, "det_id", 5, 200, 50)
    t = capped_records(temporal_rows, "alert_no", 3, 200, 50)
    summary = session_summary(table)
    doc = (
        summary.join(packed(v, "zone_violations", ["frame_id", "det_id"]), "feed_id", "left")
        .join(packed(t, "temporal_alerts", ["frame_id", "alert_no"]), "feed_id", "left")
    )
    whole = doc.select("feed_id", F.lit("session").alias("kind"), F.to_json(F.struct(*doc.columns)).alias("document"))
    each = alerts.select("feed_id", F.lit("alert").alias("kind"), F.to_json(F.struct(*alerts.columns)).alias("document"))
    return whole.unionByName(each)
