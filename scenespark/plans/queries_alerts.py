"""Registered queries over scores, alerts, logs and session reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions import scores
from scenespark.operators import (
    alerts as A, anomaly, cooldown, feed_forest, frames as FR, iforest, temporal as T, threat_model as TM,
)
from scenespark.operators.checkpoints import cut, ensure_checkpoint_dir
from scenespark.operators.frames import KEY
from scenespark.plans import reports as R, session as S
from scenespark.plans.queries_frames import SQL_TIME, detections, facts, rule_alerts, rule_frames, text_time, zoned
from scenespark.plans.registry import block, query
from scenespark.sinks import store, tables
from scenespark.sources import derived as D, json_arrays, records

JOINED = "array_to_string(reasons, '|')"


def _joined(c="reasons"):
    return F.array_join(c, "|")


# --- scores ---------------------------------------------------------------------

@query("rule_scores", """
SELECT feed_id, frame_id, round(base_score, 4) AS base_score, round(anomaly_score, 4) AS anomaly_score,
  round(anomaly_prob, 4) AS anomaly_prob, alert_level FROM c_scored""")
def rule_scores(spark, sf):
    return anomaly.score_frames(facts(spark, sf)).select(
        *KEY, *[exact_round(c, 4).alias(c) for c in ("base_score", "anomaly_score", "anomaly_prob")], "alert_level")


@query("boost_reasons", """
SELECT feed_id, frame_id, array_to_string(anomaly_reasons, '|') AS reasons, len(anomaly_reasons) AS n FROM c_fused WHERE alert_level <> 'normal'""")
def boost_reasons(spark, sf):
    s = anomaly.score_frames(facts(spark, sf)).filter(anomaly.is_alert())
    return s.select(*KEY, _joined("anomaly_reasons").alias("reasons"), F.size("anomaly_reasons").cast("bigint").alias("n"))


@query("score_labels", """
SELECT feed_id, CASE WHEN anomaly_score < -0.18 THEN 'CRITICAL' WHEN anomaly_score < -0.08 THEN 'HIGH' WHEN anomaly_score < 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS label,
  count(*) AS frames FROM (SELECT feed_id, anomaly_score + (frame_id % 4) * 0.03::DOUBLE AS anomaly_score FROM c_scored) GROUP BY 1, 2""")
def score_labels(spark, sf):
    s = anomaly.score_frames(facts(spark, sf)).withColumn("anomaly_score", F.col("anomaly_score") + (F.col("frame_id") % 4) * 0.03)
    return s.groupBy("feed_id", scores.threat_label("anomaly_score").alias("label")).agg(F.count(F.lit(1)).alias("frames"))


@query("alert_frames", "SELECT feed_id, frame_id, alert_level FROM c_scored WHERE alert_level IN ('high', 'critical')")
def alert_frames(spark, sf):
    return anomaly.score_frames(facts(spark, sf)).filter(anomaly.is_alert()).select(*KEY, "alert_level")


@query("anomaly_summary", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY feed_id, alert_level <> 'normal' ORDER BY frame_id) AS rn FROM c_scored)
SELECT feed_id, count(*) AS total_frames, count(*) FILTER (alert_level = 'normal') AS normal_frames,
  count(*) FILTER (alert_level = 'high') AS high_alert_frames, count(*) FILTER (alert_level = 'critical') AS critical_frames,
  round(count(*) FILTER (alert_level <> 'normal') / count(*), 4) AS alert_rate, round(CAST(sum(CAST(round(anomaly_score * 1e9) AS BIGINT)) AS DOUBLE) / count(*) / 1e9, 4) AS avg_anomaly_score,
  round(min(anomaly_score), 4) AS min_anomaly_score, round(avg(anomaly_prob), 4) AS avg_anomaly_prob, false AS model_fitted, false AS rf_fitted,
  array_to_string(list(frame_id ORDER BY frame_id) FILTER (alert_level <> 'normal' AND rn <= 20), ',') AS alert_frame_ids
FROM r GROUP BY 1""")
def anomaly_summary(spark, sf):
    s = anomaly.anomaly_summary(anomaly.score_frames(facts(spark, sf)))
    return s.withColumn("alert_frame_ids", F.array_join(F.transform("alert_frame_ids", lambda x: x.cast("string")), ","))


@query("first_alert_frames", """
SELECT feed_id, frame_id FROM (SELECT feed_id, frame_id, row_number() OVER (PARTITION BY feed_id ORDER BY frame_id) AS rn
FROM c_scored WHERE alert_level <> 'normal') WHERE rn <= 20""")
def first_alert_frames(spark, sf):
    from scenespark.operators.ordering import first_rows

    s = anomaly.score_frames(facts(spark, sf)).filter(anomaly.is_alert())
    return first_rows(s.select(*KEY), ["feed_id"], ["frame_id"], 20)


@query("threat_classes_present", """
SELECT feed_id, frame_id, array_to_string(threats, ',') AS threats, len(threats) AS n FROM c_scored WHERE len(threats) > 0""")
def threat_classes_present(spark, sf):
    t = F.array_sort(F.array_intersect("classes", F.lit(C.THREAT_CLASSES)))
    f = facts(spark, sf).select(*KEY, t.alias("t")).filter(F.size("t") > 0)
    return f.select(*KEY, F.array_join("t", ",").alias("threats"), F.size("t").cast("bigint").alias("n"))


# --- models -----------------------------------------------------------------------

def _forest(spark, sf, trees=C.FOREST_TREES):
    # the features fit the forest and are scored by it
    feats = cut(FR.features(facts(spark, sf)))
    return feats, iforest.fit(T.baseline_frames(feats), trees)


@query("forest_nodes")
def forest_nodes(spark, sf):
    _, model = _forest(spark, sf)
    return iforest.nodes(model).groupBy("feed_id", "tree").agg(F.count(F.lit(1)).alias("nodes"), F.max("n_train").alias("n_train"))


@query("forest_shape", f"""
SELECT feed_id, {C.FOREST_TREES} AS trees, count(*) AS n_train, count(*) AS sample_size, {C.FOREST_TREES} AS roots, true AS binary
FROM (SELECT * FROM c_frm WHERE pos <= {C.BASELINE_FRAMES}) GROUP BY 1""")
def forest_shape(spark, sf):
    """What can be said of the stored trees without their random draws: every inner node has two children that exist."""
    _, model = _forest(spark, sf)
    n = iforest.nodes(cut(model))
    inner = n.filter("feature >= 0")
    children = inner.select("feed_id", F.explode(F.array("left", "right")).alias("node")).join(
        n.select("feed_id", "node"), ["feed_id", "node"], "left_semi").groupBy("feed_id").agg(F.count(F.lit(1)).alias("children"))
    return n.groupBy("feed_id").agg(
        F.countDistinct("tree").cast("int").alias("trees"), F.max("n_train").alias("n_train"),
        F.max("sample_size").cast("bigint").alias("sample_size"),
        F.count_if(F.col("node") < C.FOREST_TREES).cast("int").alias("roots"),
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("feature") >= 0).alias("inner"),
    ).join(children, "feed_id", "left").select(
        "feed_id", "trees", "n_train", "sample_size", "roots",
        ((F.col("nodes") == F.col("roots") + 2 * F.col("inner"))
         & (F.coalesce("children", F.lit(0)) == 2 * F.col("inner"))).alias("binary"))


@query("forest_scores")
def forest_scores(spark, sf):
    feats, model = _forest(spark, sf)
    return iforest.score(feats, model).select(*KEY, exact_round("model_score", 4).alias("model_score"))


@query("forest_session_levels")
def forest_session_levels(spark, sf):
    feats, model = _forest(spark, sf)
    s = anomaly.score_frames(facts(spark, sf), iforest.score(feats, model))
    return s.groupBy("feed_id", "alert_level").agg(F.count(F.lit(1)).alias("frames"))


def _threats(spark, sf):
    feats, model = _forest(spark, sf)
    base = T.baseline_frames(feats)
    return feats, cut(feed_forest.fit(TM.training_rows(base, iforest.score(base, model))))


@query("threat_labels")
def threat_labels(spark, sf):
    """Labels of all frames by the classifier of their feed."""
    feats, fitted = _threats(spark, sf)
    top = F.array_max(F.map_values("threat_proba"))
    return feed_forest.classify(feats, fitted).select(*KEY, "threat_label", exact_round(top, 4).alias("top_share"))


@query("threat_models", f"""
SELECT feed_id, count(*) AS n_samples, true AS labelled, true AS counted
FROM (SELECT * FROM c_frm WHERE pos <= {C.BASELINE_FRAMES}) GROUP BY 1""")
def threat_models(spark, sf):
    """A classifier per feed; in its trees the counts of two children are those of their parent."""
    _, fitted = _threats(spark, sf)
    # a node counts for itself and against its parent; both meet before the shuffle, as a feed's trees are one row
    n = feed_forest.nodes(fitted).select("feed_id", "tree", F.explode(F.array(
        F.struct("node", F.lit(0).alias("child"), "feature", *feed_forest.COUNTS),
        F.struct(F.expr("cast(node div 2 as int)").alias("node"), F.lit(1).alias("child"), F.lit(None).cast("int").alias("feature"),
                 *[(-F.col(c)).alias(c) for c in feed_forest.COUNTS]),
    )).alias("_n")).select("feed_id", "tree", "_n.*").filter("node > 0")
    met = n.groupBy("feed_id", "tree", "node").agg(
        F.max("feature").alias("feature"), F.sum("child").alias("children"), *[F.sum(c).alias(c) for c in feed_forest.COUNTS])
    same = F.col("children") == 2
    for c in feed_forest.COUNTS:
        same = same & (F.col(c) == 0)
    checked = met.groupBy("feed_id").agg(
        F.bool_and(F.when(F.col("feature") >= 0, same).otherwise(F.col("feature").isNotNull() & (F.col("children") == 0))).alias("counted"))
    return fitted.join(checked, "feed_id", "left").select(
        "feed_id", "n_samples", F.forall("labels", lambda x: x.isin(C.PRIORITIES)).alias("labelled"),
        F.coalesce("counted", F.lit(True)).alias("counted"))


# --- fusion and alerts ----------------------------------------------------------------

@query("fused_levels", """
SELECT feed_id, frame_id, alert_level, final_level, array_to_string(reasons, '|') AS reasons FROM c_fused""")
def fused_levels(spark, sf):
    return rule_frames(spark, sf).select(*KEY, "alert_level", "final_level", _joined().alias("reasons"))


_ALERT_COLS = "alert_id, feed_id, frame_id, priority, anomaly_score, anomaly_prob, alert_level, detection_count, motion_score, notified"


@query("alerts", f"SELECT {_ALERT_COLS}, {SQL_TIME} AS at, {JOINED} AS reasons FROM c_alert")
def alerts(spark, sf):
    return rule_alerts(spark, sf).withColumn("at", text_time()).drop("ts").withColumn("reasons", _joined())


@query("frame_priorities", """
SELECT feed_id, frame_id, CASE alert_level WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH'
  ELSE CASE WHEN motion_score > 8 THEN 'MEDIUM' ELSE 'LOW' END END AS priority,
  CASE alert_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 ELSE CASE WHEN motion_score > 8 THEN 1 ELSE 0 END END AS rank FROM c_scored""")
def frame_priorities(spark, sf):
    p = scores.priority("alert_level", "motion_score")
    s = anomaly.score_frames(facts(spark, sf)).withColumn("priority", p)
    return s.select(*KEY, "priority", scores.priority_rank("priority").alias("rank"))


@query("logged_alerts", "SELECT feed_id, count(*) AS logged FROM c_fused WHERE final_level <> 'normal' GROUP BY 1")
def logged_alerts(spark, sf):
    """Only non-normal frames are logged."""
    return A.create_alerts(rule_frames(spark, sf)).groupBy("feed_id").agg(F.count(F.lit(1)).alias("logged"))


@query("cooldown_keys", f"""
SELECT alert_id, coalesce(nullif(array_to_string(list_filter(['aircraft', 'crowd', 'military_vehicle', 'suspicious_object'], lambda c: contains({JOINED}, c)), ','), ''), 'generic') AS keys
FROM c_alert WHERE priority IN ('HIGH', 'CRITICAL')""")
def cooldown_keys(spark, sf):
    return A.notifiable(rule_alerts(spark, sf)).select("alert_id", F.array_join("cooldown_keys", ",").alias("keys"))


_KEYS = ["aircraft", "crowd", "military_vehicle", "suspicious_object"]


def _cooldown_sql(wait: int) -> str:
    """The rule as a walk over the alerts of each feed, one step per alert."""
    flags = ", ".join(f"contains({JOINED}, '{k}') AS k{i + 1}" for i, k in enumerate(_KEYS))
    any_key = " OR ".join(f"k{i + 1}" for i in range(4))
    clear = " AND ".join(f"(NOT k{i} OR sec - last[{i}] >= {wait})" for i in range(1, 6))
    update = ", ".join(f"CASE WHEN k{i} THEN sec ELSE last[{i}] END" for i in range(1, 6))
    start = ", ".join(["CAST(-1000000000000 AS BIGINT)"] * 5)
    return f"""
WITH a AS MATERIALIZED (SELECT *, NOT ({any_key}) AS k5 FROM (
  SELECT alert_id, feed_id, frame_id, priority, CAST(epoch(ts) AS BIGINT) AS sec, {flags},
    row_number() OVER (PARTITION BY feed_id ORDER BY ts, frame_id) AS i FROM c_alert WHERE priority IN ('HIGH', 'CRITICAL'))),
walk AS (
  SELECT feed_id, CAST(0 AS BIGINT) AS i, [{start}] AS last, CAST(NULL AS VARCHAR) AS alert_id, CAST(0 AS BIGINT) AS frame_id,
    CAST(NULL AS VARCHAR) AS priority, false AS notify FROM (SELECT DISTINCT feed_id FROM a)
  UNION ALL
  SELECT feed_id, i, CASE WHEN ok THEN [{update}] ELSE last END, alert_id, frame_id, priority, ok FROM (
    SELECT a.*, walk.last, {clear} AS ok FROM walk JOIN a ON a.feed_id = walk.feed_id AND a.i = walk.i + 1))
SELECT alert_id, feed_id, frame_id, priority, notify FROM walk WHERE i > 0"""


@query("notifications", _cooldown_sql(43200))
def notifications(spark, sf):
    n = cooldown.notifications(rule_alerts(spark, sf), 43200)
    return n.select("alert_id", "feed_id", "frame_id", "priority", "notify")


# --- log views -----------------------------------------------------------------------

@query("newest_alerts", f"SELECT alert_id, priority, {SQL_TIME} AS at FROM c_alert ORDER BY ts DESC, feed_id DESC, frame_id DESC LIMIT 50")
def newest_alerts(spark, sf):
    return A.newest(rule_alerts(spark, sf), 50).select("alert_id", "priority", text_time().alias("at"))


@query("recent_log", "SELECT alert_id, frame_id FROM (SELECT * FROM c_alert ORDER BY ts DESC, feed_id DESC, frame_id DESC LIMIT 20) ORDER BY ts, feed_id, frame_id")
def recent_log(spark, sf):
    return A.recent_log(rule_alerts(spark, sf), 20).select("alert_id", "frame_id")


@query("rolling_log", """
SELECT feed_id, alert_id FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY ts DESC, frame_id DESC) AS rn FROM c_alert) WHERE rn <= 60""")
def rolling_log(spark, sf):
    return A.rolling_log(rule_alerts(spark, sf), 60).select("feed_id", "alert_id")


@query("alert_feed_times", """
SELECT alert_id, strftime(ts + INTERVAL 330 MINUTE, '%H:%M:%S') AS time_str, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS date_str FROM c_alert""")
def alert_feed_times(spark, sf):
    return A.display_times(rule_alerts(spark, sf)).select("alert_id", "time_str", "date_str")


@query("alert_display", """
SELECT alert_id, strftime(ts + INTERVAL 330 MINUTE, '%H:%M:%S') AS time_str, feed_id, frame_id, priority, anomaly_score, anomaly_prob,
  detection_count, motion_score, coalesce(reasons[1], '[]') AS reason, notified
FROM c_alert WHERE priority IN ('HIGH') ORDER BY ts DESC, feed_id DESC, frame_id DESC LIMIT 50""")
def alert_display(spark, sf):
    return A.display_rows(rule_alerts(spark, sf), ["HIGH"])


@query("to_notify", """
SELECT alert_id FROM (SELECT * FROM c_alert ORDER BY ts DESC, feed_id DESC, frame_id DESC LIMIT 50) WHERE priority = 'CRITICAL' AND NOT notified""")
def to_notify(spark, sf):
    return A.to_notify(rule_alerts(spark, sf)).select("alert_id")


@query("mark_notified", "SELECT alert_id, priority, frame_id % 3 = 0 AS notified FROM c_alert")
def mark_notified(spark, sf):
    a = rule_alerts(spark, sf)
    sent = D.frames(spark, sf).filter("frame_id % 3 = 0").select(A.alert_id().alias("alert_id"))
    return A.mark_notified(a, sent).select("alert_id", "priority", "notified")


_LOG_SQL = """
SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE 'alert_' || event_id END AS alert_id, user_id // 15 AS feed_id,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 240 END AS frame_id,
  CASE event_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
  CASE WHEN event_id % 6 = 0 THEN 0.0::DOUBLE ELSE value / 4 END AS anomaly_score,
  CASE WHEN event_id % 7 = 0 THEN 'normal' ELSE event_type END AS alert_level,
  CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS reasons, event_id % 11 = 1 AS notified, event_id % 97 = 96 AS broken FROM events"""
block("c_log", _LOG_SQL)


@query("alert_log_read", """
SELECT CASE WHEN broken THEN '' ELSE alert_id END AS alert_id, CASE WHEN broken THEN 0 ELSE feed_id END AS feed_id,
  CASE WHEN broken THEN 0 ELSE frame_id END AS frame_id, CASE WHEN broken THEN 'LOW' ELSE priority END AS priority,
  CASE WHEN broken THEN 0.0::DOUBLE ELSE anomaly_score END AS anomaly_score,
  CASE WHEN broken THEN 'normal' ELSE alert_level END AS alert_level, CASE WHEN broken THEN 0 ELSE reasons END AS reasons,
  notified AND NOT broken AS notified, broken AS is_corrupt FROM c_log""")
def alert_log_read(spark, sf):
    """Alert objects as JSON text with absent fields and some broken lines."""
    e = D.table(spark, sf, "events")
    def unless(cond, v):
        return F.when(~F.expr(cond), v)
    obj = F.to_json(F.struct(
        unless("event_id % 3 = 0", F.concat(F.lit("alert_"), F.col("event_id"))).alias("alert_id"),
        F.expr("user_id div 15").alias("feed_id"),
        unless("event_id % 5 = 0", F.col("event_id") % 240).alias("frame_id"),
        F.expr("CASE event_id % 4 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' END").alias("priority"),
        unless("event_id % 6 = 0", F.col("value") / 4).alias("anomaly_score"),
        unless("event_id % 7 = 0", F.col("event_type")).alias("alert_level"),
        unless("event_id % 2 = 0", F.array("event_type")).alias("reasons"),
        F.when(F.expr("event_id % 11 = 1"), True).alias("notified"),
    ))
    lines = e.select(F.when(F.expr("event_id % 97 = 96"), F.concat(F.lit("{"), obj)).otherwise(obj).alias("value"))
    a = records.parse_alerts(lines)
    return a.select("alert_id", "feed_id", "frame_id", "priority", "anomaly_score", "alert_level",
                    F.size("reasons").alias("reasons"), "notified", "is_corrupt")


def scratch(spark, name) -> str:
    """A new folder beside the checkpoints, for queries that write and read again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@query("alert_array_read", """
SELECT 'alert_{' || event_id || '}' AS alert_id, user_id // 15 AS feed_id, event_id % 240 AS frame_id,
  CASE event_id % 4 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority, 2 AS reasons,
  'said "' || event_type || '\\"} {' AS first_reason, false AS is_corrupt FROM events""")
def alert_array_read(spark, sf):
    """Arrays of alerts, one per file, written and read again; braces and quotes stand in their texts."""
    obj = F.to_json(F.struct(
        F.expr("concat('alert_{', event_id, '}')").alias("alert_id"), F.expr("user_id div 15").alias("feed_id"),
        (F.col("event_id") % 240).alias("frame_id"),
        F.expr("CASE event_id % 4 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' END").alias("priority"),
        F.array(F.concat(F.lit('said "'), "event_type", F.lit('\\"} {')), "event_type").alias("reasons")))
    path = scratch(spark, "arrays")
    json_arrays.write_arrays(D.table(spark, sf, "events").select(obj.alias("value")), path)
    return records.read_alert_array(spark, path).select(
        "alert_id", "feed_id", "frame_id", "priority", F.size("reasons").alias("reasons"),
        F.get("reasons", F.lit(0)).alias("first_reason"), "is_corrupt")


@query("alert_store", """
SELECT alert_id, feed_id, frame_id, CASE WHEN frame_id % 11 = 0 THEN 'LOW' ELSE priority END AS priority, frame_id % 7 = 0 AS notified FROM c_alert""")
def alert_store(spark, sf):
    """Alerts written as versions: all of them, those notified, those whose priority changed; merged and read again."""
    path = scratch(spark, "store")
    first = cut(rule_alerts(spark, sf).select("alert_id", "feed_id", "frame_id", "priority", "notified"))
    marked = F.col("frame_id") % 7 == 0
    store.append(first.withColumn("written_at", F.lit(1)), path)
    store.append(first.filter(marked).withColumns({"notified": F.lit(True), "written_at": F.lit(2)}), path)
    lower = first.filter("frame_id % 11 = 0").withColumns({"priority": F.lit("LOW"), "notified": marked, "written_at": F.lit(3)})
    store.append(lower, path)
    store.compact(spark, path, least=3)
    return store.read(spark, path).drop("written_at")


@query("alert_json", """
SELECT alert_id, priority, frame_id, len(reasons) AS reasons, reasons[1] AS first_reason FROM c_alert""")
def alert_json(spark, sf):
    """Alerts written as JSON and read back."""
    a = rule_alerts(spark, sf)
    text_rows = a.select(F.to_json(F.struct("alert_id", "feed_id", "frame_id", "priority", "reasons")).alias("value"))
    back = records.parse_alerts(text_rows)
    return back.select("alert_id", "priority", "frame_id", F.size("reasons").cast("bigint").alias("reasons"),
                       F.try_element_at("reasons", F.lit(1)).alias("first_reason"))


# --- alert statistics ------------------------------------------------------------------

@query("alert_summary", """
SELECT feed_id, count(*) AS total_alerts, count(*) FILTER (priority = 'CRITICAL') AS critical_count, count(*) FILTER (priority = 'HIGH') AS high_count,
  count(*) FILTER (priority = 'MEDIUM') AS medium_count, count(*) FILTER (priority = 'LOW') AS low_count FROM c_alert GROUP BY 1""")
def alert_summary(spark, sf):
    return A.alert_summary(rule_alerts(spark, sf), ["feed_id"])


@query("alerts_by_priority", "SELECT priority, count(*) AS alerts FROM c_alert GROUP BY 1")
def alerts_by_priority(spark, sf):
    return A.by_priority(rule_alerts(spark, sf))


@query("priority_share", """
SELECT p AS priority, count(a.alert_id) AS alerts, round(count(a.alert_id) / greatest((SELECT count(*) FROM c_alert), 1) * 100, 1) AS share_pct
FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) t(p) LEFT JOIN c_alert a ON a.priority = p GROUP BY 1""")
def priority_share(spark, sf):
    return A.priority_share(rule_alerts(spark, sf))


@query("hourly_alerts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, priority, count(*) AS alerts FROM c_alert GROUP BY 1, 2")
def hourly_alerts(spark, sf):
    return A.hourly(rule_alerts(spark, sf)).withColumn("hour", text_time("hour"))


@query("kpis", """
SELECT (SELECT count(*) FROM c_alert) AS total_alerts, (SELECT count(*) FROM c_alert WHERE priority = 'CRITICAL') AS critical,
  (SELECT count(*) FROM c_alert WHERE priority = 'HIGH') AS high, CAST(sum(detection_count) AS BIGINT) AS total_detections,
  round(count(*) FILTER (pos > 30 AND alert_level <> 'normal') / count(*) FILTER (pos > 30), 4) AS alert_rate FROM c_fused""")
def kpis(spark, sf):
    t = _session_rows(spark, sf)
    return R.kpis(rule_alerts(spark, sf), S.session_summary(t))


def _session_rows(spark, sf):
    """Session rows without tracks, so that plain SQL can check the counters."""
    empty = F.array().cast("array<struct<alert_type:string,severity:string,description:string,details:string>>")
    return rule_frames(spark, sf).withColumns({
        "phase": F.when(F.col("pos") <= C.BASELINE_FRAMES, "baseline").otherwise("scored"),
        "alerts": F.coalesce(T.window_alert_list(), empty), "approaching_count": F.lit(0), "loitering_count": F.lit(0),
        "tracked_objects": F.lit(0), "temporal_risk": F.lit(0.0),
    })


@query("session_summary", """
SELECT feed_id, count(*) AS total_frames, count(*) FILTER (pos <= 30) AS baseline_frames, count(*) FILTER (pos > 30) AS frames_scored,
  false AS model_fitted, CAST(sum(detection_count) AS BIGINT) AS total_detections,
  count(*) FILTER (pos > 30 AND alert_level = 'normal') AS normal_frames, count(*) FILTER (pos > 30 AND alert_level = 'high') AS high_alert_frames,
  count(*) FILTER (pos > 30 AND alert_level = 'critical') AS critical_frames, count(*) FILTER (pos > 30 AND final_level <> 'normal') AS alerts_raised,
  round(count(*) FILTER (pos > 30 AND alert_level <> 'normal') / greatest(count(*) FILTER (pos > 30), 1), 4) AS alert_rate,
  CAST(sum(violation_count) AS BIGINT) AS total_zone_violations, count(*) FILTER (max_severity = 'RESTRICTED') AS zone_critical_count,
  count(*) FILTER (violation_count > 0 AND max_severity <> 'RESTRICTED') AS zone_buffer_count,
  CAST(sum(CAST(is_sudden AS INTEGER) + CAST(is_buildup AS INTEGER)) AS BIGINT) AS total_temporal_alerts,
  round(avg(inference_ms), 2) AS avg_inference_ms, CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE) AS elapsed_seconds
FROM c_fused GROUP BY 1""")
def session_summary(spark, sf):
    s = S.session_summary(_session_rows(spark, sf))
    return s.drop("temporal_approach_count", "temporal_loiter_count", "effective_fps")


@query("frame_report_join", """
SELECT feed_id, frame_id, detection_count, round(anomaly_score, 4) AS anomaly_score, alert_level, round(zone_risk, 4) AS zone_risk,
  max_severity AS zone_severity, violation_count AS zone_violations, CAST(is_sudden AS INTEGER) + CAST(is_buildup AS INTEGER) AS temporal_alerts,
  round(detection_trend, 4) AS detection_trend FROM c_fused WHERE pos > 30""")
def frame_report_join(spark, sf):
    return S.frame_report(_session_rows(spark, sf)).drop("temporal_risk", "tracked_objects")


@query("capped_violations", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY feed_id, frame_id ORDER BY det_id) AS r1 FROM c_viol),
b AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY frame_id, det_id) AS r2 FROM a WHERE r1 <= 5),
c AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY frame_id DESC, det_id DESC) AS r3 FROM b WHERE r2 <= 200)
SELECT feed_id, frame_id, det_id, reason FROM c WHERE r3 <= 50""")
def capped_violations(spark, sf):
    from scenespark.operators import zones as Z

    v = Z.violations(zoned(spark, sf)).select("feed_id", "frame_id", "det_id", "reason")
    return S.capped_records(v, "det_id", 5, 200, 50)


@query("capped_window_alerts", """
WITH a AS (SELECT feed_id, frame_id, 'sudden_appearance' AS alert_type FROM c_stats10 WHERE is_sudden
  UNION ALL SELECT feed_id, frame_id, 'crowd_buildup' FROM c_stats10 WHERE is_buildup),
b AS (SELECT *, row_number() OVER (PARTITION BY feed_id, frame_id ORDER BY alert_type DESC) AS r1, row_number() OVER (PARTITION BY feed_id ORDER BY frame_id, alert_type DESC) AS r2 FROM a)
SELECT feed_id, frame_id, alert_type FROM b WHERE r1 <= 3 AND r2 <= 8""")
def capped_window_alerts(spark, sf):
    s = T.window_stats(facts(spark, sf), 10)
    rows = s.select(*KEY, F.posexplode(T.window_alert_list()).alias("no", "a")).select(*KEY, "no", "a.alert_type")
    return S.capped_records(rows, "no", 3, 8).drop("no")


@query("anomaly_timeline", """
SELECT feed_id, frame_id, round(anomaly_score, 4) AS anomaly_score,
  CASE WHEN anomaly_score < -0.15 THEN 'CRITICAL' WHEN anomaly_score < -0.05 THEN 'HIGH' ELSE 'NORMAL' END AS band FROM c_scored""")
def anomaly_timeline(spark, sf):
    return R.anomaly_timeline(anomaly.score_frames(facts(spark, sf)))


@query("motion_timeline", "SELECT feed_id, frame_id, motion_score, motion_score > 8 AS above_medium FROM c_frm WHERE motion_score IS NOT NULL")
def motion_timeline(spark, sf):
    return R.motion_timeline(D.frames(spark, sf))


@query("hotspots_by_risk", """
SELECT CASE n_regionkey WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS hotspots
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def hotspots_by_risk(spark, sf):
    """Suppliers stand in for places; their region gives the risk."""
    places = D.table(spark, sf, "supplier").join(
        D.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.expr("CASE n_regionkey WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END").alias("risk"))
    return R.hotspots_by_risk(places)


# --- the whole session -----------------------------------------------------------------

@query("notifications_chained", _cooldown_sql(43200))
def notifications_chained(spark, sf):
    """The same with short blocks that hand their state on."""
    n = cooldown.notifications(rule_alerts(spark, sf), 43200, block_rows=25)
    return n.select("alert_id", "feed_id", "frame_id", "priority", "notify")


@query("session_alerts", f"""
WITH l AS (SELECT feed_id, frame_id, list('Loitering detected: ' || class_name || ' (track #' || track_id || ') stationary for ' || frame_count || ' frames at ('
      || printf('%.2f', x) || ', ' || printf('%.2f', y) || ')' ORDER BY track_id) AS loiter
  FROM c_live WHERE is_loitering GROUP BY 1, 2),
t AS (SELECT feed_id, frame_id, CASE WHEN is_approach THEN ['Border approach detected: ' || approach_n || ' object(s) moving toward border zone — ' || approach_classes] ELSE [] END AS a,
    CASE WHEN is_coordinated THEN ['Coordinated movement: ' || coordinated || ' objects moving in the same direction'] ELSE [] END AS c FROM c_temporal)
SELECT 'alert_' || feed_id || '_' || frame_id AS alert_id, feed_id, frame_id,
  CASE final_level WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' ELSE 'LOW' END AS priority,
  round(anomaly_score, 4) AS anomaly_score, round(anomaly_prob, 4) AS anomaly_prob, final_level AS alert_level, detection_count,
  round(motion_score, 4) AS motion_score, false AS notified, {SQL_TIME} AS at,
  array_to_string(list_concat(list_concat(anomaly_reasons, zone_reasons[1:3]),
    list_concat(list_concat(list_concat(temporal_reasons, coalesce(loiter, [])), a), c)[1:3]), '|') AS reasons
FROM c_session LEFT JOIN l USING (feed_id, frame_id) JOIN t USING (feed_id, frame_id) WHERE final_level <> 'normal' AND pos > 30""")
def session_alerts(spark, sf):
    """Alerts of the full analysis, tracks included."""
    t = S.frame_table(D.frames(spark, sf), detections(spark, sf))
    return S.alert_table(t).withColumn("at", text_time()).drop("ts").withColumn("reasons", _joined())


@query("session_counters", """
SELECT feed_id, count(*) AS total_frames, count(*) FILTER (pos <= 30) AS baseline_frames, count(*) FILTER (pos > 30) AS frames_scored,
  false AS model_fitted, CAST(sum(detection_count) AS BIGINT) AS total_detections,
  count(*) FILTER (pos > 30 AND alert_level = 'normal') AS normal_frames, count(*) FILTER (pos > 30 AND alert_level = 'high') AS high_alert_frames,
  count(*) FILTER (pos > 30 AND alert_level = 'critical') AS critical_frames, count(*) FILTER (pos > 30 AND final_level <> 'normal') AS alerts_raised,
  round(count(*) FILTER (pos > 30 AND alert_level <> 'normal') / greatest(count(*) FILTER (pos > 30), 1), 4) AS alert_rate,
  CAST(sum(violation_count) AS BIGINT) AS total_zone_violations, count(*) FILTER (max_severity = 'RESTRICTED') AS zone_critical_count,
  count(*) FILTER (violation_count > 0 AND max_severity <> 'RESTRICTED') AS zone_buffer_count, CAST(sum(temporal_alerts) AS BIGINT) AS total_temporal_alerts,
  CAST(coalesce(sum(approaching_count) FILTER (temporal_alerts > 0), 0) AS BIGINT) AS temporal_approach_count,
  CAST(coalesce(sum(loitering_count) FILTER (temporal_alerts > 0), 0) AS BIGINT) AS temporal_loiter_count,
  round(avg(inference_ms), 2) AS avg_inference_ms, CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE) AS elapsed_seconds,
  round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 0.001), 2) AS effective_fps FROM c_session GROUP BY 1""")
def session_counters(spark, sf):
    return S.session_summary(S.frame_table(D.frames(spark, sf), detections(spark, sf)))


@query("session_timings", """
SELECT feed_id, count(*) FILTER (pos > 30) AS frames_scored,
  round(coalesce(sum(CAST(frame_id % 7 AS DOUBLE) / 4) FILTER (pos > 30), 0) / greatest(count(*) FILTER (pos > 30), 1), 2) AS avg_zone_ms,
  round(coalesce(sum(CAST(frame_id % 11 AS DOUBLE) / 8) FILTER (pos > 30), 0) / greatest(count(*) FILTER (pos > 30), 1), 2) AS avg_temporal_ms
FROM c_fused GROUP BY 1""")
def session_timings(spark, sf):
    """Mean milliseconds of the stages over the scored frames."""
    timed = _session_rows(spark, sf).withColumns({
        "zone_ms": (F.col("frame_id") % 7).cast("double") / 4, "temporal_ms": (F.col("frame_id") % 11).cast("double") / 8})
    return S.session_summary(timed, ["zone_ms", "temporal_ms"]).select("feed_id", "frames_scored", "avg_zone_ms", "avg_temporal_ms")


@query("session_analysis_log", """
SELECT feed_id, 'enhanced' AS pipeline_type, count(*) AS total_frames, least(500, count(*) FILTER (pos > 30)) AS frames,
  min(frame_id) FILTER (pos > 30) AS first_frame, CAST(sum(violation_count) AS BIGINT) AS zone_violations,
  CAST(sum(zb) AS BIGINT) AS border_zone, CAST(sum(temporal_alerts) AS BIGINT) AS temporal_alerts,
  max_by(tracked_objects, frame_id) AS active_tracks FROM c_session GROUP BY 1""")
def session_analysis_log(spark, sf):
    """The analysis log of each feed, written a document per line and read again."""
    path = scratch(spark, "analysis")
    tables.write_documents(S.analysis_log(cut(S.frame_table(D.frames(spark, sf), detections(spark, sf)))), path)
    schema = ("pipeline_type string, total_frames long, frames array<struct<frame_id: long>>, zone_summary struct<total_violations: long, "
              "violations_by_zone: map<string, long>>, temporal_summary struct<total_temporal_alerts: long, active_tracks: long>")
    d = spark.read.text(path).select(F.col("feed_id").cast("bigint").alias("feed_id"), F.from_json("value", schema).alias("d"))
    return d.select(
        "feed_id", "d.pipeline_type", "d.total_frames", F.size("d.frames").cast("bigint").alias("frames"),
        F.get("d.frames", F.lit(0))["frame_id"].alias("first_frame"), F.col("d.zone_summary.total_violations").alias("zone_violations"),
        F.col("d.zone_summary.violations_by_zone")["border_zone"].alias("border_zone"),
        F.col("d.temporal_summary.total_temporal_alerts").alias("temporal_alerts"), "d.temporal_summary.active_tracks")


@query("session_frame_report", """
SELECT feed_id, frame_id, detection_count, round(anomaly_score, 4) AS anomaly_score, alert_level, round(zone_risk, 4) AS zone_risk,
  max_severity AS zone_severity, violation_count AS zone_violations, round(temporal_risk, 4) AS temporal_risk, temporal_alerts, tracked_objects,
  round(detection_trend, 4) AS detection_trend FROM c_session WHERE pos > 30""")
def session_frame_report(spark, sf):
    return S.frame_report(S.frame_table(D.frames(spark, sf), detections(spark, sf)))


@query("skipped_frames_session")
def skipped_frames_session(spark, sf):
    """Every third frame only: tracks then survive a single missed frame."""
    opts = S.Options(frame_skip=3, window=10)
    return S.session_summary(S.frame_table(D.frames(spark, sf), detections(spark, sf), opts))


@query("session_models", """
SELECT feed_id, count(*) AS total_frames, count(*) FILTER (pos <= 30) >= 30 AS model_fitted, count(*) AS labelled FROM c_frm GROUP BY 1""")
def session_models(spark, sf):
    """A session that fits the forest and the classifier on its baseline."""
    opts = S.Options(scoring="forest", fit_threat=True)
    t = S.frame_table(D.frames(spark, sf), detections(spark, sf), opts)
    return t.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("total_frames"), F.bool_or("model_fitted").alias("model_fitted"),
        F.count_if(F.col("threat_label").isin(C.PRIORITIES)).alias("labelled"))


@query("session_documents", """
WITH s AS (SELECT feed_id, count(*) FILTER (pos > 30 AND final_level <> 'normal') AS alerts_raised,
    least(50, sum(least(3, temporal_alerts))) AS temporal FROM c_session GROUP BY 1),
v AS (SELECT feed_id, least(50, sum(least(5, n))) AS violations FROM (
    SELECT feed_id, frame_id, count(*) AS n FROM c_viol GROUP BY 1, 2) GROUP BY 1)
SELECT feed_id, 'session' AS kind, '' AS alert_id, CAST(alerts_raised AS BIGINT) AS alerts_raised,
  CAST(coalesce(violations, 0) AS BIGINT) AS violations, CAST(temporal AS BIGINT) AS temporal FROM s LEFT JOIN v USING (feed_id)
UNION ALL SELECT feed_id, 'alert', 'alert_' || feed_id || '_' || frame_id, 0, 0, 0 FROM c_session WHERE final_level <> 'normal' AND pos > 30""")
def session_documents(spark, sf):
    from scenespark.operators import tracking as K, zones as Z
    from scenespark.operators.checkpoints import cut

    t = cut(S.frame_table(D.frames(spark, sf), detections(spark, sf)))
    docs = S.session_documents(t, S.alert_table(t), Z.violations(zoned(spark, sf)), K.temporal_alerts(t))

    def field(name):
        return F.get_json_object("document", f"$.{name}")

    def listed(name):
        return F.coalesce(F.json_array_length(field(name)), F.lit(0)).cast("bigint")

    return docs.select(
        "feed_id", "kind", F.coalesce(field("alert_id"), F.lit("")).alias("alert_id"),
        F.coalesce(field("alerts_raised").cast("bigint"), F.lit(0)).alias("alerts_raised"),
        listed("zone_violations").alias("violations"), listed("temporal_alerts").alias("temporal"))
