"""Registered queries over detections, frames, zones, windows and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions import geometry as G, scores, sql as sql_functions
from scenespark.operators import alerts as A, anomaly, frames as FR, temporal as T, tracking as K, zones as Z
from scenespark.operators.checkpoints import cut
from scenespark.operators.frames import KEY
from scenespark.plans import reports as R
from scenespark.plans.registry import query
from scenespark.sources import derived as D, records


def detections(spark, sf) -> DataFrame:
    return FR.build_detections(D.raw_detections(spark, sf))


def zoned(spark, sf) -> DataFrame:
    return Z.assign_zones(detections(spark, sf))


def facts(spark, sf) -> DataFrame:
    return FR.frame_facts(D.frames(spark, sf), detections(spark, sf))


def risk(spark, sf) -> DataFrame:
    return Z.zone_risk(FR.frame_facts(D.frames(spark, sf), zoned(spark, sf), Z.zone_aggregates()))


def stats(spark, sf, window=C.WINDOW_SIZE) -> DataFrame:
    return T.window_stats(facts(spark, sf), window)


def rule_frames(spark, sf) -> DataFrame:
    """Frames with zones, window alerts, rule scores and fused reasons (no tracks)."""
    s = T.window_stats(risk(spark, sf))
    reasons = F.transform(T.window_alert_list(), lambda a: a["description"])
    return A.fuse(anomaly.score_frames(s.withColumn("temporal_reasons", reasons)))


def rule_alerts(spark, sf) -> DataFrame:
    return A.create_alerts(rule_frames(spark, sf).filter(F.col("pos") > C.BASELINE_FRAMES))


def text_time(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


SQL_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


# --- projections and filters --------------------------------------------------

@query("box_geometry", """
SELECT det_id, round(((x1 + x2) / 2) / 1280, 6) AS center_x, round(((y1 + y2) / 2) / 720, 6) AS center_y,
  round((x2 - x1) / 1280, 6) AS width_norm, round((y2 - y1) / 720, 6) AS height_norm,
  round(((x2 - x1) / 1280) * ((y2 - y1) / 720), 8) AS area_norm FROM c_raw""")
def box_geometry(spark, sf):
    d = FR.normalise_boxes(D.raw_detections(spark, sf), 1280, 720)
    return d.select("det_id", *[exact_round(c, 6).alias(c) for c in ("center_x", "center_y", "width_norm", "height_norm")],
                    exact_round("area_norm", 8).alias("area_norm"))


@query("class_lookup", """
SELECT det_id, class_id, """
       """CASE class_id WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle' WHEN 2 THEN 'crowd' WHEN 3 THEN 'military_vehicle'
  WHEN 4 THEN 'aircraft' WHEN 5 THEN 'ship' WHEN 6 THEN 'suspicious_object' ELSE 'class_' || class_id END AS class_name,
  CASE WHEN class_id IN (3, 6) THEN 'critical' WHEN class_id IN (2, 4) THEN 'high' WHEN class_id IN (0, 5) THEN 'medium' ELSE 'low' END AS threat_level
FROM (SELECT det_id, class_id + CASE WHEN det_id % 7 = 0 THEN 4 ELSE 0 END AS class_id FROM c_raw)""")
def class_lookup(spark, sf):
    """Some ids fall outside the dictionary and take the fallbacks."""
    odd = F.col("class_id") + F.when(F.col("det_id") % 7 == 0, 4).otherwise(0)
    return FR.name_classes(D.raw_detections(spark, sf).select("det_id", odd.alias("class_id")))


@query("class_table_join", """
SELECT class_name, threat_level, count(*) AS detections FROM c_det GROUP BY 1, 2""")
def class_table_join(spark, sf):
    """The same lookup as a join with the class table (seven rows, broadcast)."""
    return (
        D.raw_detections(spark, sf).select("class_id")
        .join(F.broadcast(FR.class_dim(spark)), "class_id", "left")
        .groupBy("class_name", "threat_level").agg(F.count(F.lit(1)).alias("detections"))
    )


@query("serialised_detections", f"""
SELECT feed_id, frame_id, {SQL_TIME} AS at, det_id, class_id, class_name, confidence, x1, y1, x2, y2,
  center_x, center_y, width_norm, height_norm, area_norm, threat_level FROM c_det""")
def serialised_detections(spark, sf):
    return detections(spark, sf).withColumn("at", text_time()).drop("ts")


@query("frame_features", """
SELECT feed_id, frame_id, CAST(detection_count AS DOUBLE) AS detection_count, CAST(len(classes) AS DOUBLE) AS class_diversity,
  round(CAST(CAST(avg_confidence AS FLOAT) AS DOUBLE), 4) AS avg_confidence, round(CAST(CAST(max_confidence AS FLOAT) AS DOUBLE), 4) AS max_confidence,
  CAST(critical_count AS DOUBLE) AS critical_count, round(CAST(CAST(avg_center_x AS FLOAT) AS DOUBLE), 4) AS avg_center_x,
  round(CAST(CAST(avg_center_y AS FLOAT) AS DOUBLE), 4) AS avg_center_y, round(CAST(CAST(avg_width_norm AS FLOAT) AS DOUBLE), 4) AS avg_width_norm,
  round(CAST(CAST(coalesce(motion_score, 0) AS FLOAT) AS DOUBLE), 4) AS motion, CASE WHEN suspicious THEN 1.0::DOUBLE ELSE 0 END AS suspicious_flag
FROM c_facts""")
def frame_features(spark, sf):
    f = FR.features(facts(spark, sf))
    return f.select(*KEY, *[exact_round(F.col(c).cast("double"), 4).alias(c) for c in C.FEATURES])


@query("standardised_features", """
WITH f AS (SELECT feed_id, frame_id, CAST(CAST(detection_count AS FLOAT) AS DOUBLE) AS a, CAST(CAST(avg_center_y AS FLOAT) AS DOUBLE) AS b,
  CAST(CAST(coalesce(motion_score, 0) AS FLOAT) AS DOUBLE) AS c FROM c_facts)
SELECT feed_id, frame_id, round((a - avg(a) OVER p) / stddev_pop(a) OVER p, 3) AS detection_count,
  round((b - avg(b) OVER p) / stddev_pop(b) OVER p, 3) AS avg_center_y, round((c - avg(c) OVER p) / stddev_pop(c) OVER p, 3) AS motion
FROM f WINDOW p AS (PARTITION BY feed_id)""")
def standardised_features(spark, sf):
    z = anomaly.standardise(FR.features(facts(spark, sf)), ["feed_id"])
    return z.select(*KEY, *[exact_round(c, 3).alias(c) for c in ("detection_count", "avg_center_y", "motion")])


@query("nested_frames", """
SELECT f.feed_id, f.frame_id, coalesce(d.items, 0) AS items, coalesce(d.first_classes, '') AS first_classes
FROM c_frm f LEFT JOIN (SELECT feed_id, frame_id, count(*) AS items,
  array_to_string((list(class_name ORDER BY det_id))[1:3], ',') AS first_classes FROM c_det GROUP BY 1, 2) d USING (feed_id, frame_id)""")
def nested_frames(spark, sf):
    n = FR.nested_frames(D.frames(spark, sf), detections(spark, sf).drop("ts"))
    names = F.transform(F.slice("detections", 1, 3), lambda d: d["class_name"])
    return n.select(*KEY, F.when(F.col("detections").isNull(), 0).otherwise(F.size("detections")).cast("bigint").alias("items"),
                    F.coalesce(F.array_join(names, ","), F.lit("")).alias("first_classes"))


@query("every_third_frame", "SELECT feed_id, frame_id, inference_ms FROM c_frm WHERE frame_id % 3 = 0")
def every_third_frame(spark, sf):
    return FR.keep_every(D.frames(spark, sf), 3).select(*KEY, "inference_ms")


@query("allowed_classes", """
SELECT det_id, class_id, round(confidence, 4) AS confidence FROM c_raw WHERE class_id IN (0, 3) AND confidence >= 0.5""")
def allowed_classes(spark, sf):
    d = FR.build_detections(D.raw_detections(spark, sf), min_confidence=0.5, classes=[0, 3])
    return d.select("det_id", "class_id", "confidence")


@query("confident_detections", """
SELECT feed_id, count(*) AS detections, round(min(confidence), 4) AS lowest FROM c_raw WHERE confidence >= 0.6 GROUP BY 1""")
def confident_detections(spark, sf):
    d = FR.build_detections(D.raw_detections(spark, sf), min_confidence=0.6)
    return d.groupBy("feed_id").agg(F.count(F.lit(1)).alias("detections"), F.min("confidence").alias("lowest"))


@query("first_frames", "SELECT feed_id, frame_id FROM c_frm WHERE pos <= 25")
def first_frames(spark, sf):
    return FR.first_frames(D.frames(spark, sf).select(*KEY), 25)


@query("feed_catalogue", """
SELECT feed_id, fps, total_frames, width, height, round(CASE WHEN fps > 0 THEN total_frames / fps ELSE 0 END, 4) AS duration
FROM (SELECT feed_id, CAST((feed_id % 4) * 10 AS DOUBLE) AS fps, count(*) AS total_frames, 640 AS width, 640 AS height FROM c_frm GROUP BY feed_id)""")
def feed_catalogue(spark, sf):
    """Some feeds report no frame rate and get a zero duration."""
    feeds = D.frames(spark, sf).groupBy("feed_id").agg(F.count(F.lit(1)).alias("total_frames")).withColumns({
        "fps": ((F.col("feed_id") % 4) * 10).cast("double"), "width": F.lit(640), "height": F.lit(640)})
    return records.feed_catalogue(feeds).withColumn("duration", exact_round("duration", 4))


@query("valid_emails", """
SELECT c_custkey AS id, regexp_full_match(trim(email), '[\\w.+-]+@[\\w-]+\\.[\\w.]+') AS is_valid
FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' user.' || c_custkey || '@mail-a.example ' WHEN 1 THEN 'user' || c_custkey || '@mail'
  WHEN 2 THEN 'a+b_' || c_custkey || '@x.example.org' WHEN 3 THEN '@x.org' WHEN 4 THEN 'u ' || c_custkey || '@x.org' ELSE 'u@x..' || c_custkey END AS email FROM customer)""")
def valid_emails(spark, sf):
    email = F.expr("""CASE c_custkey % 6 WHEN 0 THEN concat(' user.', c_custkey, '@mail-a.example ') WHEN 1 THEN concat('user', c_custkey, '@mail')
      WHEN 2 THEN concat('a+b_', c_custkey, '@x.example.org') WHEN 3 THEN '@x.org' WHEN 4 THEN concat('u ', c_custkey, '@x.org') ELSE concat('u@x..', c_custkey) END""")
    return D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), scores.is_email(email).alias("is_valid"))


# --- detection statistics -----------------------------------------------------

@query("detection_stats", """
SELECT f.feed_id, count(*) AS total_frames, CAST(sum(detection_count) AS BIGINT) AS total_detections,
  round(sum(detection_count) / count(*), 2) AS detections_per_frame, count(*) FILTER (has_critical) AS critical_frames,
  count(*) FILTER (has_high) AS high_frames,
  round(coalesce((SELECT CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS DOUBLE) / 10000 / count(*) FROM c_det d WHERE d.feed_id = f.feed_id), 0), 4) AS avg_confidence,
  round(avg(inference_ms), 2) AS avg_inference_ms
FROM c_facts f GROUP BY f.feed_id""")
def detection_stats(spark, sf):
    return FR.detection_stats(facts(spark, sf))


@query("overall_totals", """
SELECT count(*) AS total_frames, CAST(sum(detection_count) AS BIGINT) AS total_detections,
  round(sum(detection_count) / count(*), 1) AS average FROM c_facts""")
def overall_totals(spark, sf):
    return FR.detection_stats(facts(spark, sf), []).select(
        "total_frames", "total_detections",
        exact_round(F.col("total_detections") / F.greatest(F.col("total_frames"), F.lit(1)), 1).alias("average"))


@query("class_counts", "SELECT feed_id, class_name, count(*) AS detections FROM c_det GROUP BY 1, 2")
def class_counts(spark, sf):
    return FR.class_counts(detections(spark, sf))


@query("class_chart", "SELECT class_name, count(*) AS detections FROM c_det GROUP BY 1")
def class_chart(spark, sf):
    return R.class_chart(detections(spark, sf))


@query("frame_flags", "SELECT feed_id, frame_id, has_critical, has_high FROM c_facts")
def frame_flags(spark, sf):
    return facts(spark, sf).select(*KEY, "has_critical", "has_high")


@query("detection_density", """
SELECT greatest(0, least(CAST(floor(center_x * 20) AS BIGINT), 19)) AS bin_x, greatest(0, least(CAST(floor(center_y * 20) AS BIGINT), 19)) AS bin_y,
  count(*) AS detections FROM c_det GROUP BY 1, 2""")
def detection_density(spark, sf):
    return R.density(detections(spark, sf))


# --- zones ----------------------------------------------------------------------

@query("zone_violations", f"""
SELECT feed_id, frame_id, {SQL_TIME} AS at, det_id, zone_name, zone_level, zone_label, priority, class_name, confidence,
  center_x, center_y, is_high_threat, reason FROM c_viol""")
def zone_violations(spark, sf):
    return Z.violations(zoned(spark, sf)).withColumn("at", text_time()).drop("ts")


CUSTOM_ZONES = [
    {"name": "depot", "polygon": [(0.1, 0.1), (0.45, 0.15), (0.4, 0.6), (0.15, 0.55)], "level": "SAFE"},
    {"name": "gate", "polygon": [(0.3, 0.2), (0.9, 0.2), (0.6, 0.9)], "level": "RESTRICTED", "label": "Gate"},
    {"name": "yard", "polygon": [(0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0)]},
]
_EDGES = "(VALUES " + ", ".join(
    f"({i}, '{z['name']}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
    for i, z in enumerate(CUSTOM_ZONES)
    for a, b in zip(z["polygon"], z["polygon"][-1:] + z["polygon"][:-1])
) + ") e(zone_order, name, xi, yi, xj, yj)"
_CUSTOM_SQL = f"""
SELECT det_id, h.name AS zone_name, coalesce(h.name <> 'depot', false) AS is_violation
FROM c_det LEFT JOIN (
  SELECT det_id, min_by(name, zone_order) AS name FROM (
    SELECT det_id, zone_order, name FROM c_det, {_EDGES}
    WHERE ((yi > center_y) <> (yj > center_y)) AND center_x < (xj - xi) * (center_y - yi) / (yj - yi + 1e-12) + xi
    GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY det_id) h USING (det_id)"""


@query("custom_zones", _CUSTOM_SQL)
def custom_zones(spark, sf):
    """Overlapping polygons; the safe one comes first and absorbs its points."""
    return Z.assign_zones(detections(spark, sf), CUSTOM_ZONES).select("det_id", "zone_name", "is_violation")


@query("zone_table_join", _CUSTOM_SQL)
def zone_table_join(spark, sf):
    """The same zones from a table."""
    zones = Z.zone_table(spark, CUSTOM_ZONES)
    return Z.join_zones(detections(spark, sf), zones).select("det_id", "zone_name", "is_violation")


@query("polygon_function", """
SELECT feed_id, count(*) FILTER (center_x >= 0 AND center_x < 1 AND center_y >= 0 AND center_y < 0.25) AS inside, count(*) AS total FROM c_det GROUP BY 1""")
def polygon_function(spark, sf):
    """The SQL function on all detections."""
    sql_functions.register(spark)
    detections(spark, sf).createOrReplaceTempView("scenespark_detections")
    ring = "from_json('[{\"x\":0,\"y\":0},{\"x\":1,\"y\":0},{\"x\":1,\"y\":0.25},{\"x\":0,\"y\":0.25}]', 'array<struct<x:double,y:double>>')"
    return spark.sql(f"SELECT feed_id, count_if(point_in_polygon(center_x, center_y, {ring})) AS inside, count(1) AS total "
                     "FROM scenespark_detections GROUP BY feed_id")


@query("zone_frame_risk", """
SELECT feed_id, frame_id, violation_count, max_severity, zb AS border_zone, zu AS buffer_zone, zo AS observation_zone,
  round(zone_risk, 4) AS zone_risk, len(zone_reasons) AS reasons FROM c_zrisk""")
def zone_frame_risk(spark, sf):
    z = F.col("zone_scores")
    return risk(spark, sf).select(
        *KEY, "violation_count", "max_severity", *[z[n["name"]].alias(n["name"]) for n in C.DEFAULT_ZONES],
        exact_round("zone_risk", 4).alias("zone_risk"), F.size("zone_reasons").cast("bigint").alias("reasons"))


@query("zone_risk_by_day", "SELECT feed_id, frame_id, round(base_risk, 4) AS zone_risk FROM c_zrisk")
def zone_risk_by_day(spark, sf):
    """Risk without the night boost."""
    f = FR.frame_facts(D.frames(spark, sf), zoned(spark, sf), Z.zone_aggregates(reasons=False))
    return Z.zone_risk(f, night=False).select(*KEY, exact_round("zone_risk", 4).alias("zone_risk"))


@query("night_frames", "SELECT feed_id, count(*) FILTER (hour(ts) >= 21 OR hour(ts) < 5) AS night, count(*) AS total FROM c_frm GROUP BY 1")
def night_frames(spark, sf):
    return D.frames(spark, sf).groupBy("feed_id").agg(
        F.count_if(scores.is_night("ts")).alias("night"), F.count(F.lit(1)).alias("total"))


@query("zone_severity", """
SELECT max_severity, count(*) AS frames, max(CASE max_severity WHEN 'RESTRICTED' THEN 3 WHEN 'BUFFER' THEN 2 WHEN 'OBSERVATION' THEN 1 ELSE 0 END) AS rank
FROM c_zrisk GROUP BY 1""")
def zone_severity(spark, sf):
    return risk(spark, sf).groupBy("max_severity").agg(
        F.count(F.lit(1)).alias("frames"), F.max(scores.severity_rank("max_severity")).alias("rank"))


@query("zone_summary", """
SELECT feed_id, count(*) AS total_frames, CAST(sum(violation_count) AS BIGINT) AS total_violations,
  CAST(sum(zb) AS BIGINT) AS border_zone, CAST(sum(zu) AS BIGINT) AS buffer_zone, CAST(sum(zo) AS BIGINT) AS observation_zone, 3 AS zones_defined
FROM c_zrisk GROUP BY 1""")
def zone_summary(spark, sf):
    s = Z.zone_summary(risk(spark, sf))
    by = F.col("violations_by_zone")
    return s.select("feed_id", "total_frames", "total_violations", *[by[z["name"]].alias(z["name"]) for z in C.DEFAULT_ZONES], "zones_defined")


def table_risk(spark, sf) -> DataFrame:
    """Frame risk from a zone table with a set per feed."""
    zones = D.zone_sets(spark, sf)
    assigned = Z.assign_zones(detections(spark, sf), zones)
    found = FR.frame_facts(D.frames(spark, sf), assigned, Z.zone_aggregates(zones))
    return Z.zone_risk(found, zones, hits=Z.zone_hits(assigned))


@query("zone_table_risk", """
SELECT f.feed_id, f.frame_id, CAST(coalesce(violation_count, 0) AS BIGINT) AS violation_count,
  CASE coalesce(rank, 0) WHEN 3 THEN 'RESTRICTED' WHEN 2 THEN 'BUFFER' WHEN 1 THEN 'OBSERVATION' ELSE 'SAFE' END AS max_severity,
  coalesce(hits, '') AS zones,
  round(least(1.0::DOUBLE, least(1.0::DOUBLE, coalesce(risk, 0)) * CASE WHEN hour(ts) >= 21 OR hour(ts) < 5 THEN 1.3 ELSE 1 END), 4) AS zone_risk
FROM c_frm f LEFT JOIN (
  SELECT feed_id, frame_id, sum(n) FILTER (zone_level <> 'SAFE') AS violation_count,
    max(CASE zone_level WHEN 'RESTRICTED' THEN 3 WHEN 'BUFFER' THEN 2 WHEN 'OBSERVATION' THEN 1 ELSE 0 END) AS rank,
    string_agg(zone_name || ':' || n, ',' ORDER BY zone_order) AS hits,
    sum(CASE zone_level WHEN 'SAFE' THEN 0 ELSE
      CASE zone_level WHEN 'RESTRICTED' THEN 0.3 WHEN 'BUFFER' THEN 0.15 ELSE 0.05 END * n + 0.1 * (n - 1)
      + CASE zone_level WHEN 'RESTRICTED' THEN 0.15 * threats ELSE 0 END END)::DOUBLE AS risk
  FROM c_zcount GROUP BY 1, 2) z USING (feed_id, frame_id)""")
def zone_table_risk(spark, sf):
    """Risk per frame with thousands of zones of mixed sizes, a set per feed."""
    hits = F.transform(F.map_entries("zone_scores"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return table_risk(spark, sf).select(
        *KEY, "violation_count", "max_severity", F.array_join(hits, ",").alias("zones"),
        exact_round("zone_risk", 4).alias("zone_risk"))


@query("zone_table_summary", """
SELECT f.feed_id, f.total_frames, CAST(coalesce(t.total_violations, 0) AS BIGINT) AS total_violations, s.zones_defined,
  t.zone_name AS zone, CAST(t.n AS BIGINT) AS n
FROM (SELECT feed_id, count(*) AS total_frames FROM c_frm GROUP BY 1) f
JOIN (SELECT feed_id, CAST(count(*) AS INTEGER) AS zones_defined FROM c_zset GROUP BY 1) s USING (feed_id)
JOIN (
  SELECT feed_id, zone_name, CASE zone_level WHEN 'SAFE' THEN 0 ELSE sum(n) END AS n,
    sum(CASE zone_level WHEN 'SAFE' THEN 0 ELSE sum(n) END) OVER (PARTITION BY feed_id) AS total_violations
  FROM c_zcount GROUP BY feed_id, zone_name, zone_level) t USING (feed_id)""")
def zone_table_summary(spark, sf):
    """Totals per feed and the zones hit, a row per zone."""
    return Z.zone_summary(table_risk(spark, sf), D.zone_sets(spark, sf)).select(
        "feed_id", "total_frames", "total_violations", "zones_defined", F.explode("violations_by_zone").alias("zone", "n"))


@query("zone_listing", """
SELECT name, level, label, color, coalesce(n, 0) AS detections FROM (VALUES
  ('border_zone', 'RESTRICTED', 'Border Zone (Restricted)', '#e63946'), ('buffer_zone', 'BUFFER', 'Buffer Zone (Proximity)', '#f4a261'),
  ('observation_zone', 'OBSERVATION', 'Observation Zone (General)', '#2ec4b6')) z(name, level, label, color)
LEFT JOIN (SELECT zone_name, count(*) AS n FROM c_zone GROUP BY 1) ON name = zone_name""")
def zone_listing(spark, sf):
    hits = zoned(spark, sf).groupBy(F.col("zone_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return Z.zone_table(spark).join(hits, "name", "left").select(
        "name", "level", "label", "color", F.coalesce("n", F.lit(0)).alias("detections"))


# --- windows --------------------------------------------------------------------

def _window_sql(block):
    return f"""
SELECT feed_id, frame_id, window_size, round(prev_avg, 4) AS prev_avg, round(increase, 4) AS increase, is_sudden, is_buildup,
  round(detection_trend, 6) AS detection_trend, round(motion_trend, 4) AS motion_trend, prev_frame,
  CAST(window_start_persons AS BIGINT) AS window_start_persons FROM {block}"""


def _window_rows(s):
    return s.select(*KEY, "window_size", exact_round("prev_avg", 4).alias("prev_avg"), exact_round("increase", 4).alias("increase"),
                    "is_sudden", "is_buildup", exact_round("detection_trend", 6).alias("detection_trend"),
                    exact_round("motion_trend", 4).alias("motion_trend"), "prev_frame", "window_start_persons")


@query("window_statistics", _window_sql("c_stats"))
def window_statistics(spark, sf):
    return _window_rows(stats(spark, sf))


@query("window_statistics_short", _window_sql("c_stats10"))
def window_statistics_short(spark, sf):
    return _window_rows(stats(spark, sf, 10))


@query("window_statistics_blocked", _window_sql("c_stats10"))
def window_statistics_blocked(spark, sf):
    """The same with many small blocks: what a feed too long for one task gets."""
    return _window_rows(T.window_stats(facts(spark, sf), 10, block_rows=32))


@query("sudden_appearances", """
SELECT feed_id, frame_id, 'sudden_appearance' AS alert_type, 'HIGH' AS severity,
  'Sudden appearance: ' || CAST(trunc(increase) AS BIGINT) || ' new objects detected (was ' || printf('%.0f', prev_avg) || ', now ' || detection_count || ')' AS description
FROM c_stats WHERE is_sudden""")
def sudden_appearances(spark, sf):
    a = T.window_alerts(stats(spark, sf)).filter("alert_type = 'sudden_appearance'")
    return a.select(*KEY, "alert_type", "severity", "description")


@query("crowd_buildups", """
SELECT feed_id, frame_id, 'Crowd buildup detected: person count rising at ' || printf('%.2f', person_slope) || '/frame (now ' || persons || ' persons)' AS description
FROM c_stats10 WHERE is_buildup""")
def crowd_buildups(spark, sf):
    a = T.window_alerts(stats(spark, sf, 10)).filter("alert_type = 'crowd_buildup'")
    return a.select(*KEY, "description")


@query("window_alert_counts", """
SELECT feed_id, count(*) FILTER (is_sudden) AS sudden_appearance, count(*) FILTER (is_buildup) AS crowd_buildup, count(*) AS total_frames FROM c_stats GROUP BY 1""")
def window_alert_counts(spark, sf):
    return stats(spark, sf).groupBy("feed_id").agg(
        F.count_if("is_sudden").alias("sudden_appearance"), F.count_if("is_buildup").alias("crowd_buildup"),
        F.count(F.lit(1)).alias("total_frames"))


@query("baseline_frames", "SELECT feed_id, frame_id, CASE WHEN pos <= 30 THEN 'baseline' ELSE 'scored' END AS phase FROM c_frm")
def baseline_frames(spark, sf):
    placed = T.with_frame_position(D.frames(spark, sf).select(*KEY))
    return placed.select(*KEY, F.when(F.col("pos") <= C.BASELINE_FRAMES, "baseline").otherwise("scored").alias("phase"))


@query("baseline_selection", "SELECT feed_id, frame_id, motion_score FROM c_frm WHERE pos <= 30")
def baseline_selection(spark, sf):
    return T.baseline_frames(D.frames(spark, sf)).select(*KEY, "motion_score")


@query("effective_rate", """
SELECT feed_id, count(*) AS frames, CAST(epoch(max(ts)) - epoch(min(ts)) AS DOUBLE) AS elapsed_seconds,
  round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 0.001), 8) AS effective_fps FROM c_frm GROUP BY 1""")
def effective_rate(spark, sf):
    return T.effective_fps(D.frames(spark, sf)).withColumn("effective_fps", exact_round("effective_fps", 8))


@query("adjacent_overlaps", """
WITH f AS (SELECT feed_id, frame_id, lag(frame_id) OVER (PARTITION BY feed_id ORDER BY frame_id) AS prev_frame FROM c_frm),
p AS (SELECT d.feed_id, d.frame_id, f.prev_frame, d.det_id, q.det_id AS prev_det_id,
  greatest(0, least(d.x2, q.x2) - greatest(d.x1, q.x1)) * greatest(0, least(d.y2, q.y2) - greatest(d.y1, q.y1)) AS inter,
  (d.x2 - d.x1) * (d.y2 - d.y1) AS aa, (q.x2 - q.x1) * (q.y2 - q.y1) AS bb
  FROM c_det d JOIN f USING (feed_id, frame_id) JOIN c_det q ON q.feed_id = d.feed_id AND q.frame_id = f.prev_frame)
SELECT feed_id, frame_id, prev_frame, det_id, prev_det_id, round(inter / (aa + bb - inter), 6) AS iou FROM p WHERE inter / (aa + bb - inter) >= 0.3""")
def adjacent_overlaps(spark, sf):
    p = T.pairwise_iou(detections(spark, sf), D.frames(spark, sf))
    return p.withColumn("iou", exact_round("iou", 6))


@query("box_overlap", """
SELECT det_id, round(inter / (36.0 * 160 + 46.0 * 160 - inter), 6) AS iou FROM (
  SELECT det_id, greatest(0, least(x2, x2 + 20) - greatest(x1, x1 + 10)) * greatest(0, least(y2, y2 + 40) - greatest(y1, y1 + 40)) AS inter FROM c_det)""")
def box_overlap(spark, sf):
    """Overlap of each box with a moved, wider copy; also through the SQL function."""
    sql_functions.register(spark)
    d = detections(spark, sf)
    other = (F.col("x1") + 10, F.col("y1") + 40, F.col("x2") + 20, F.col("y2") + 40)
    d = d.withColumn("iou", exact_round(G.iou(("x1", "y1", "x2", "y2"), other), 6))
    check = exact_round(F.call_function("iou", F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), *other), 6)
    return d.select("det_id", F.when(check == F.col("iou"), F.col("iou")).alias("iou"))


# --- tracks -----------------------------------------------------------------------

def _lanes(spark, sf) -> DataFrame:
    """A simple track table: the detections of one user are one track."""
    lane = D._events(spark, sf).select(F.col("event_id").alias("det_id"), F.col("u").alias("lane"))
    return detections(spark, sf).select(*KEY, "det_id", "center_x", "center_y").join(lane, "det_id")


@query("track_motion", """
WITH l AS (SELECT d.feed_id, d.frame_id, d.det_id, e.u AS lane, d.center_x, d.center_y FROM c_det d JOIN c_ev e ON e.event_id = d.det_id),
w AS (SELECT *, row_number() OVER t AS frame_count, lead(frame_id) OVER t AS next_frame,
  center_y - first_value(center_y) OVER k AS dy, max(center_x) OVER k - min(center_x) OVER k AS xr, max(center_y) OVER k - min(center_y) OVER k AS yr,
  center_x - lag(center_x, 2) OVER t AS vx, center_y - lag(center_y, 2) OVER t AS vy
  FROM l WINDOW t AS (PARTITION BY feed_id, lane ORDER BY frame_id, det_id),
    k AS (PARTITION BY feed_id, lane ORDER BY frame_id, det_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT feed_id, lane, frame_id, det_id, frame_count, next_frame, round(dy, 4) AS y_displacement, dy < -0.05 AS is_approaching,
  frame_count >= 10 AND xr < 0.08 AND yr < 0.08 AS is_loitering,
  round(CASE WHEN sqrt(vx * vx + vy * vy) > 0.01 THEN vx / sqrt(vx * vx + vy * vy) END, 4) AS dir_x,
  round(CASE WHEN sqrt(vx * vx + vy * vy) > 0.01 THEN vy / sqrt(vx * vx + vy * vy) END, 4) AS dir_y FROM w""")
def track_motion(spark, sf):
    """Displacement, loitering and direction over the retained positions of a track."""
    m = K.track_motion(_lanes(spark, sf), ["feed_id", "lane"])
    return m.select("feed_id", "lane", "frame_id", "det_id", "frame_count", "next_frame", exact_round("y_displacement", 4).alias("y_displacement"),
                    "is_approaching", "is_loitering", exact_round("dir_x", 4).alias("dir_x"), exact_round("dir_y", 4).alias("dir_y"))


def _observed(spark, sf):
    # frame facts feed the windows, the chunks and the tracks
    f = cut(T.with_frame_position(facts(spark, sf)))
    return K.observations(detections(spark, sf), f), f


def _temporal(spark, sf):
    obs, f = _observed(spark, sf)
    return K.temporal_frames(T.window_stats(f), K.track_facts(K.live_tracks(obs, f)))


@query("track_observations", """
SELECT feed_id, frame_id, det_id, track_id, class_name, frame_count, round(y - y0, 4) AS y_displacement, is_approaching, is_loitering FROM c_obs""")
def track_observations(spark, sf):
    obs, _ = _observed(spark, sf)
    return obs.select(*KEY, "det_id", "track_id", "class_name", "frame_count", exact_round("y_displacement", 4).alias("y_displacement"),
                      "is_approaching", "is_loitering")


@query("track_observations_chained", """
SELECT feed_id, frame_id, det_id, track_id, frame_count FROM c_obs""")
def track_observations_chained(spark, sf):
    """Short blocks, so that chunks continue one another."""
    return K.observations(detections(spark, sf), facts(spark, sf), 100).select(*KEY, "det_id", "track_id", "frame_count")


@query("track_listing", """
SELECT l.feed_id, l.frame_id, l.track_id, l.class_name, round(l.x, 4) AS center_x, round(l.y, 4) AS center_y, l.frame_count, l.is_approaching, l.is_loitering, p.positions
FROM c_live l JOIN (SELECT feed_id, track_id, frame_id, string_agg(x || ' ' || y, ';') OVER (PARTITION BY feed_id, track_id ORDER BY frame_id
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS positions FROM c_obs) p ON p.feed_id = l.feed_id AND p.track_id = l.track_id AND p.frame_id = l.seen_frame""")
def track_listing(spark, sf):
    obs, _ = _observed(spark, sf)
    t = K.track_listing(obs, D.frames(spark, sf))
    points = F.transform("positions", lambda p: F.concat(p["x"], F.lit(" "), p["y"]))
    return t.withColumn("positions", F.array_join(points, ";"))


_DETAILS = {
    "sudden_appearance": ("previous_avg", "current_count", "increase"),
    "crowd_buildup": ("buildup_rate", "current_persons", "window_start_persons"),
    "loitering": ("track_id", "center_x", "center_y"),
    "approach_trajectory": ("approaching_count",),
    "coordinated_movement": ("coordinated_count", "total_moving"),
}


@query("temporal_alerts", f"""
WITH a AS (
  SELECT feed_id, frame_id, 1 AS k, 0 AS n, 'sudden_appearance' AS alert_type, 'HIGH' AS severity, temporal_reasons[1] AS description,
    CAST(printf('%.1f', prev_avg) AS DOUBLE) AS d1, CAST(detection_count AS DOUBLE) AS d2, CAST(printf('%.1f', increase) AS DOUBLE) AS d3
  FROM c_fused WHERE is_sudden
  UNION ALL SELECT feed_id, frame_id, 2, 0, 'crowd_buildup', 'HIGH', temporal_reasons[-1],
    CAST(printf('%.4f', person_slope) AS DOUBLE), CAST(persons AS DOUBLE), CAST(window_start_persons AS DOUBLE) FROM c_fused WHERE is_buildup
  UNION ALL SELECT feed_id, frame_id, 3, track_id, 'loitering', 'MEDIUM', 'Loitering detected: ' || class_name || ' (track #' || track_id || ') stationary for ' || frame_count || ' frames at ('
      || printf('%.2f', x) || ', ' || printf('%.2f', y) || ')',
    CAST(track_id AS DOUBLE), CAST(printf('%.4f', x) AS DOUBLE), CAST(printf('%.4f', y) AS DOUBLE) FROM c_live WHERE is_loitering AND pos >= 3
  UNION ALL SELECT feed_id, frame_id, 4, 0, 'approach_trajectory', CASE WHEN approach_critical THEN 'CRITICAL' ELSE 'HIGH' END,
    'Border approach detected: ' || approach_n || ' object(s) moving toward border zone — ' || approach_classes, CAST(approach_n AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM c_temporal WHERE is_approach
  UNION ALL SELECT feed_id, frame_id, 5, 0, 'coordinated_movement', 'HIGH', 'Coordinated movement: ' || coordinated || ' objects moving in the same direction',
    CAST(coordinated AS DOUBLE), CAST(moving AS DOUBLE), 0.0::DOUBLE FROM c_temporal WHERE is_coordinated)
SELECT feed_id, frame_id, {SQL_TIME} AS at, row_number() OVER (PARTITION BY feed_id, frame_id ORDER BY k, n) - 1 AS alert_no,
  alert_type, severity, description, d1, d2, d3 FROM a JOIN c_frm USING (feed_id, frame_id)""")
def temporal_alerts(spark, sf):
    """All alerts of tracks and windows; the numbers in their details as d1 to d3."""
    def number(i):
        paths = {k: v[i] for k, v in _DETAILS.items() if len(v) > i}
        value = F.lit(None).cast("string")
        for kind, path in paths.items():
            value = F.when(F.col("alert_type") == kind, F.get_json_object("details", f"$.{path}")).otherwise(value)
        return F.coalesce(value.cast("double"), F.lit(0.0))

    a = K.temporal_alerts(_temporal(spark, sf))
    return a.select(
        *KEY, text_time().alias("at"), F.col("alert_no").cast("bigint").alias("alert_no"), "alert_type", "severity",
        "description", *[number(i).alias(f"d{i + 1}") for i in range(3)])


@query("loitering_alerts", """
SELECT feed_id, frame_id, 'Loitering detected: ' || class_name || ' (track #' || track_id || ') stationary for ' || frame_count || ' frames at ('
  || printf('%.2f', x) || ', ' || printf('%.2f', y) || ')' AS description FROM c_live WHERE is_loitering AND pos >= 3""")
def loitering_alerts(spark, sf):
    a = K.temporal_alerts(_temporal(spark, sf)).filter("alert_type = 'loitering'")
    return a.select(*KEY, "description")


@query("approach_alerts", """
SELECT feed_id, frame_id, CASE WHEN approach_critical THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
  'Border approach detected: ' || approach_n || ' object(s) moving toward border zone — ' || approach_classes AS description FROM c_temporal WHERE is_approach""")
def approach_alerts(spark, sf):
    a = K.temporal_alerts(_temporal(spark, sf)).filter("alert_type = 'approach_trajectory'")
    return a.select(*KEY, "severity", "description")


@query("coordinated_movement", """
SELECT feed_id, frame_id, 'Coordinated movement: ' || coordinated || ' objects moving in the same direction' AS description FROM c_temporal WHERE is_coordinated""")
def coordinated_movement(spark, sf):
    return K.temporal_alerts(_temporal(spark, sf)).filter("alert_type = 'coordinated_movement'").select(*KEY, "description")


@query("temporal_risk", """
SELECT feed_id, frame_id, window_size, CAST(is_sudden AS INTEGER) + CAST(is_buildup AS INTEGER) + loiter_alerts + CAST(is_approach AS INTEGER) + CAST(is_coordinated AS INTEGER) AS alerts,
  round(least(1.0::DOUBLE, 0.3::DOUBLE * CAST(is_approach AND approach_critical AS INTEGER)
    + 0.2::DOUBLE * (CAST(is_sudden AS INTEGER) + CAST(is_buildup AS INTEGER) + CAST(is_approach AND NOT approach_critical AS INTEGER) + CAST(is_coordinated AS INTEGER))
    + 0.1::DOUBLE * loiter_alerts
    + CASE WHEN detection_trend > 0 THEN least(0.1::DOUBLE, detection_trend * 0.05::DOUBLE) ELSE 0 END
    + CASE WHEN motion_trend > 0 THEN least(0.1::DOUBLE, motion_trend * 0.02::DOUBLE) ELSE 0 END
    + 0.1::DOUBLE * approaching_count + 0.05::DOUBLE * loitering_count), 4) AS temporal_risk, tracked_objects, approaching_count, loitering_count FROM c_temporal""")
def temporal_risk(spark, sf):
    return _temporal(spark, sf).select(
        *KEY, "window_size", F.size("alerts").alias("alerts"), exact_round("temporal_risk", 4).alias("temporal_risk"),
        "tracked_objects", "approaching_count", "loitering_count")


@query("temporal_summary", """
SELECT feed_id, count(*) AS total_frames, CAST(sum(CAST(is_sudden AS INTEGER) + CAST(is_buildup AS INTEGER) + loiter_alerts + CAST(is_approach AS INTEGER) + CAST(is_coordinated AS INTEGER)) AS BIGINT) AS total_temporal_alerts,
  count(*) FILTER (is_sudden) AS sudden_appearance, count(*) FILTER (is_buildup) AS crowd_buildup, CAST(sum(loiter_alerts) AS BIGINT) AS loitering,
  count(*) FILTER (is_approach) AS approach_trajectory, count(*) FILTER (is_coordinated) AS coordinated_movement, max_by(tracked_objects, frame_id) AS active_tracks
FROM c_temporal GROUP BY 1""")
def temporal_summary(spark, sf):
    return K.temporal_summary(_temporal(spark, sf))


@query("window_risk", """
SELECT feed_id, frame_id, round(least(1.0::DOUBLE, 0.2::DOUBLE * (CAST(is_sudden AS INTEGER) + CAST(is_buildup AS INTEGER))
  + CASE WHEN detection_trend > 0 THEN least(0.1::DOUBLE, detection_trend * 0.05::DOUBLE) ELSE 0 END
  + CASE WHEN motion_trend > 0 THEN least(0.1::DOUBLE, motion_trend * 0.02::DOUBLE) ELSE 0 END), 4) AS temporal_risk FROM c_stats""")
def window_risk(spark, sf):
    """Temporal risk from the window detectors alone."""
    s = stats(spark, sf)
    n = {"CRITICAL": F.lit(0), "MEDIUM": F.lit(0), "HIGH": F.col("is_sudden").cast("int") + F.col("is_buildup").cast("int")}
    r = T.temporal_risk(n, F.col("detection_trend"), F.col("motion_trend"), F.lit(0), F.lit(0))
    return s.select(*KEY, exact_round(r, 4).alias("temporal_risk"))
