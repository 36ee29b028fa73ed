"""SQL building blocks for the comparison engine: the derived tables and frame facts.

They state the rules directly (rectangle tests, plain windows) instead of the way
the Spark operators compute them.
"""

from scenespark.plans.registry import block

block("c_ev", """
SELECT feed_id, u, k,
       CASE WHEN frame_id % 20 >= 8 OR (feed_id % 3 <> 0 AND event_id % 5 = 0) THEN frame_id
            WHEN frame_id > 8 THEN frame_id - 8 ELSE frame_id + 8 END AS frame_id,
       event_id, value
FROM (
  SELECT user_id // 15 AS feed_id, user_id % 15 AS u,
         CAST(regexp_extract(props, ':\\s*(\\d+)', 1) AS BIGINT) AS k,
         CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000 / 10800) AS BIGINT) + 1 AS frame_id,
         event_id, value
  FROM events)
""")

block("c_raw", """
SELECT feed_id, frame_id, TIMESTAMP '2024-01-01' + to_hours(CAST((frame_id - 1) * 3 AS INTEGER)) AS ts,
       event_id AS det_id, class_id, confidence,
       cx * 640.0::DOUBLE - 18.0::DOUBLE AS x1, cy * 640.0::DOUBLE - 80.0::DOUBLE AS y1,
       cx * 640.0::DOUBLE + 18.0::DOUBLE AS x2, cy * 640.0::DOUBLE + 80.0::DOUBLE AS y2
FROM (
  SELECT *,
    (u + 0.5::DOUBLE) / 15.0::DOUBLE + (k - 50) * 0.0002::DOUBLE AS cx,
    CASE u % 3
      WHEN 0 THEN 0.98::DOUBLE - 0.95::DOUBLE * (frame_id % 60) / 60
      WHEN 1 THEN 0.15::DOUBLE + (u / 15.0::DOUBLE) * 0.6::DOUBLE
      ELSE 0.05::DOUBLE + 0.9::DOUBLE * ((event_id * 37) % 101) / 101 END AS cy,
    CAST(CASE WHEN u < 5 THEN 0 WHEN u < 9 THEN 1 WHEN u = 9 THEN 2
         WHEN u IN (10, 11) THEN CASE WHEN event_id % 20 = 0 THEN 3 ELSE 1 END
         WHEN u = 12 THEN 4 WHEN u = 13 THEN 5
         ELSE CASE WHEN event_id % 20 = 1 THEN 6 ELSE 5 END END AS INTEGER) AS class_id,
    0.30::DOUBLE + (event_id % 65) / 100.0::DOUBLE AS confidence
  FROM c_ev)
""")

CLASS_NAME = """CASE class_id WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle' WHEN 2 THEN 'crowd'
  WHEN 3 THEN 'military_vehicle' WHEN 4 THEN 'aircraft' WHEN 5 THEN 'ship' WHEN 6 THEN 'suspicious_object'
  ELSE 'class_' || class_id END"""
THREAT = """CASE WHEN class_id IN (3, 6) THEN 'critical' WHEN class_id IN (2, 4) THEN 'high'
  WHEN class_id IN (0, 5) THEN 'medium' ELSE 'low' END"""

block("c_det", f"""
SELECT feed_id, frame_id, ts, det_id, class_id, round(confidence, 4) AS confidence,
       round(x1, 2) AS x1, round(y1, 2) AS y1, round(x2, 2) AS x2, round(y2, 2) AS y2,
       round(((x1 + x2) / 2) / 640, 4) AS center_x, round(((y1 + y2) / 2) / 640, 4) AS center_y,
       round((x2 - x1) / 640, 4) AS width_norm, round((y2 - y1) / 640, 4) AS height_norm,
       round(((x2 - x1) / 640) * ((y2 - y1) / 640), 6) AS area_norm,
       {CLASS_NAME} AS class_name, {THREAT} AS threat_level
FROM c_raw
""")

block("c_frm", """
SELECT g.feed_id, g.frame_id,
       TIMESTAMP '2024-01-01' + to_hours(CAST((g.frame_id - 1) * 3 AS INTEGER)) AS ts,
       m.motion_score, CAST(80 + g.frame_id % 70 AS DOUBLE) AS inference_ms,
       row_number() OVER (PARTITION BY g.feed_id ORDER BY g.frame_id) AS pos
FROM (SELECT feed_id, CAST(unnest(range(1, last + 1)) AS BIGINT) AS frame_id
      FROM (SELECT feed_id, greatest(240, max(frame_id)) AS last FROM c_ev GROUP BY feed_id)) g
LEFT JOIN (
  SELECT feed_id, frame_id,
         CAST((100 * sum(CAST(round(value * 100) AS BIGINT)) + 3 * count(*)) // (6 * count(*)) AS DOUBLE) / 10000 AS motion_score
  FROM c_ev GROUP BY 1, 2) m USING (feed_id, frame_id)
""")

block("c_zone", """
SELECT *,
  CASE WHEN NOT (center_x >= 0 AND center_x < 1) THEN NULL
       WHEN center_y >= 0 AND center_y < 0.25 THEN 'border_zone'
       WHEN center_y >= 0.25 AND center_y < 0.45 THEN 'buffer_zone'
       WHEN center_y >= 0.45 AND center_y < 1 THEN 'observation_zone' END AS zone_name
FROM c_det
""")

block("c_viol", """
SELECT *,
  class_name || ' (' || printf('%.0f', confidence * 100) || '%) detected in ' || zone_label
    || CASE WHEN is_high_threat THEN ' [HIGH THREAT]' ELSE '' END AS reason
FROM (
  SELECT *,
    CASE zone_name WHEN 'border_zone' THEN 'RESTRICTED' WHEN 'buffer_zone' THEN 'BUFFER' ELSE 'OBSERVATION' END AS zone_level,
    CASE zone_name WHEN 'border_zone' THEN 'Border Zone (Restricted)' WHEN 'buffer_zone' THEN 'Buffer Zone (Proximity)'
      ELSE 'Observation Zone (General)' END AS zone_label,
    CASE zone_name WHEN 'border_zone' THEN 'CRITICAL' WHEN 'buffer_zone' THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
    class_name IN ('person', 'military_vehicle', 'suspicious_object', 'crowd') AS is_high_threat
  FROM c_zone WHERE zone_name IS NOT NULL)
""")

block("c_zset", """
SELECT *, 'z' || zone_order AS name, (['RESTRICTED', 'BUFFER', 'OBSERVATION', 'SAFE'])[(s_suppkey + i) % 4 + 1] AS level,
  w * (1 + i % 3) / 2.0::DOUBLE AS h
FROM (
  SELECT s_suppkey, i, s_suppkey % (SELECT count(DISTINCT feed_id) FROM c_ev) AS feed_id, s_suppkey * 20 + i AS zone_order,
    0.01::DOUBLE * power(2.0::DOUBLE, (s_suppkey * 7 + i * 3) % 6) AS w,
    CAST((s_suppkey * 37 + i * 101) % 1000 AS DOUBLE) / 1000 AS x, CAST((s_suppkey * 53 + i * 29) % 1000 AS DOUBLE) / 1000 AS y
  FROM supplier, range(20) r(i))
""")

block("c_zedge", """
SELECT feed_id, zone_order, name, level, unnest(CASE WHEN i % 2 = 0
  THEN [{'xi': x, 'yi': y, 'xj': x, 'yj': y + h}, {'xi': x + w, 'yi': y, 'xj': x, 'yj': y},
        {'xi': x + w, 'yi': y + h, 'xj': x + w, 'yj': y}, {'xi': x, 'yi': y + h, 'xj': x + w, 'yj': y + h}]
  ELSE [{'xi': x, 'yi': y, 'xj': x + w / 2.0::DOUBLE, 'yj': y + h}, {'xi': x + w, 'yi': y, 'xj': x, 'yj': y},
        {'xi': x + w / 2.0::DOUBLE, 'yi': y + h, 'xj': x + w, 'yj': y}] END) AS e
FROM c_zset
""")

block("c_zfirst", """
SELECT d.*, h.z.zone_order AS zone_order, h.z.name AS zone_name, h.z.level AS zone_level
FROM c_det d JOIN (
  SELECT det_id, min_by({'zone_order': zone_order, 'name': name, 'level': level}, zone_order) AS z
  FROM (
    SELECT d.det_id, z.zone_order, z.name, z.level
    FROM c_det d JOIN c_zedge z ON d.feed_id = z.feed_id AND ((z.e.yi > d.center_y) <> (z.e.yj > d.center_y))
    WHERE d.center_x < (z.e.xj - z.e.xi) * (d.center_y - z.e.yi) / (z.e.yj - z.e.yi + 1e-12) + z.e.xi
    GROUP BY ALL HAVING count(*) % 2 = 1)
  GROUP BY det_id) h USING (det_id)
""")

block("c_zcount", """
SELECT feed_id, frame_id, zone_order, zone_name, zone_level, count(*) AS n,
  count(*) FILTER (class_name IN ('person', 'military_vehicle', 'suspicious_object', 'crowd')) AS threats
FROM c_zfirst GROUP BY ALL
""")

block("c_agg", """
SELECT feed_id, frame_id, count(*) AS n, count(*) FILTER (class_name = 'person') AS persons,
  list(DISTINCT class_name ORDER BY class_name) AS classes,
  avg(confidence) AS avg_confidence, max(confidence) AS max_confidence,
  count(*) FILTER (class_name IN ('crowd', 'aircraft', 'military_vehicle', 'suspicious_object')) AS critical_count,
  avg(center_x) AS avg_center_x, avg(center_y) AS avg_center_y, avg(width_norm) AS avg_width_norm,
  bool_or(class_name IN ('military_vehicle', 'suspicious_object')) AS suspicious,
  bool_or(threat_level = 'critical') AS has_critical, bool_or(threat_level = 'high') AS has_high
FROM c_det GROUP BY 1, 2
""")

block("c_facts", """
SELECT f.*, coalesce(a.n, 0) AS detection_count, coalesce(a.persons, 0) AS persons,
  coalesce(a.classes, []) AS classes,
  coalesce(a.avg_confidence, 0) AS avg_confidence, coalesce(a.max_confidence, 0) AS max_confidence,
  coalesce(a.critical_count, 0) AS critical_count, coalesce(a.avg_center_x, 0.5) AS avg_center_x,
  coalesce(a.avg_center_y, 0.5) AS avg_center_y, coalesce(a.avg_width_norm, 0) AS avg_width_norm,
  coalesce(a.suspicious, false) AS suspicious, coalesce(a.has_critical, false) AS has_critical,
  coalesce(a.has_high, false) AS has_high
FROM c_frm f LEFT JOIN c_agg a USING (feed_id, frame_id)
""")

block("c_zagg", """
SELECT feed_id, frame_id, count(*) AS violation_count,
  count(*) FILTER (zone_name = 'border_zone') AS zb,
  count(*) FILTER (zone_name = 'buffer_zone') AS zu,
  count(*) FILTER (zone_name = 'observation_zone') AS zo,
  count(*) FILTER (zone_level = 'RESTRICTED' AND is_high_threat) AS hot,
  max(CASE zone_level WHEN 'RESTRICTED' THEN 3 WHEN 'BUFFER' THEN 2 ELSE 1 END) AS rank,
  list(reason ORDER BY det_id) AS zone_reasons
FROM c_viol GROUP BY 1, 2
""")

block("c_zrisk", """
SELECT *, CASE WHEN hour(ts) >= 21 OR hour(ts) < 5 THEN least(1.0::DOUBLE, base_risk * 1.3::DOUBLE) ELSE base_risk END AS zone_risk
FROM (
  SELECT f.*, coalesce(z.violation_count, 0) AS violation_count,
    coalesce(zb, 0) AS zb, coalesce(zu, 0) AS zu, coalesce(zo, 0) AS zo, coalesce(hot, 0) AS hot,
    CASE coalesce(rank, 0) WHEN 3 THEN 'RESTRICTED' WHEN 2 THEN 'BUFFER' WHEN 1 THEN 'OBSERVATION' ELSE 'SAFE' END AS max_severity,
    coalesce(zone_reasons, []) AS zone_reasons,
    least(1.0::DOUBLE, 0.3::DOUBLE * coalesce(zb, 0) + 0.15::DOUBLE * coalesce(zu, 0) + 0.05::DOUBLE * coalesce(zo, 0)
      + 0.15::DOUBLE * coalesce(hot, 0)
      + 0.1::DOUBLE * (greatest(coalesce(zb, 0) - 1, 0) + greatest(coalesce(zu, 0) - 1, 0) + greatest(coalesce(zo, 0) - 1, 0))) AS base_risk
  FROM c_facts f LEFT JOIN c_zagg z USING (feed_id, frame_id))
""")


def stats_block(name: str, window: int, source: str = "c_zrisk") -> None:
    w = f"(PARTITION BY feed_id ORDER BY frame_id ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"

    def slope(y):
        return (
            f"CAST(count(*) OVER {w} * sum(pos * {y}) OVER {w} - sum(pos) OVER {w} * sum({y}) OVER {w} AS DOUBLE)"
            f" / nullif(CAST(count(*) OVER {w} * sum(pos * pos) OVER {w} - sum(pos) OVER {w} * sum(pos) OVER {w} AS DOUBLE), 0)"
        )

    block(name, f"""
SELECT *, detection_count - prev_avg AS increase,
  window_size >= 3 AND prev_avg < 2 AND detection_count - prev_avg >= 5 AS is_sudden,
  coalesce(window_size >= 8 AND person_slope >= 0.3 AND persons >= 3, false) AS is_buildup
FROM (
  SELECT *, least(pos, {window}) AS window_size,
    CASE WHEN least(pos, {window}) > 4 THEN avg4 ELSE 0 END AS prev_avg,
    CASE WHEN least(pos, {window}) >= 5 THEN coalesce(count_slope, 0) ELSE 0 END AS detection_trend,
    CASE WHEN least(pos, {window}) >= 5 AND motions >= 5 THEN coalesce(motion_slope, 0) ELSE 0 END AS motion_trend
  FROM (
    SELECT *,
      avg(detection_count) OVER (PARTITION BY feed_id ORDER BY frame_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS avg4,
      {slope('persons')} AS person_slope, {slope('detection_count')} AS count_slope,
      CAST(count(m4) OVER {w} * sum(m4 * mx) OVER {w} - sum(mx) OVER {w} * sum(m4) OVER {w} AS DOUBLE)
        / nullif(CAST(count(m4) OVER {w} * sum(mx * mx) OVER {w} - sum(mx) OVER {w} * sum(mx) OVER {w} AS DOUBLE), 0) / 10000 AS motion_slope,
      count(motion_score) OVER {w} AS motions,
      first_value(persons) OVER {w} AS window_start_persons,
      lag(frame_id) OVER (PARTITION BY feed_id ORDER BY frame_id) AS prev_frame
    FROM (SELECT *, CAST(round(motion_score * 10000) AS BIGINT) AS m4,
      CASE WHEN motion_score IS NOT NULL THEN count(motion_score) OVER (PARTITION BY feed_id ORDER BY frame_id) END AS mx FROM {source})))
""")


stats_block("c_stats", 30)
stats_block("c_stats10", 10)

block("c_scored", """
SELECT *, 1 / (1 + exp(anomaly_score * 10)) AS anomaly_prob,
  CASE WHEN anomaly_score < -0.18 THEN 'critical' WHEN anomaly_score < -0.08 THEN 'high' ELSE 'normal' END AS alert_level
FROM (
  SELECT *, s3 - CASE WHEN len(threats) >= 2 THEN 0.05::DOUBLE ELSE 0 END AS anomaly_score
  FROM (
    SELECT *, CASE WHEN list_contains(classes, 'crowd') AND motion_score > 12 THEN least(s2, (-0.08::DOUBLE) - 0.05::DOUBLE) ELSE s2 END AS s3
    FROM (
      SELECT *, CASE WHEN list_contains(classes, 'suspicious_object') THEN least(s1, (-0.18::DOUBLE) - 0.02::DOUBLE) ELSE s1 END AS s2
      FROM (
        SELECT *, CASE WHEN list_contains(classes, 'military_vehicle') THEN least(base_score, (-0.18::DOUBLE) - 0.05::DOUBLE) ELSE base_score END AS s1,
          list_filter(['aircraft', 'crowd', 'military_vehicle', 'suspicious_object'], lambda x: list_contains(classes, x)) AS threats
        FROM (
          SELECT *, 0.0::DOUBLE - CASE WHEN suspicious THEN 0.20::DOUBLE ELSE 0 END
            - CASE WHEN list_contains(classes, 'crowd') OR list_contains(classes, 'aircraft') THEN 0.10::DOUBLE ELSE 0 END
            - CASE WHEN detection_count > 15 THEN 0.08::DOUBLE ELSE 0 END
            - CASE WHEN coalesce(motion_score, 0) > 15 THEN 0.06::DOUBLE ELSE 0 END AS base_score
          FROM c_stats)))))
""")

block("c_fused", """
SELECT *, CASE WHEN max_severity = 'RESTRICTED' THEN 'critical' ELSE alert_level END AS final_level,
  list_concat(list_concat(anomaly_reasons, zone_reasons[1:3]), temporal_reasons[1:3]) AS reasons
FROM (
  SELECT *, CASE WHEN alert_level = 'normal' THEN [] WHEN len(found) > 0 THEN found
      ELSE ['statistical anomaly (IF score=' || printf('%.3f', anomaly_score) || ')'] END AS anomaly_reasons
  FROM (
    SELECT *, list_filter([
        CASE WHEN list_contains(classes, 'military_vehicle') THEN 'military_vehicle detected' END,
        CASE WHEN list_contains(classes, 'suspicious_object') THEN 'suspicious_object detected' END,
        CASE WHEN list_contains(classes, 'crowd') AND motion_score > 12 THEN 'crowd with high motion' END,
        CASE WHEN len(threats) >= 2 THEN 'multiple threat classes: ' || array_to_string(threats, ', ') END,
        CASE WHEN detection_count > 10 THEN 'unusually high detection count (' || detection_count || ')' END,
        CASE WHEN motion_score > 10 THEN 'high motion activity (score=' || printf('%.1f', motion_score) || ')' END,
        CASE WHEN list_contains(classes, 'crowd') THEN 'crowd gathering detected' END,
        CASE WHEN list_contains(classes, 'aircraft') THEN 'aircraft in surveillance zone' END
      ], lambda x: x IS NOT NULL) AS found,
      list_filter([
        CASE WHEN is_sudden THEN 'Sudden appearance: ' || CAST(trunc(increase) AS BIGINT) || ' new objects detected (was '
          || printf('%.0f', prev_avg) || ', now ' || detection_count || ')' END,
        CASE WHEN is_buildup THEN 'Crowd buildup detected: person count rising at ' || printf('%.2f', person_slope)
          || '/frame (now ' || persons || ' persons)' END
      ], lambda x: x IS NOT NULL) AS temporal_reasons
    FROM c_scored))
""")

block("c_alert", """
SELECT 'alert_' || feed_id || '_' || frame_id AS alert_id, feed_id, frame_id, ts,
  CASE final_level WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' ELSE 'LOW' END AS priority,
  round(anomaly_score, 4) AS anomaly_score, round(anomaly_prob, 4) AS anomaly_prob, final_level AS alert_level,
  reasons, detection_count, round(motion_score, 4) AS motion_score, false AS notified
FROM c_fused WHERE final_level <> 'normal' AND pos > 30
""")

block("c_img", """
SELECT 'img_' || o_orderkey AS stem, o_orderkey,
  CASE o_orderkey % 3 WHEN 0 THEN 'xview' WHEN 1 THEN 'visdrone' ELSE 'dota' END AS source,
  CAST(320 + (o_orderkey * 131) % 2400 AS INTEGER) AS img_w, CAST(240 + (o_orderkey * 77) % 1800 AS INTEGER) AS img_h
FROM orders
""")

block("c_ann", """
SELECT 'img_' || l_orderkey AS stem, l_orderkey, l_linenumber AS line_no,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS ann_id,
  CAST(CASE WHEN l_partkey % 200 = 0 THEN 3 WHEN l_partkey % 100 < 2 THEN 6 WHEN l_partkey % 50 = 3 THEN 4
    WHEN l_partkey % 50 = 4 THEN 5 WHEN l_partkey % 25 = 5 THEN 2 WHEN l_partkey % 12 = 6 THEN 0 ELSE 1 END AS INTEGER) AS class_id,
  0.002::DOUBLE + l_quantity / 250.0::DOUBLE AS bw, 0.002::DOUBLE + (l_partkey % 40) / 200.0::DOUBLE AS bh,
  ((l_partkey * 7) % 1000) / 1000.0::DOUBLE AS fx,
  ((l_suppkey * 13 + l_linenumber * 101) % 1000) / 1000.0::DOUBLE AS fy
FROM lineitem
""")

# some images and some labels under names of their own, so that neither has the other
block("c_imgr", "SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'bare_' ELSE 'img_' END || o_orderkey AS stem, source FROM c_img")
block("c_annr", "SELECT CASE WHEN l_orderkey % 40 = 1 THEN 'lost_' ELSE 'img_' END || l_orderkey AS stem FROM c_ann")

block("c_px", """
SELECT stem, source, img_w, img_h, ann_id, line_no, class_id, raw_code, xmin, ymin, xmin + box_w AS xmax, ymin + box_h AS ymax
FROM (
  SELECT *, (img_w - box_w) * fx AS xmin, (img_h - box_h) * fy AS ymin,
    CASE WHEN line_no = 7 THEN CASE source WHEN 'xview' THEN '0' WHEN 'visdrone' THEN '11' ELSE 'bridge' END
      WHEN source = 'xview' THEN ['77', '18', '79', '17', '11', '32', '83'][class_id + 1]
      WHEN source = 'visdrone' THEN coalesce(['1', '4'][class_id + 1], '11')
      ELSE CASE class_id WHEN 1 THEN 'small-vehicle' WHEN 4 THEN 'plane' WHEN 5 THEN 'ship' WHEN 6 THEN 'storage-tank' ELSE 'bridge' END
    END AS raw_code
  FROM (SELECT a.*, i.source, i.img_w, i.img_h, i.img_w * a.bw AS box_w, i.img_h * a.bh AS box_h
        FROM c_ann a JOIN c_img i USING (stem)))
""")

block("c_map2", """
SELECT * FROM (VALUES
  ('xview', '77', 0), ('xview', '18', 1), ('xview', '79', 2), ('xview', '17', 3), ('xview', '11', 4), ('xview', '32', 5), ('xview', '83', 6),
  ('visdrone', '1', 0), ('visdrone', '4', 1),
  ('dota', 'small-vehicle', 1), ('dota', 'plane', 4), ('dota', 'ship', 5), ('dota', 'storage-tank', 6)) t(source, raw_code, cls)
""")

block("c_mapped", """
SELECT p.stem, p.source, p.img_w, p.img_h, p.ann_id, p.raw_code, CAST(m.cls AS INTEGER) AS class_id, p.xmin, p.ymin, p.xmax, p.ymax
FROM c_px p JOIN c_map2 m USING (source, raw_code)
""")

# One step per detection and feed. ``l = frame_id`` marks tracks already taken or
# created in the current frame; tracks out of reach are dropped on the way.
block("c_walk", """
SELECT feed_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, l BIGINT)[]) AS tracks,
  CAST(0 AS BIGINT) AS next_id, CAST(0 AS BIGINT) AS det_id, CAST(0 AS BIGINT) AS frame_id, CAST(0 AS BIGINT) AS track_id
FROM (SELECT DISTINCT feed_id FROM c_steps)
UNION ALL
SELECT feed_id, i,
  CASE WHEN hit IS NULL THEN list_append(kept, {'id': next_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'l': frame_id})
    ELSE list_transform(kept, lambda t: CASE WHEN t.id = hit THEN {'id': t.id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'l': frame_id} ELSE t END) END,
  CASE WHEN hit IS NULL THEN next_id + 1 ELSE next_id END, det_id, frame_id, coalesce(hit, next_id)
FROM (
  SELECT *, -(list_reverse_sort(list_filter(list_transform(list_filter(kept, lambda t: t.l < frame_id), lambda t: {
      'o': (greatest(0, least(x2, t.x2) - greatest(x1, t.x1)) * greatest(0, least(y2, t.y2) - greatest(y1, t.y1)))
        / ((x2 - x1) * (y2 - y1) + (t.x2 - t.x1) * (t.y2 - t.y1)
           - greatest(0, least(x2, t.x2) - greatest(x1, t.x1)) * greatest(0, least(y2, t.y2) - greatest(y1, t.y1))),
      'm': -t.id}), lambda c: c.o >= 0.3))[1]).m AS hit
  FROM (
    SELECT s.*, w.next_id, list_filter(w.tracks, lambda t: t.l = s.frame_id OR coalesce(s.prev_frame - t.l, 99) <= 5) AS kept
    FROM c_walk w JOIN c_steps s ON s.feed_id = w.feed_id AND s.i = w.i + 1))
""")
block("c_steps", """
SELECT d.feed_id, d.frame_id, d.det_id, d.x1, d.y1, d.x2, d.y2, p.prev_frame,
  row_number() OVER (PARTITION BY d.feed_id ORDER BY d.frame_id, d.det_id) AS i
FROM c_det d JOIN (SELECT feed_id, frame_id, lag(frame_id) OVER (PARTITION BY feed_id ORDER BY frame_id) AS prev_frame FROM c_frm) p USING (feed_id, frame_id)
""")
block("c_obs", """
SELECT *, y - y0 < -0.05 AS is_approaching, frame_count >= 10 AND xr < 0.08 AND yr < 0.08 AS is_loitering,
  sqrt(vx * vx + vy * vy) AS speed
FROM (
  SELECT w.feed_id, w.frame_id, w.det_id, w.track_id, d.center_x AS x, d.center_y AS y,
    first_value(d.class_name) OVER t AS class_name, row_number() OVER t AS frame_count, lead(w.frame_id) OVER t AS next_frame,
    first_value(d.center_y) OVER k AS y0, max(d.center_x) OVER k - min(d.center_x) OVER k AS xr, max(d.center_y) OVER k - min(d.center_y) OVER k AS yr,
    d.center_x - lag(d.center_x, 2) OVER t AS vx, d.center_y - lag(d.center_y, 2) OVER t AS vy
  FROM c_walk w JOIN c_det d USING (feed_id, frame_id, det_id) WHERE w.i > 0
  WINDOW t AS (PARTITION BY w.feed_id, w.track_id ORDER BY w.frame_id),
    k AS (PARTITION BY w.feed_id, w.track_id ORDER BY w.frame_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
""")
block("c_live", """
SELECT f.feed_id, f.frame_id, f.pos, o.* EXCLUDE (feed_id, frame_id), o.frame_id AS seen_frame,
  min(CASE WHEN frame_count >= 3 AND speed > 0.01 THEN track_id END) OVER (PARTITION BY f.feed_id, f.frame_id) AS lead_id
FROM c_obs o JOIN c_frm f ON f.feed_id = o.feed_id AND f.frame_id >= o.frame_id AND f.frame_id <= o.frame_id + 5
  AND f.frame_id < coalesce(o.next_frame, 1000000)
""")
block("c_tracks", """
SELECT l.feed_id, l.frame_id, count(*) AS tracked_objects, count(*) FILTER (l.is_approaching) AS approaching_count,
  count(*) FILTER (l.is_loitering) AS loitering_count, count(*) FILTER (l.is_approaching AND l.frame_count >= 3) AS approach_n,
  coalesce(bool_or(l.class_name IN ('person', 'military_vehicle', 'suspicious_object')) FILTER (l.is_approaching AND l.frame_count >= 3), false) AS approach_critical,
  array_to_string(list(DISTINCT l.class_name ORDER BY l.class_name) FILTER (l.is_approaching AND l.frame_count >= 3), ', ') AS approach_classes,
  count(*) FILTER (l.frame_count >= 3 AND l.speed > 0.01) AS moving,
  1 + count(*) FILTER (l.frame_count >= 3 AND l.speed > 0.01 AND l.track_id <> l.lead_id
    AND (l.vx / l.speed) * (a.vx / a.speed) + (l.vy / l.speed) * (a.vy / a.speed) > 0.5) AS coordinated
FROM c_live l LEFT JOIN c_live a ON a.feed_id = l.feed_id AND a.frame_id = l.frame_id AND a.track_id = l.lead_id GROUP BY 1, 2
""")
block("c_temporal", """
SELECT *, pos >= 3 AND approach_n > 0 AS is_approach, pos >= 3 AND moving >= 3 AND coordinated >= 3 AS is_coordinated,
  CASE WHEN pos >= 3 THEN loitering_count ELSE 0 END AS loiter_alerts
FROM (SELECT s.feed_id, s.frame_id, s.pos, s.window_size, s.is_sudden, s.is_buildup, s.detection_trend, s.motion_trend,
    coalesce(t.tracked_objects, 0) AS tracked_objects, coalesce(t.approaching_count, 0) AS approaching_count,
    coalesce(t.loitering_count, 0) AS loitering_count, coalesce(t.approach_n, 0) AS approach_n, coalesce(t.approach_critical, false) AS approach_critical,
    t.approach_classes, coalesce(t.moving, 0) AS moving, coalesce(t.coordinated, 0) AS coordinated
  FROM c_stats s LEFT JOIN c_tracks t USING (feed_id, frame_id))
""")

block("c_session", """
SELECT f.*, t.tracked_objects, t.approaching_count, t.loitering_count,
  CAST(t.is_sudden AS INTEGER) + CAST(t.is_buildup AS INTEGER) + t.loiter_alerts + CAST(t.is_approach AS INTEGER) + CAST(t.is_coordinated AS INTEGER) AS temporal_alerts,
  least(1.0::DOUBLE, 0.3::DOUBLE * CAST(t.is_approach AND t.approach_critical AS INTEGER)
    + 0.2::DOUBLE * (CAST(t.is_sudden AS INTEGER) + CAST(t.is_buildup AS INTEGER) + CAST(t.is_approach AND NOT t.approach_critical AS INTEGER) + CAST(t.is_coordinated AS INTEGER))
    + 0.1::DOUBLE * t.loiter_alerts
    + CASE WHEN t.detection_trend > 0 THEN least(0.1::DOUBLE, t.detection_trend * 0.05::DOUBLE) ELSE 0 END
    + CASE WHEN t.motion_trend > 0 THEN least(0.1::DOUBLE, t.motion_trend * 0.02::DOUBLE) ELSE 0 END
    + 0.1::DOUBLE * t.approaching_count + 0.05::DOUBLE * t.loitering_count) AS temporal_risk
FROM c_fused f JOIN c_temporal t USING (feed_id, frame_id)
""")
