"""Registered queries over label formats and the training corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions.numbers import exact_round
from scenespark.functions import geometry as G
from scenespark.operators import corpus as K
from scenespark.operators.checkpoints import cut, ensure_checkpoint_dir
from scenespark.plans.registry import block, query
from scenespark.sinks import tables
from scenespark.sources import derived as D, labels as L

# --- label lines of every format, some of them broken -----------------------------

block("c_box", """
SELECT p.*, xmax - xmin AS bw, ymax - ymin AS bh, l.salt FROM c_px p JOIN (
  SELECT 'img_' || l_orderkey AS stem, (l_partkey * 7 + l_suppkey) % 37 AS salt,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS ann_id FROM lineitem) l USING (stem, ann_id)
""")


def boxes(spark, sf):
    """Pixel annotations with a number that decides which lines are broken."""
    return D.pixel_annotations(spark, sf, {"salt": "(l_partkey * 7 + l_suppkey) % 37"}).withColumns(
        {"bw": F.col("xmax") - F.col("xmin"), "bh": F.col("ymax") - F.col("ymin")})


def _f6(x):
    return F.format_string("%.6f", F.expr(x))


def yolo_lines(spark, sf):
    b = boxes(spark, sf)
    good = F.concat_ws(" ", "class_id", _f6("xmin / img_w + bw / img_w / 2"), _f6("ymin / img_h + bh / img_h / 2"),
                       _f6("bw / img_w"), _f6("bh / img_h"))
    line = (
        F.when(F.expr("salt = 1"), F.lit("1 0.5 0.5")).when(F.expr("salt = 2"), F.concat(F.lit("x"), good))
        .when(F.expr("salt = 3"), F.lit("  1 0.5   1.5 0.2 0.2 ")).when(F.expr("salt = 4"), F.lit("9 0.5 0.5 0.1 0.1"))
        .when(F.expr("salt = 5"), F.lit("2 0.5 0.5 0 0.1 extra")).when(F.expr("salt = 6"), F.lit("   ")).otherwise(good)
    )
    return b.select("stem", "source", "ann_id", line.alias("line"))


block("c_yolo", """
SELECT stem, source, ann_id, CASE salt WHEN 1 THEN '1 0.5 0.5' WHEN 2 THEN 'x' || good WHEN 3 THEN '  1 0.5   1.5 0.2 0.2 '
  WHEN 4 THEN '9 0.5 0.5 0.1 0.1' WHEN 5 THEN '2 0.5 0.5 0 0.1 extra' WHEN 6 THEN '   ' ELSE good END AS line
FROM (SELECT *, class_id || ' ' || printf('%.6f', xmin / img_w + bw / img_w / 2) || ' ' || printf('%.6f', ymin / img_h + bh / img_h / 2)
  || ' ' || printf('%.6f', bw / img_w) || ' ' || printf('%.6f', bh / img_h) AS good FROM c_box)
""")
block("c_yolop", """
SELECT *, CASE WHEN n < 5 THEN 'short' WHEN a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL OR e IS NULL THEN 'malformed'
  WHEN a BETWEEN 0 AND 6 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 AND d > 0 AND d <= 1 AND e > 0 AND e <= 1 THEN 'ok' ELSE 'invalid' END AS status
FROM (SELECT stem, source, ann_id, len(t) AS n, TRY_CAST(t[1] AS INTEGER) AS a, TRY_CAST(t[2] AS DOUBLE) AS b, TRY_CAST(t[3] AS DOUBLE) AS c,
  TRY_CAST(t[4] AS DOUBLE) AS d, TRY_CAST(t[5] AS DOUBLE) AS e
  FROM (SELECT *, string_split_regex(trim(line), '\\s+') AS t FROM c_yolo WHERE trim(line) <> ''))
""")


def _r6(*cols):
    return [exact_round(c, 6).alias(c) for c in cols]


@query("yolo_lines", """
SELECT stem, ann_id, status, a AS class_id, round(b, 6) AS cx, round(c, 6) AS cy, round(d, 6) AS w, round(e, 6) AS h FROM c_yolop""")
def yolo_lines_parsed(spark, sf):
    return L.parse_yolo(yolo_lines(spark, sf).drop("source")).select("stem", "ann_id", "status", "class_id", *_r6("cx", "cy", "w", "h"))


def visdrone_lines(spark, sf):
    b = boxes(spark, sf).filter("source = 'visdrone'")
    good = F.concat_ws(",", *[F.floor(c) for c in ("xmin", "ymin", "bw", "bh")], F.lit("1"),
                       F.when(F.col("salt") == 9, F.lit("3")).otherwise(F.col("raw_code")), F.lit("0"), F.lit("0"))
    line = F.when(F.expr("salt = 1"), F.lit("5,5,10")).when(F.expr("salt = 2"), F.lit("a,1,20,20,1,4,0,0")).when(
        F.expr("salt = 3"), F.lit("10,10,0,50,1,4,0,0")).otherwise(good)
    return b.select("stem", "ann_id", "img_w", "img_h", line.alias("line"))


block("c_vis", """
SELECT stem, ann_id, img_w, img_h, string_split(CASE salt WHEN 1 THEN '5,5,10' WHEN 2 THEN 'a,1,20,20,1,4,0,0' WHEN 3 THEN '10,10,0,50,1,4,0,0'
  ELSE CAST(floor(xmin) AS BIGINT) || ',' || CAST(floor(ymin) AS BIGINT) || ',' || CAST(floor(bw) AS BIGINT) || ',' || CAST(floor(bh) AS BIGINT) || ',1,'
    || CASE WHEN salt = 9 THEN '3' ELSE raw_code END || ',0,0' END, ',') AS t FROM c_box WHERE source = 'visdrone'
""")
block("c_visn", """
SELECT stem, ann_id, img_w, img_h, len(t) AS n, TRY_CAST(t[1] AS INTEGER) AS x, TRY_CAST(t[2] AS INTEGER) AS y, TRY_CAST(t[3] AS INTEGER) AS bw,
  TRY_CAST(t[4] AS INTEGER) AS bh, TRY_CAST(t[6] AS INTEGER) AS code FROM c_vis
""")


_READ = "status NOT IN ('short', 'malformed')"


def _if_read(c, digits=None):
    """A value of the lines that could be read; nothing is said of the others."""
    return F.when(F.expr(_READ), F.col(c) if digits is None else exact_round(c, digits))


@query("visdrone_lines", f"""
SELECT stem, ann_id, status, CASE WHEN {_READ} THEN cls END AS class_id, CASE WHEN {_READ} THEN round(cx, 6) END AS cx,
  CASE WHEN {_READ} THEN round(cy, 6) END AS cy, CASE WHEN {_READ} THEN round(w, 6) END AS w, CASE WHEN {_READ} THEN round(h, 6) END AS h FROM (
  SELECT *, CASE WHEN n < 6 THEN 'short' WHEN x IS NULL OR y IS NULL OR bw IS NULL OR bh IS NULL OR code IS NULL THEN 'malformed'
    WHEN cls IS NULL THEN 'unmapped' WHEN w * img_w >= 3 AND h * img_h >= 3 THEN 'ok' ELSE 'invalid' END AS status
  FROM (SELECT *, CASE WHEN code IN (1, 2) THEN 0 WHEN code BETWEEN 4 AND 10 THEN 1 END AS cls,
    greatest(0.001, least(0.999, (x + bw / 2) / img_w)) AS cx, greatest(0.001, least(0.999, (y + bh / 2) / img_h)) AS cy,
    greatest(0.001, least(0.999, bw / img_w)) AS w, greatest(0.001, least(0.999, bh / img_h)) AS h FROM c_visn))""")
def visdrone_lines_parsed(spark, sf):
    p = L.parse_visdrone(visdrone_lines(spark, sf))
    return p.select("stem", "ann_id", "status", _if_read("class_id").alias("class_id"),
                    *[_if_read(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("visdrone_lines_first_version", f"""
SELECT status, CASE WHEN {_READ} THEN cls END AS class_id, count(*) AS lines,
  round(coalesce(sum(CASE WHEN {_READ} THEN round(w, 6) END), 0), 3) AS width FROM (
  SELECT *, CASE WHEN n < 6 THEN 'short' WHEN x IS NULL OR y IS NULL OR bw IS NULL OR bh IS NULL OR code IS NULL THEN 'malformed'
    WHEN cls IS NULL THEN 'unmapped' WHEN bw > 0 AND bh > 0 AND cx > 0 AND cx <= 1 AND cy > 0 AND cy <= 1 AND w > 0 AND h > 0 THEN 'ok' ELSE 'invalid' END AS status
  FROM (SELECT *, CASE WHEN code IN (1, 2) THEN 0 WHEN code BETWEEN 3 AND 10 THEN 1 END AS cls,
    greatest(0.0, least(1.0, (x + bw / 2) / img_w)) AS cx, greatest(0.0, least(1.0, (y + bh / 2) / img_h)) AS cy,
    greatest(0.0, least(1.0, bw / img_w)) AS w, greatest(0.0, least(1.0, bh / img_h)) AS h FROM c_visn)) GROUP BY 1, 2""")
def visdrone_lines_v1(spark, sf):
    p = L.parse_visdrone(visdrone_lines(spark, sf), "v1")
    return p.groupBy("status", _if_read("class_id").alias("class_id")).agg(
        F.count(F.lit(1)).alias("lines"), exact_round(F.coalesce(F.sum(_if_read("w", 6)), F.lit(0.0)), 3).alias("width"))


_DOTA_LINE = """CASE WHEN salt = 1 THEN 'imagesource:map' WHEN salt = 2 THEN 'gsd:0.2' WHEN salt = 3 THEN '1 2 3 4' WHEN salt = 4 THEN 'x ' || obb
  WHEN salt IN (5, 6) THEN 'Plane 0.5 0.5 0.25 0.125' WHEN salt = 7 THEN '6 0.5 0.25 0.5 0.5' WHEN salt = 8 THEN '42 0.5 0.25 0.5 0.5'
  WHEN salt = 9 THEN 'ship 0.5 0.25 zero 0.5' WHEN salt = 10 THEN replace(obb, '.', 'q') WHEN salt = 11 THEN obb2 ELSE obb END"""
block("c_dota", f"""
SELECT stem, ann_id, img_w, img_h, {_DOTA_LINE} AS line FROM (
  SELECT *, a || ' ' || b || ' ' || c || ' ' || b || ' ' || c || ' ' || d || ' ' || a || ' ' || d || ' ' || raw_code || ' 0' AS obb,
    a || ' ' || b || ' ' || c || ' ' || b || ' ' || c || ' ' || d || ' ' || a || ' ' || d || ' Harbor 1' AS obb2
  FROM (SELECT *, printf('%.1f', floor(xmin)) AS a, printf('%.1f', floor(ymin)) AS b, printf('%.1f', floor(xmax)) AS c, printf('%.1f', floor(ymax)) AS d
    FROM c_box WHERE source = 'dota'))
""")


def dota_lines(spark, sf):
    b = L.finished(boxes(spark, sf).filter("source = 'dota'"), {
        n: F.format_string("%.1f", F.floor(c).cast("double")) for n, c in zip("abcd", ("xmin", "ymin", "xmax", "ymax"))})
    ring = F.concat_ws(" ", "a", "b", "c", "b", "c", "d", "a", "d")
    b = b.withColumns({"obb": F.concat_ws(" ", ring, "raw_code", F.lit("0")), "obb2": F.concat(ring, F.lit(" Harbor 1"))})
    return b.select("stem", "ann_id", "img_w", "img_h", F.expr(_DOTA_LINE).alias("line"))


block("c_dotat", """
SELECT *, string_split_regex(trim(line), '\\s+') AS t FROM c_dota WHERE NOT (line LIKE 'imagesource%' OR line LIKE 'gsd%')
""")


@query("dota_corner_lines", """
SELECT stem, ann_id, status, CASE WHEN status IN ('ok', 'unmapped') THEN cls END AS class_id, CASE WHEN status IN ('ok', 'unmapped') THEN xmin END AS xmin,
  CASE WHEN status IN ('ok', 'unmapped') THEN ymin END AS ymin, CASE WHEN status IN ('ok', 'unmapped') THEN xmax END AS xmax,
  CASE WHEN status IN ('ok', 'unmapped') THEN ymax END AS ymax FROM (
  SELECT stem, ann_id, CASE WHEN len(t) < 9 THEN 'short' WHEN bad THEN 'malformed' WHEN cls IS NULL THEN 'unmapped' ELSE 'ok' END AS status, cls,
    least(v[1], v[3], v[5], v[7]) AS xmin, least(v[2], v[4], v[6], v[8]) AS ymin, greatest(v[1], v[3], v[5], v[7]) AS xmax, greatest(v[2], v[4], v[6], v[8]) AS ymax
  FROM (SELECT *, len(list_filter(v, lambda x: x IS NULL)) > 0 AS bad,
    CASE t[9] WHEN 'small-vehicle' THEN 1 WHEN 'large-vehicle' THEN 1 WHEN 'plane' THEN 4 WHEN 'helicopter' THEN 4 WHEN 'ship' THEN 5 WHEN 'harbor' THEN 5 WHEN 'storage-tank' THEN 6 END AS cls
    FROM (SELECT *, list_transform(t[1:8], lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM c_dotat)))""")
def dota_corner_lines(spark, sf):
    p = L.parse_dota_corners(dota_lines(spark, sf))
    return p.select("stem", "ann_id", "status", *[_if_read(c).alias(c) for c in ("class_id", "xmin", "ymin", "xmax", "ymax")])


@query("dota_lines", """
SELECT stem, ann_id, status, CASE WHEN status = 'ok' THEN cls END AS class_id, CASE WHEN status = 'ok' THEN round(cx, 6) END AS cx, CASE WHEN status = 'ok' THEN round(w, 6) END AS w FROM (
  SELECT *, CASE WHEN kind = 0 THEN 'short' WHEN kind = 2 AND cls IS NULL THEN 'unmapped' WHEN bad THEN 'malformed' WHEN cls IS NULL THEN 'unmapped'
    WHEN cx > 0 AND cy > 0 AND w > 0 AND h > 0 THEN 'ok' ELSE 'invalid' END AS status
  FROM (SELECT *, CASE WHEN kind = 1 THEN len(list_filter(v, lambda x: x IS NULL)) > 0 ELSE len(list_filter(p, lambda x: x IS NULL)) > 0 END AS bad,
      greatest(0.0, least(1.0, CASE WHEN kind = 1 THEN (least(v[1], v[3], v[5], v[7]) + greatest(v[1], v[3], v[5], v[7])) / 2 / img_w ELSE p[1] END)) AS cx,
      greatest(0.0, least(1.0, CASE WHEN kind = 1 THEN (least(v[2], v[4], v[6], v[8]) + greatest(v[2], v[4], v[6], v[8])) / 2 / img_h ELSE p[2] END)) AS cy,
      greatest(0.0, least(1.0, CASE WHEN kind = 1 THEN (greatest(v[1], v[3], v[5], v[7]) - least(v[1], v[3], v[5], v[7])) / img_w ELSE p[3] END)) AS w,
      greatest(0.0, least(1.0, CASE WHEN kind = 1 THEN (greatest(v[2], v[4], v[6], v[8]) - least(v[2], v[4], v[6], v[8])) / img_h ELSE p[4] END)) AS h,
      CASE WHEN kind = 3 THEN CASE WHEN num BETWEEN 0 AND 6 THEN CAST(trunc(num) AS INTEGER) END
        ELSE CASE name WHEN 'small-vehicle' THEN 1 WHEN 'large-vehicle' THEN 1 WHEN 'container-crane' THEN 3 WHEN 'plane' THEN 4 WHEN 'helicopter' THEN 4
          WHEN 'airport' THEN 4 WHEN 'helipad' THEN 4 WHEN 'ship' THEN 5 WHEN 'storage-tank' THEN 6 WHEN 'harbor' THEN 6 END END AS cls
    FROM (SELECT *, CASE WHEN num IS NOT NULL AND len(t) >= 9 THEN 1 WHEN num IS NULL AND len(t) >= 5 THEN 2 WHEN len(t) >= 5 THEN 3 ELSE 0 END AS kind,
        lower(CASE WHEN num IS NULL THEN t[1] ELSE t[9] END) AS name
      FROM (SELECT *, TRY_CAST(t[1] AS DOUBLE) AS num, list_transform(t[1:8], lambda x: TRY_CAST(x AS DOUBLE)) AS v,
        list_transform(t[2:5], lambda x: TRY_CAST(x AS DOUBLE)) AS p FROM c_dotat))))""")
def dota_lines_parsed(spark, sf):
    p = L.parse_dota(dota_lines(spark, sf))
    ok = F.col("status") == "ok"
    return p.select("stem", "ann_id", "status", F.when(ok, F.col("class_id")).alias("class_id"),
                    F.when(ok, exact_round("cx", 6)).alias("cx"), F.when(ok, exact_round("w", 6)).alias("w"))


_VEDAI_LINE = """CASE WHEN salt = 1 THEN '# note' WHEN salt = 2 THEN '7 10 10' WHEN salt = 3 THEN '7 10 ten 0 5 5' WHEN salt = 4 THEN '7 10 10 0 -5 5'
  ELSE concat(ann_id, ' ', cast(floor(xmin + bw / 2) AS BIGINT), ' ', cast(floor(ymin + bh / 2) AS BIGINT), ' 1.57 ', cast(floor(bw) AS BIGINT), ' ', cast(floor(bh) AS BIGINT), ' 0 0 2') END"""


@query("vedai_lines", f"""
SELECT stem, ann_id, status, CASE WHEN {_READ} THEN 1 END AS class_id, CASE WHEN {_READ} THEN round(bx, 6) END AS cx, CASE WHEN {_READ} THEN round(bww, 6) END AS w FROM (
  SELECT *, CASE WHEN n < 6 THEN 'short' WHEN cx IS NULL OR cy IS NULL OR w IS NULL OR h IS NULL THEN 'malformed'
    WHEN w > 0 AND h > 0 AND bx > 0 AND by_ > 0 AND bww > 0 AND bhh > 0 THEN 'ok' ELSE 'invalid' END AS status
  FROM (
    SELECT *, greatest(0.0, least(1.0, cx / img_w)) AS bx, greatest(0.0, least(1.0, cy / img_h)) AS by_,
      greatest(0.0, least(1.0, w / img_w)) AS bww, greatest(0.0, least(1.0, h / img_h)) AS bhh
    FROM (
      SELECT stem, ann_id, img_w, img_h, len(t) AS n, TRY_CAST(t[2] AS DOUBLE) AS cx, TRY_CAST(t[3] AS DOUBLE) AS cy, TRY_CAST(t[5] AS DOUBLE) AS w, TRY_CAST(t[6] AS DOUBLE) AS h
      FROM (SELECT *, string_split(line, ' ') AS t FROM (SELECT *, {_VEDAI_LINE} AS line FROM c_box) WHERE line NOT LIKE '#%'))))""")
def vedai_lines(spark, sf):
    rows = boxes(spark, sf).select("stem", "ann_id", "img_w", "img_h", F.expr(_VEDAI_LINE).alias("line"))
    return L.parse_vedai(rows).select(
        "stem", "ann_id", "status", _if_read("class_id").alias("class_id"), *[_if_read(c, 6).alias(c) for c in ("cx", "w")])


_BOUNDS = "concat(cast(floor(xmin) AS BIGINT), ',', cast(floor(ymin) AS BIGINT), ',', cast(floor(xmax) AS BIGINT), ',', cast(floor(ymax) AS BIGINT))"
_FEATURE = f"""CASE WHEN salt = 1 THEN NULL ELSE concat(stem, '.tif') END AS image_id, CASE WHEN salt = 2 THEN NULL ELSE raw_code END AS type_id,
  CASE WHEN salt = 3 THEN '' WHEN salt = 4 THEN '1,2,3' WHEN salt = 5 THEN '1,b,3,4' ELSE {_BOUNDS} END AS bounds_imcoords"""


@query("geojson_features", f"""
SELECT status, count(*) AS features FROM (
  SELECT CASE WHEN image_id IS NULL OR type_id IS NULL OR bounds_imcoords = '' THEN 'malformed' WHEN type_id = '0' THEN 'unmapped'
    WHEN bounds_imcoords IN ('1,2,3', '1,b,3,4') THEN 'malformed' ELSE 'ok' END AS status
  FROM (SELECT {_FEATURE} FROM c_box WHERE source = 'xview')) GROUP BY 1""")
def geojson_features(spark, sf):
    """Features as JSON text, exploded and parsed; skips counted by cause."""
    rows = boxes(spark, sf).filter("source = 'xview'").select("stem", *[F.expr(x) for x in _split_exprs(_FEATURE)])
    docs = rows.groupBy(F.pmod(F.xxhash64("stem"), F.lit(1024)).alias("part")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.struct("image_id", "type_id", "bounds_imcoords").alias("properties"))).alias("features"))).alias("value"))
    feats = docs.select(F.explode(F.from_json("value", L.GEOJSON_SCHEMA)["features"]).alias("f")).select("f.properties.*")
    return L.parse_features(feats).groupBy("status").agg(F.count(F.lit(1)).alias("features"))


def _split_exprs(text):
    parts = text.split(" END AS ")
    out = []
    for i, p in enumerate(parts[:-1]):
        name = parts[i + 1].split(",")[0].strip()
        body = p if i == 0 else p.split(",", 1)[1]
        out.append(f"{body.strip()} END AS {name}")
    return out


@query("geojson_labels", f"""
SELECT stem, class_id, round(greatest(0.0, least(1.0, (x1 + x2) / 2 / img_w)), 6) AS cx, round(greatest(0.0, least(1.0, (x2 - x1) / img_w)), 6) AS w FROM (
  SELECT b.stem, b.img_w, CAST(m.cls AS INTEGER) AS class_id, floor(xmin) AS x1, floor(xmax) AS x2, floor(ymin) AS y1, floor(ymax) AS y2
  FROM c_box b JOIN c_map2 m USING (source, raw_code) WHERE source = 'xview' AND salt > 5 OR (source = 'xview' AND salt = 0)) WHERE x2 > x1 AND y2 > y1""")
def geojson_labels(spark, sf):
    rows = boxes(spark, sf).filter("source = 'xview'").select(*[F.expr(x) for x in _split_exprs(_FEATURE)])
    return L.features_to_labels(L.parse_features(rows), D.images(spark, sf)).select("stem", "class_id", *_r6("cx", "w"))


# --- geometry ---------------------------------------------------------------------------

@query("mapped_classes", "SELECT source, class_id, count(*) AS boxes FROM c_mapped GROUP BY 1, 2")
def mapped_classes(spark, sf):
    return L.map_classes(D.pixel_annotations(spark, sf), "v2").groupBy("source", "class_id").agg(F.count(F.lit(1)).alias("boxes"))


_SHARES = """round((xmin + xmax) / 2 / img_w, 6) AS cx, round((ymin + ymax) / 2 / img_h, 6) AS cy, round((xmax - xmin) / img_w, 6) AS w, round((ymax - ymin) / img_h, 6) AS h"""


@query("share_boxes", f"SELECT stem, ann_id, {_SHARES} FROM c_px")
def share_boxes(spark, sf):
    return K.to_shares(D.pixel_annotations(spark, sf)).select("stem", "ann_id", *_r6("cx", "cy", "w", "h"))


@query("valid_boxes", """
SELECT stem, ann_id, cx > 0 AND cx <= 1 AND cy > 0 AND cy <= 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1 AS is_valid,
  cx >= 0 AND cx <= 1 AND cy >= 0 AND cy <= 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1 AND class_id <= 6 AS is_label FROM (
  SELECT stem, ann_id, class_id + CASE WHEN ann_id % 5 = 4 THEN 3 ELSE 0 END AS class_id, (xmin + xmax) / 2 / img_w + CASE WHEN line_no = 3 THEN 0.6::DOUBLE WHEN line_no = 4 THEN -0.6::DOUBLE ELSE 0 END AS cx,
    CASE WHEN line_no = 6 THEN 0 ELSE (ymin + ymax) / 2 / img_h END AS cy, CASE WHEN line_no = 5 THEN 0 ELSE (xmax - xmin) / img_w END AS w, (ymax - ymin) / img_h AS h FROM c_px)""")
def valid_boxes(spark, sf):
    """Boxes moved out of range or emptied on some lines."""
    s = K.to_shares(D.pixel_annotations(spark, sf)).withColumns({
        "class_id": F.col("class_id") + F.when(F.col("ann_id") % 5 == 4, 3).otherwise(0),
        "cx": F.col("cx") + F.when(F.col("line_no") == 3, 0.6).when(F.col("line_no") == 4, -0.6).otherwise(0.0),
        "cy": F.when(F.col("line_no") == 6, 0.0).otherwise(F.col("cy")), "w": F.when(F.col("line_no") == 5, 0.0).otherwise(F.col("w"))})
    return s.select("stem", "ann_id", G.box_is_valid("cx", "cy", "w", "h").alias("is_valid"),
                    G.label_is_valid("class_id", "cx", "cy", "w", "h").alias("is_label"))


block("c_lb", """
SELECT *, least(nw0, 2 * least(ncx, 1 - ncx)) AS nw, least(nh0, 2 * least(ncy, 1 - ncy)) AS nh FROM (
  SELECT *, greatest(0.001::DOUBLE, least(0.999::DOUBLE, (cx * img_w * scale + px) / 640)) AS ncx, greatest(0.001::DOUBLE, least(0.999::DOUBLE, (cy * img_h * scale + py) / 640)) AS ncy,
    w * img_w * scale / 640 AS nw0, h * img_h * scale / 640 AS nh0
  FROM (SELECT *, (640 - CAST(floor(img_w * scale) AS BIGINT)) // 2 AS px, (640 - CAST(floor(img_h * scale) AS BIGINT)) // 2 AS py
    FROM (SELECT *, least(640.0::DOUBLE / img_w, 640.0::DOUBLE / img_h) AS scale, (xmin + xmax) / 2 / img_w AS cx, (ymin + ymax) / 2 / img_h AS cy, (xmax - xmin) / img_w AS w, (ymax - ymin) / img_h AS h FROM c_px)))
""")


@query("letterboxed_labels", """
SELECT stem, ann_id, class_id, round(ncx, 6) AS cx, round(ncy, 6) AS cy, round(nw, 6) AS w, round(nh, 6) AS h FROM c_lb WHERE nw * 640 >= 3 AND nh * 640 >= 3""")
def letterboxed_labels(spark, sf):
    lb = K.letterbox_labels(K.to_shares(D.pixel_annotations(spark, sf)))
    return lb.select("stem", "ann_id", "class_id", *_r6("cx", "cy", "w", "h"))


@query("small_boxes_dropped", "SELECT source, count(*) FILTER (NOT (nw * 640 >= 3 AND nh * 640 >= 3)) AS dropped, count(*) AS boxes FROM c_lb GROUP BY 1")
def small_boxes_dropped(spark, sf):
    s = K.to_shares(D.pixel_annotations(spark, sf))
    m = G.letterbox_box("cx", "cy", "w", "h", "img_w", "img_h")
    return s.groupBy("source").agg(F.count_if(~G.at_least_px(m["w"], m["h"])).alias("dropped"), F.count(F.lit(1)).alias("boxes"))


@query("small_image_boxes", """
SELECT stem, ann_id, class_id FROM c_px WHERE source = 'dota' AND img_w <= 960 AND img_h <= 960 AND (xmax - xmin) / img_w > 0.003 AND (ymax - ymin) / img_h > 0.003
  AND (xmin + xmax) / 2 > 0 AND (xmin + xmax) / 2 < img_w AND (ymin + ymax) / 2 > 0 AND (ymin + ymax) / 2 < img_h""")
def small_image_boxes(spark, sf):
    d = D.pixel_annotations(spark, sf).filter(F.col("source") == "dota").filter(~K.needs_tiles())
    return K.small_image_gate(K.to_shares(d)).select("stem", "ann_id", "class_id")


_GRID = "list_sort(list_distinct(list_concat(range(0, greatest(1, {s} - 640 + 1), 480), [greatest(0, {s} - 640)])))"
block("c_grid", f"SELECT stem, img_w, img_h, CAST(tile_x AS INTEGER) AS tile_x, CAST(unnest({_GRID.format(s='img_h')}) AS INTEGER) AS tile_y FROM (SELECT *, unnest({_GRID.format(s='img_w')}) AS tile_x FROM c_img)")


@query("tile_grid", "SELECT stem, tile_x, tile_y FROM c_grid")
def tile_grid(spark, sf):
    return K.tile_grid(D.images(spark, sf)).select("stem", "tile_x", "tile_y")


block("c_tiled", """
SELECT stem, ann_id, class_id, tile_x, tile_y, lx, ly, least(lw, 2 * least(lx, 1 - lx)) AS w, least(lh, 2 * least(ly, 1 - ly)) AS h FROM (
  SELECT p.stem, p.ann_id, p.class_id, g.tile_x, g.tile_y, greatest(0.001::DOUBLE, least(0.999::DOUBLE, ((xmin + xmax) / 2 - tile_x) / 640)) AS lx,
    greatest(0.001::DOUBLE, least(0.999::DOUBLE, ((ymin + ymax) / 2 - tile_y) / 640)) AS ly, (xmax - xmin) / 640 AS lw, (ymax - ymin) / 640 AS lh
  FROM c_px p JOIN c_grid g ON g.stem = p.stem AND tile_x <= (xmin + xmax) / 2 AND (xmin + xmax) / 2 < tile_x + 640 AND tile_y <= (ymin + ymax) / 2 AND (ymin + ymax) / 2 < tile_y + 640)
""")


@query("tiled_labels", """
SELECT stem, ann_id, class_id, tile_x, tile_y, round(lx, 6) AS cx, round(ly, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM c_tiled WHERE w * 640 >= 3 AND h * 640 >= 3""")
def tiled_labels(spark, sf):
    """Against a naive join of boxes and tiles."""
    t = K.tile_labels(D.pixel_annotations(spark, sf))
    return t.select("stem", "ann_id", "class_id", "tile_x", "tile_y", *_r6("cx", "cy", "w", "h"))


@query("flipped_labels", "SELECT stem || '_hflip' AS stem, ann_id, round(1 - (xmin + xmax) / 2 / img_w, 6) AS cx FROM c_px")
def flipped_labels(spark, sf):
    return K.flip_labels(K.to_shares(D.pixel_annotations(spark, sf))).select("stem", "ann_id", *_r6("cx"))


@query("label_text", """
SELECT stem, class_id || ' ' || printf('%.6f', (xmin + xmax) / 2 / img_w) || ' ' || printf('%.6f', (ymin + ymax) / 2 / img_h) || ' ' || printf('%.6f', (xmax - xmin) / img_w) || ' ' || printf('%.6f', (ymax - ymin) / img_h) AS line FROM c_px""")
def label_text(spark, sf):
    s = K.to_shares(D.pixel_annotations(spark, sf)).withColumn("split", F.lit("train"))
    return tables.label_text(s).drop("split")


@query("label_files", """
SELECT split, stem, count(*) AS lines, string_agg(line, '|' ORDER BY line) AS content FROM (
  SELECT stem, CASE WHEN right(stem, 1) = '7' THEN 'val' ELSE 'train' END AS split,
    class_id || ' ' || printf('%.6f', (xmin + xmax) / 2 / img_w) || ' ' || printf('%.6f', (ymin + ymax) / 2 / img_h)
      || ' ' || printf('%.6f', (xmax - xmin) / img_w) || ' ' || printf('%.6f', (ymax - ymin) / img_h) AS line
  FROM c_px) GROUP BY 1, 2""")
def label_files_read(spark, sf):
    """A text file per image, written and read again."""
    from scenespark.sinks.label_files import write_label_files

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/labels-{uuid.uuid4().hex[:12]}"
    split = F.when(F.expr("right(stem, 1) = '7'"), "val").otherwise("train")
    write_label_files(K.to_shares(D.pixel_annotations(spark, sf)).withColumn("split", split), path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = [L.read_lines(spark, f"{path}/{name}/labels", tasks).withColumn("split", F.lit(name)) for name in ("train", "val")]
    return lines[0].unionByName(lines[1]).groupBy("split", "stem").agg(
        F.count(F.lit(1)).alias("lines"), F.array_join(F.array_sort(F.collect_list("line")), "|").alias("content"))


@query("image_size_limit", "SELECT count(*) AS kept FROM c_img WHERE CAST(img_w AS BIGINT) * img_h * 60 / (1024 * 1024) <= 150")
def image_size_limit(spark, sf):
    im = D.images(spark, sf).withColumn("bytes", F.col("img_w").cast("bigint") * F.col("img_h") * 60)
    return K.within_limits(im).agg(F.count(F.lit(1)).alias("kept"))


# --- joins and sets ------------------------------------------------------------------------

block("c_lab", """
SELECT a.stem, i.source, a.ann_id, a.class_id FROM c_ann a JOIN c_img i USING (stem)
""")


def labels_only(spark, sf):
    """Class labels of existing images, before any geometry."""
    im = D.images(spark, sf).select("stem", "source")
    return D.annotations(spark, sf).select("stem", "ann_id", "class_id").join(im, "stem")


@query("orphans", """
SELECT 'image' AS side, stem FROM (SELECT DISTINCT stem FROM c_imgr EXCEPT SELECT DISTINCT stem FROM c_annr)
UNION ALL SELECT 'label', stem FROM (SELECT DISTINCT stem FROM c_annr EXCEPT SELECT DISTINCT stem FROM c_imgr)""")
def orphans(spark, sf):
    im, an = D.images(spark, sf, True).select("stem"), D.annotations(spark, sf, True).select("stem").distinct()
    left = im.join(an, "stem", "left_anti").select(F.lit("image").alias("side"), "stem")
    return left.unionByName(an.join(im, "stem", "left_anti").select(F.lit("label").alias("side"), "stem"))


@query("labelled_images", "SELECT source, count(*) AS images FROM c_imgr WHERE stem IN (SELECT stem FROM c_annr) GROUP BY 1")
def labelled_images(spark, sf):
    return D.images(spark, sf, True).join(D.annotations(spark, sf, True).select("stem"), "stem", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("images"))


@query("combined_sources", "SELECT source || '_' || stem AS stem, count(*) AS boxes FROM c_lab GROUP BY 1")
def combined_sources(spark, sf):
    a = labels_only(spark, sf)
    parts = [a.filter(F.col("source") == s).withColumn("stem", K.source_stem()) for s in ("xview", "visdrone", "dota")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("stem").agg(F.count(F.lit(1)).alias("boxes"))


@query("rare_class_overlap", """
SELECT stem, array_to_string(list_sort(list_filter(list(DISTINCT class_id), lambda x: x >= 3)), ',') AS rare FROM c_lab GROUP BY 1 HAVING max(class_id) >= 3""")
def rare_class_overlap(spark, sf):
    idx = K.image_index(labels_only(spark, sf))
    rare = F.array_sort(F.array_intersect("classes", F.lit(C.RARE_CLASSES)))
    return idx.select("stem", F.array_join(F.transform(rare, lambda x: x.cast("string")), ",").alias("rare")).filter("rare <> ''")


# --- balancing ----------------------------------------------------------------------------

block("c_cat", """
SELECT stem, classes, boxes, CASE WHEN len(list_filter(classes, lambda x: x >= 3)) > 0 THEN 'rare' WHEN list_contains(classes, 0) THEN 'person'
  WHEN list_contains(classes, 2) AND list_contains(classes, 1) THEN 'crowd_vehicle' WHEN list_contains(classes, 2) THEN 'crowd_only'
  WHEN list_contains(classes, 1) THEN 'vehicle_only' ELSE 'other' END AS category
FROM (SELECT stem, list(DISTINCT class_id ORDER BY class_id) AS classes, count(*) AS boxes FROM c_lab GROUP BY 1)
""")
block("c_sel", """
SELECT stem, classes, boxes, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(stem || ':42'), stem) AS pos, count(*) OVER (PARTITION BY category) AS n FROM c_cat)
WHERE CASE category WHEN 'vehicle_only' THEN pos <= floor(n * 0.12::DOUBLE) WHEN 'crowd_vehicle' THEN pos <= floor(n * 0.25::DOUBLE) ELSE true END
""")
block("c_aug", """
SELECT stem, category, classes FROM c_sel UNION ALL
SELECT s.stem || '_hflip', 'rare_aug', s.classes FROM c_sel s WHERE category = 'rare' AND EXISTS (
  SELECT 1 FROM (SELECT c, count(*) AS n FROM (SELECT unnest(classes) AS c FROM c_sel WHERE category = 'rare') WHERE c >= 3 GROUP BY 1 HAVING count(*) < 500) k WHERE list_contains(s.classes, k.c))
""")
block("c_split", """
SELECT stem, category, CASE WHEN n < 3 OR pos <= n - 2 * greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) THEN 'train'
  WHEN pos <= n - greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(stem || ':43'), stem) AS pos, count(*) OVER (PARTITION BY category) AS n FROM c_aug)
""")


def categories(spark, sf):
    return K.categorise(K.image_index(labels_only(spark, sf)))


def _selected(spark, sf):
    # one narrow row per image, used several times by the ranks
    return K.downsample(cut(categories(spark, sf)))


def _augmented(spark, sf):
    return K.augment(cut(_selected(spark, sf)))


@query("image_categories", "SELECT stem, category, array_to_string(classes, ',') AS classes, boxes FROM c_cat")
def image_categories(spark, sf):
    return categories(spark, sf).withColumn("classes", F.array_join(F.transform("classes", lambda c: c.cast("string")), ","))


@query("class_distribution", """
SELECT class_id, count(DISTINCT stem) AS images, count(*) AS annotations, round(count(DISTINCT stem) / (SELECT count(DISTINCT stem) FROM c_lab) * 100, 1) AS image_pct FROM c_lab GROUP BY 1""")
def class_distribution(spark, sf):
    return K.class_distribution(labels_only(spark, sf))


@query("downsampled_images", "SELECT stem, category FROM c_sel")
def downsampled_images(spark, sf):
    return _selected(spark, sf).select("stem", "category")


@query("projected_distribution", """
SELECT class_id, count(DISTINCT stem) AS images, count(*) AS annotations FROM c_lab WHERE stem IN (SELECT stem FROM c_sel) GROUP BY 1""")
def projected_distribution(spark, sf):
    kept = labels_only(spark, sf).join(_selected(spark, sf).select("stem"), "stem", "left_semi")
    return K.class_distribution(kept).drop("image_pct")


@query("augmented_images", "SELECT stem, category FROM c_aug")
def augmented_images(spark, sf):
    return _augmented(spark, sf).select("stem", "category")


@query("augmented_labels", """
SELECT a.stem, l.class_id, count(*) AS boxes, max(CASE WHEN a.category = 'rare_aug' THEN 0.75::DOUBLE ELSE 0.25 END) AS cx
FROM c_aug a JOIN c_lab l ON l.stem = CASE WHEN a.category = 'rare_aug' THEN left(a.stem, len(a.stem) - 6) ELSE a.stem END GROUP BY 1, 2""")
def augmented_labels(spark, sf):
    lab = labels_only(spark, sf).withColumn("cx", F.lit(0.25))
    return K.labels_of(_augmented(spark, sf), lab).groupBy("stem", "class_id").agg(
        F.count(F.lit(1)).alias("boxes"), F.max("cx").alias("cx"))


@query("stratified_split", "SELECT stem, category, split FROM c_split")
def stratified_split(spark, sf):
    return K.stratified_split(_augmented(spark, sf)).select("stem", "category", "split")


block("c_rsplit", """
SELECT stem, source, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(stem || ':42'), stem) AS pos, count(*) OVER (PARTITION BY source) AS n FROM c_img)
""")


def _random_split(spark, sf):
    return K.random_split(D.images(spark, sf)).select("stem", "source", "split")


@query("random_split", "SELECT stem, source, split FROM c_rsplit")
def random_split(spark, sf):
    return _random_split(spark, sf)


@query("source_split", """
SELECT stem, source, CASE WHEN img_w % 5 = 0 THEN 'val' WHEN pos <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY source, img_w % 5 = 0 ORDER BY stem) AS pos, count(*) OVER (PARTITION BY source, img_w % 5 = 0) AS n FROM c_img)""")
def source_split(spark, sf):
    im = D.images(spark, sf).withColumn("given_split", F.when(F.col("img_w") % 5 == 0, "val").otherwise("train"))
    return K.source_split(im).select("stem", "source", "split")


@query("vehicle_box_cap", """
SELECT stem, ann_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY stem, class_id = 1 ORDER BY md5(stem || ':' || ann_id || ':42'), ann_id) AS rn FROM c_lab)
WHERE class_id <> 1 OR rn <= 4""")
def vehicle_box_cap(spark, sf):
    """A low cap, so that many images exceed it."""
    return K.cap_vehicle_boxes(labels_only(spark, sf), 4).select("stem", "ann_id", "class_id")


@query("vehicle_only_removed", """
SELECT split, stem FROM (SELECT *, row_number() OVER (PARTITION BY split, category = 'vehicle_only' ORDER BY md5(stem || ':42'), stem) AS pos,
  count(*) OVER (PARTITION BY split, category = 'vehicle_only') AS n FROM c_cat JOIN c_rsplit USING (stem)) WHERE category <> 'vehicle_only' OR pos > floor(n * 0.5::DOUBLE)""")
def vehicle_only_removed(spark, sf):
    idx = K.image_index(labels_only(spark, sf)).join(_random_split(spark, sf), "stem")
    return K.drop_vehicle_only(idx).select("split", "stem")


# --- corpus statistics -----------------------------------------------------------------------

_NAMES = "(VALUES (0, 'person'), (1, 'vehicle'), (2, 'crowd'), (3, 'military_vehicle'), (4, 'aircraft'), (5, 'ship'), (6, 'suspicious_object')) k(class_id, class_name)"
block("c_slab", "SELECT l.*, s.split FROM c_lab l JOIN c_rsplit s USING (stem)")


def _split_labels(spark, sf):
    return labels_only(spark, sf).join(_random_split(spark, sf).drop("source"), "stem")


@query("split_statistics", f"""
WITH b AS (SELECT split, class_id FROM c_slab UNION ALL SELECT 'all', class_id FROM c_slab),
g AS (SELECT split, class_id, count(*) AS n FROM b GROUP BY 1, 2),
t AS (SELECT split, CAST(sum(n) AS BIGINT) AS total, round(max(n) / greatest(1, min(n)), 1) AS imbalance FROM g GROUP BY 1)
SELECT t.split, t.total, t.imbalance, k.class_id, k.class_name, coalesce(g.n, 0) AS annotations, round(coalesce(g.n, 0) / greatest(1, t.total) * 100, 1) AS pct
FROM t CROSS JOIN {_NAMES} LEFT JOIN g ON g.split = t.split AND g.class_id = k.class_id""")
def split_statistics(spark, sf):
    return K.split_statistics(_split_labels(spark, sf))


@query("class_balance", f"""
SELECT class_id, class_name, n AS annotations, round(pct, 1) AS pct, CASE WHEN n = 0 THEN 'NO DATA' WHEN pct > 70 THEN 'HEAVILY IMBALANCED' WHEN pct < 1 THEN 'TOO RARE' ELSE 'OK' END AS verdict,
  n = 0 AS is_missing, n > 0 AND n < 100 AS is_rare
FROM (SELECT k.class_id, k.class_name, count(l.stem) AS n, count(l.stem) / (SELECT count(*) FROM c_lab) * 100 AS pct
  FROM {_NAMES} LEFT JOIN c_lab l ON l.class_id = k.class_id GROUP BY 1, 2)""")
def class_balance(spark, sf):
    return K.class_balance(labels_only(spark, sf))


@query("version_comparison", f"""
WITH a AS (SELECT class_id FROM (SELECT *, row_number() OVER (PARTITION BY stem, class_id = 1 ORDER BY md5(stem || ':' || ann_id || ':42'), ann_id) AS rn FROM c_lab) WHERE class_id <> 1 OR rn <= 4),
c AS (SELECT k.class_id, k.class_name, (SELECT count(*) FROM c_lab l WHERE l.class_id = k.class_id) AS before_n, (SELECT count(*) FROM a WHERE a.class_id = k.class_id) AS after_n FROM {_NAMES}),
p AS (SELECT *, before_n / (SELECT count(*) FROM c_lab) * 100 AS bp, after_n / (SELECT count(*) FROM a) * 100 AS ap FROM c)
SELECT class_id, class_name, before_n, after_n, round(bp, 1) AS before_pct, round(ap, 1) AS after_pct, round(ap - bp, 1) AS change,
  CASE WHEN ap > bp THEN 'up' WHEN ap < bp THEN 'down' ELSE 'same' END AS direction FROM p""")
def version_comparison(spark, sf):
    a = labels_only(spark, sf)
    return K.compare_versions(a, K.cap_vehicle_boxes(a, 4))


block("c_file", "SELECT stem, CAST(right(stem, 1) AS INTEGER) % 3 AS part FROM (SELECT DISTINCT stem FROM c_yolo)")
_SPLIT = "CASE WHEN right(stem, 1) IN ('0', '1') THEN 'val' WHEN right(stem, 1) = '2' THEN 'test' ELSE 'train' END"


@query("split_quality", f"""
WITH i AS (SELECT stem, {_SPLIT} AS split FROM c_imgr),
f AS (SELECT DISTINCT stem, {_SPLIT} AS split FROM c_yolo),
l AS (SELECT stem, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS bad,
  count(*) FILTER (status = 'ok' AND a = 1) AS c1 FROM c_yolop GROUP BY 1)
SELECT split, count(ik) AS images, count(fk) AS label_files, count(*) FILTER (fk IS NULL) AS orphan_images, count(*) FILTER (ik IS NULL) AS orphan_labels,
  count(*) FILTER (fk IS NOT NULL AND ok IS NULL) AS empty_labels, CAST(coalesce(sum(ok), 0) AS BIGINT) AS total_boxes, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad_boxes, CAST(coalesce(sum(c1), 0) AS BIGINT) AS class_1
FROM (SELECT coalesce(i.split, f.split) AS split, coalesce(i.stem, f.stem) AS stem, i.stem AS ik, f.stem AS fk FROM i FULL JOIN f ON i.stem = f.stem) LEFT JOIN l USING (stem) GROUP BY 1""")
def split_quality(spark, sf):
    split = F.expr(_SPLIT).alias("split")
    images = D.images(spark, sf, True).select(split, "stem")
    lines = yolo_lines(spark, sf)
    files = lines.select(split, "stem").distinct()
    parsed = L.parse_yolo(lines.select(split, "stem", "line"))
    q = K.split_quality(images, files, parsed)
    return q.select("split", "images", "label_files", "orphan_images", "orphan_labels", "empty_labels", "total_boxes", "bad_boxes", "class_1")


@query("preparation_stats", """
WITH l AS (SELECT stem, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS bad FROM c_yolop GROUP BY 1),
f AS (SELECT DISTINCT stem FROM c_yolo), r AS (SELECT source, i.stem, f.stem AS fk, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad FROM c_imgr i LEFT JOIN f ON f.stem = i.stem LEFT JOIN l ON l.stem = i.stem),
u AS (SELECT * FROM r UNION ALL SELECT 'total', stem, fk, ok, bad FROM r)
SELECT source, count(*) AS images_written, count(*) AS labels_written, CAST(sum(ok) AS BIGINT) AS annotations_ok, CAST(sum(bad) AS BIGINT) AS annotations_skipped,
  count(*) FILTER (fk IS NULL) AS files_missing, count(*) FILTER (ok = 0) AS empty_labels FROM u GROUP BY 1""")
def preparation_stats(spark, sf):
    lines = yolo_lines(spark, sf)
    return K.preparation_stats(D.images(spark, sf, True), lines.select("stem").distinct(), L.parse_yolo(lines.drop("source")))


@query("skipped_lines", """
SELECT source, count(*) FILTER (status = 'ok') AS kept, count(*) FILTER (status <> 'ok') AS skipped, count(*) FILTER (status = 'short') AS short,
  count(*) FILTER (status = 'malformed') AS malformed, count(*) FILTER (status = 'unmapped') AS unmapped, count(*) FILTER (status = 'invalid') AS invalid FROM c_yolop GROUP BY 1""")
def skipped_lines(spark, sf):
    return L.skip_counts(L.parse_yolo(yolo_lines(spark, sf)), ["source"])


# --- the whole preparation -------------------------------------------------------------------

block("c_staged", """
SELECT stem, class_id, cx, cy, w, h FROM (
  SELECT stem, class_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM (
    SELECT source || '_' || stem AS stem, class_id, ncx AS cx, ncy AS cy, nw AS w, nh AS h FROM c_stlb WHERE nw * 640 >= 3 AND nh * 640 >= 3
    UNION ALL SELECT 'dota_' || stem || '_t' || tile_x || '_' || tile_y, class_id, lx, ly, w, h FROM c_sttile WHERE w * 640 >= 3 AND h * 640 >= 3))
WHERE cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1
""")
block("c_stbox", """
SELECT stem, source, img_w, img_h, class_id, CASE WHEN source = 'visdrone' THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, cx)) ELSE cx END AS cx,
  CASE WHEN source = 'visdrone' THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, cy)) ELSE cy END AS cy,
  CASE WHEN source = 'visdrone' THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, w)) ELSE w END AS w,
  CASE WHEN source = 'visdrone' THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, h)) ELSE h END AS h
FROM (SELECT *, (xmin + xmax) / 2 / img_w AS cx, (ymin + ymax) / 2 / img_h AS cy, (xmax - xmin) / img_w AS w, (ymax - ymin) / img_h AS h FROM c_mapped)
WHERE source = 'xview' OR source = 'visdrone' OR (img_w <= 960 AND img_h <= 960 AND cx > 0 AND cx < 1 AND cy > 0 AND cy < 1 AND w > 0.003 AND h > 0.003)
""")
block("c_stlb", """
SELECT *, least(nw0, 2 * least(ncx, 1 - ncx)) AS nw, least(nh0, 2 * least(ncy, 1 - ncy)) AS nh FROM (
  SELECT *, greatest(0.001::DOUBLE, least(0.999::DOUBLE, (cx * img_w * scale + px) / 640)) AS ncx, greatest(0.001::DOUBLE, least(0.999::DOUBLE, (cy * img_h * scale + py) / 640)) AS ncy,
    w * img_w * scale / 640 AS nw0, h * img_h * scale / 640 AS nh0
  FROM (SELECT *, (640 - CAST(floor(img_w * scale) AS BIGINT)) // 2 AS px, (640 - CAST(floor(img_h * scale) AS BIGINT)) // 2 AS py
    FROM (SELECT *, least(640.0::DOUBLE / img_w, 640.0::DOUBLE / img_h) AS scale FROM c_stbox WHERE source <> 'visdrone' OR (w * img_w >= 3 AND h * img_h >= 3))))
""")
block("c_sttile", """
SELECT stem, class_id, tile_x, tile_y, lx, ly, least(lw, 2 * least(lx, 1 - lx)) AS w, least(lh, 2 * least(ly, 1 - ly)) AS h FROM (
  SELECT p.stem, p.class_id, g.tile_x, g.tile_y, greatest(0.001::DOUBLE, least(0.999::DOUBLE, ((xmin + xmax) / 2 - tile_x) / 640)) AS lx,
    greatest(0.001::DOUBLE, least(0.999::DOUBLE, ((ymin + ymax) / 2 - tile_y) / 640)) AS ly, (xmax - xmin) / 640 AS lw, (ymax - ymin) / 640 AS lh
  FROM c_mapped p JOIN c_grid g ON g.stem = p.stem AND tile_x <= (xmin + xmax) / 2 AND (xmin + xmax) / 2 < tile_x + 640 AND tile_y <= (ymin + ymax) / 2 AND (ymin + ymax) / 2 < tile_y + 640
  WHERE p.source = 'dota' AND (p.img_w > 960 OR p.img_h > 960))
""")


def _mapped(spark, sf):
    return L.map_classes(D.pixel_annotations(spark, sf), "v2")


def _staged(spark, sf):
    return K.stage(_mapped(spark, sf))


@query("staged_labels", "SELECT * FROM c_staged")
def staged_labels(spark, sf):
    return _staged(spark, sf).drop("source")


_FULL = """
WITH a AS (SELECT stem, category, split FROM {split})
SELECT a.split, a.category, s.class_id, count(*) AS boxes, count(DISTINCT a.stem) AS images FROM a JOIN c_staged s ON s.stem = CASE WHEN a.category = 'rare_aug' THEN left(a.stem, len(a.stem) - 6) ELSE a.stem END GROUP BY 1, 2, 3"""


def _renamed(name, source_map):
    from scenespark.plans.registry import CTES

    sql = CTES[name]
    for old, new in source_map.items():
        sql = sql.replace(old, new)
    return sql


block("d_cat", _renamed("c_cat", {"c_lab": "c_staged"}))
block("d_sel", _renamed("c_sel", {"c_cat": "d_cat"}))
block("d_aug", _renamed("c_aug", {"c_sel": "d_sel"}))
block("d_split", _renamed("c_split", {"c_aug": "d_aug"}))


@query("corpus_build", _FULL.format(split="d_split"))
def corpus_build(spark, sf):
    """Union, class map, letterbox and tiles, balance, augmentation, split, statistics."""
    c = K.build_corpus(_mapped(spark, sf))
    per = c.labels.groupBy("split", "stem", "class_id").agg(F.count(F.lit(1)).alias("n"))
    return per.join(c.images.select("stem", "category"), "stem").groupBy("split", "category", "class_id").agg(
        F.sum("n").alias("boxes"), F.count(F.lit(1)).alias("images"))
