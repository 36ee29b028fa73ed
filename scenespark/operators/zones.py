"""Spatial zones: first-match point-in-polygon, violations, risk per frame."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.functions import scores, text
from scenespark.functions.geometry import in_polygon, in_polygon_array

# Zones given as code become constants of the plan; more than these join as a table, with the same result.
INLINE_ZONES = 64
KEY = ["feed_id", "frame_id"]
# a cell of one level of the grid has 4 x 4 cells of the level below
LEVEL_BITS = 2
LEVELS = 24


def zone_defaults(zones: list[dict] | None) -> list[dict]:
    """Fill missing zone fields. Order is meaning: the first match wins."""
    zones = zones or C.DEFAULT_ZONES
    # Defaults.
    return [
        {
            "zone_order": i,
            "name": z["name"],
            "polygon": z["polygon"],
            "level": z.get("level", "OBSERVATION"),
            "label": z.get("label", z["name"]),
            "color": z.get("color", "#ffffff"),
        }
        for i, z in enumerate(zones)
    ]


ZONE_SCHEMA = (
    "zone_order int, name string, level string, label string, color string, "
    "polygon array<struct<x:double,y:double>>"
)


def zone_table(spark: SparkSession, zones: list[dict] | None = None) -> DataFrame:
    rows = [
        (z["zone_order"], z["name"], z["level"], z["label"], z["color"], [tuple(map(float, p)) for p in z["polygon"]])
        for z in zone_defaults(zones)
    ]
    return spark.createDataFrame(rows, ZONE_SCHEMA)


def is_table(zones: list[dict] | DataFrame | None) -> bool:
    """Whether a zone set joins as a table: one that is a table, or too long for constants of a plan."""
    return isinstance(zones, DataFrame) or len(zones or ()) > INLINE_ZONES


def as_table(spark: SparkSession, zones: list[dict] | DataFrame) -> DataFrame:
    """A zone set as a table with all its fields: ``zone_order``, ``name`` and ``polygon`` must be
    there, names are unique in a set, and an optional ``feed_id`` gives each feed a set of its own."""
    if not isinstance(zones, DataFrame):
        return zone_table(spark, zones)

    def field(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in zones.columns else default).alias(name)

    # Defaults.
    return zones.select(
        *(["feed_id"] if "feed_id" in zones.columns else []), "zone_order", "name",
        field("level", F.lit("OBSERVATION")), field("label", F.col("name")), field("color", F.lit("#ffffff")), "polygon")


def _zone_struct(z: dict) -> Column:
    return F.struct(
        F.lit(z["name"]).alias("name"), F.lit(z["level"]).alias("level"), F.lit(z["label"]).alias("label"),
        F.lit(z["zone_order"]).alias("zone_order"),
    )


def _violation_columns(df: DataFrame) -> DataFrame:
    levels = C.ZONE_LEVELS
    return (
        df.withColumn("zone_name", F.col("_zone.name"))
        .withColumn("zone_level", F.col("_zone.level"))
        .withColumn("zone_label", F.col("_zone.label"))
        .withColumn("zone_order", F.col("_zone.zone_order"))
        .drop("_zone")
        .withColumn("is_violation", F.coalesce(F.col("zone_level") != "SAFE", F.lit(False)))
        .withColumn("is_high_threat", F.col("class_name").isin(C.ZONE_THREAT_CLASSES) & F.col("is_violation"))
        .withColumn("priority", F.when(
            F.col("is_violation"),
            scores.lookup({k: v[0] for k, v in levels.items()}, "zone_level", "LOW"),
        ))
    )


def assign_zones(detections: DataFrame, zones: list[dict] | DataFrame | None = None) -> DataFrame:
    """Zone of each detection, from zones known when the plan is built or from a zone table.

    The polygons of a small set are constants, so the spatial join is one CASE
    expression: no join, no shuffle, and branch order is zone order.
    """
    if is_table(zones):
        return join_zones(detections, as_table(detections.sparkSession, zones))
    zones = zone_defaults(zones)
    case = None
    for z in zones:
        hit = in_polygon("center_x", "center_y", z["polygon"])
        case = F.when(hit, _zone_struct(z)) if case is None else case.when(hit, _zone_struct(z))
    return _violation_columns(detections.withColumn("_zone", case))


def _placed(zones: DataFrame, side: Column) -> DataFrame:
    """Zones with the cells of their level (``_level, _cx, _cy``) and their reach in the finest cells.

    The level is the first whose cells are as wide as the zone, so a zone touches four
    cells at most, whatever its size.
    """
    xs, ys = F.col("polygon.x"), F.col("polygon.y")
    boxed = zones.filter(F.size("polygon") > 0).withColumns({
        "_x1": F.floor(F.array_min(xs) / side), "_x2": F.floor(F.array_max(xs) / side),
        "_y1": F.floor(F.array_min(ys) / side), "_y2": F.floor(F.array_max(ys) / side),
    })
    reach = F.greatest(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1"), F.lit(1))
    level = F.least(F.ceil(F.log2(reach) / LEVEL_BITS), F.lit(LEVELS)).cast("int")

    def between(a: str, b: str) -> Column:
        return F.sequence(_above(F.col(a), "_level"), _above(F.col(b), "_level"))

    return (
        boxed.withColumn("_level", level)
        .withColumn("_cx", F.explode(between("_x1", "_x2"))).withColumn("_cy", F.explode(between("_y1", "_y2")))
    )


def _above(cell: Column, level: str | int) -> Column:
    """The cell of a level that holds a finest cell."""
    bits = f"{LEVEL_BITS} * {level}"
    return F.call_function("shiftright", cell.cast("bigint"), F.expr(f"cast({bits} as int)"))


_ZONE = ["zone_order", "name", "level", "label", "polygon"]


def join_zones(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """The same from a zone table, optionally one zone set per ``feed_id``.

    A grid of several levels: each zone enters the few cells of the level that suits its
    size, and a finest cell that holds detections gathers the zones of the cells above it,
    so small and large zones meet their detections alike. Detections join once on their
    finest cell and are never multiplied by zones; the first hit is found inside the row.
    A stream of detections joins the (static) zones level by level instead, because
    gathering needs all of its cells.
    """
    keys = ["feed_id"] if "feed_id" in zones.columns else []
    xs, ys = F.col("polygon.x"), F.col("polygon.y")
    # the finest cells suit small zones; those below the tenth part share them
    extent = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    side = zones.filter(F.size("polygon") > 0).agg(
        F.coalesce(F.greatest(F.percentile_approx(extent, 0.1), F.lit(1e-6)), F.lit(1.0)).alias("side"))
    width = F.lit(side.head()["side"]) if detections.isStreaming else side.scalar()
    placed = _placed(zones.withColumn("_side", width), F.col("_side"))
    celled = detections.withColumn("_side", width).withColumns({
        "_fx": F.floor(F.col("center_x") / F.col("_side")), "_fy": F.floor(F.col("center_y") / F.col("_side")),
    }).drop("_side")
    if detections.isStreaming:
        names = []
        for level in sorted(r[0] for r in placed.select("_level").distinct().collect()):  # LEVELS at most
            names.append(f"_zones{level}")
            packed = placed.filter(F.col("_level") == level).groupBy(*keys, "_cx", "_cy").agg(
                F.collect_list(F.struct(*_ZONE)).alias(names[-1]))
            celled = celled.withColumns({"_cx": _above(F.col("_fx"), level), "_cy": _above(F.col("_fy"), level)}).join(
                packed, [*keys, "_cx", "_cy"], "left").drop("_cx", "_cy")
        none = F.array().cast(placed.select(F.array(F.struct(*_ZONE))).schema[0].dataType)
        lists = F.array(none, *[F.coalesce(F.col(n), none) for n in names])
        joined = celled.withColumn("_zones", F.array_sort(F.flatten(lists))).drop(*names)
    else:
        cells = celled.select(*keys, "_fx", "_fy").distinct().withColumn(
            "_level", F.explode(placed.agg(F.collect_set("_level").alias("levels")).scalar()))
        cells = cells.withColumns({"_cx": _above(F.col("_fx"), "_level"), "_cy": _above(F.col("_fy"), "_level")})
        # zones and their cells are rows of unknown number, more than the size of their files tells
        packed = (
            cells.join(placed.hint("merge"), [*keys, "_level", "_cx", "_cy"])
            .filter("_fx BETWEEN _x1 AND _x2 AND _fy BETWEEN _y1 AND _y2")
            .groupBy(*keys, "_fx", "_fy").agg(F.array_sort(F.collect_list(F.struct(*_ZONE))).alias("_zones"))
        )
        joined = celled.join(packed.hint("merge"), [*keys, "_fx", "_fy"], "left")
    hit = F.filter("_zones", lambda z: in_polygon_array("center_x", "center_y", z["polygon"]))
    return _violation_columns(
        joined.withColumn("_hit", F.get(hit, F.lit(0)))
        .withColumn("_zone", F.when(
            F.col("_hit").isNotNull(), F.struct("_hit.name", "_hit.level", "_hit.label", "_hit.zone_order")))
        .drop("_zones", "_hit", "_fx", "_fy")
    )


def violations(assigned: DataFrame) -> DataFrame:
    """One row per violating detection, with its reason.

    The zone is a finished value before the filter, which would otherwise be pushed into
    the polygon tests and repeat them beyond what one compiled method may hold.
    """
    finished = assigned.select(F.inline(F.array(F.struct(*assigned.columns))))
    return finished.filter("is_violation").select(
        "feed_id", "frame_id", "ts", "det_id", "zone_name", "zone_level", "zone_label", "priority",
        "class_name", "confidence", "center_x", "center_y", "is_high_threat",
        text.violation_reason("class_name", "confidence", "zone_label", "is_high_threat").alias("reason"),
    )


def zone_aggregates(zones: list[dict] | DataFrame | None = None, reasons: bool = True) -> dict[str, Column]:
    """Per-frame aggregates over ``assign_zones`` rows, for ``frame_facts(extra=...)``.

    Zones of a table have no columns of their own; ``zone_hits`` counts them.
    """
    viol, table = F.col("is_violation"), is_table(zones)
    aggs = {} if table else {
        f"zone_{z['zone_order']}": F.count_if(F.col("zone_name") == z["name"]) for z in zone_defaults(zones)}
    aggs["violation_count"] = F.count_if(viol)
    aggs["zone_rank"] = F.max(F.when(viol, scores.severity_rank("zone_level")))
    aggs["restricted_threats"] = F.count_if((F.col("zone_level") == "RESTRICTED") & F.col("is_high_threat"))
    if reasons:
        # what the text needs, not the text: that is built after the shuffle
        zone = F.col("zone_label") if table else scores.lookup(
            {z["name"]: z["zone_order"] for z in zone_defaults(zones)}, "zone_name")
        entry = F.when(viol, F.struct("det_id", "class_name", "confidence", zone.alias("zone")))
        # collect_list skips nulls; one entry per violating detection of one frame
        aggs["_zone_reasons"] = F.array_sort(F.collect_list(entry))
    return aggs


def zone_hits(assigned: DataFrame) -> DataFrame:
    """The zones hit in each frame, in zone order, with their counts: ``feed_id, frame_id, _zone_hits``.

    Counted per frame and zone first, so a frame's list is as long as the zones it hits,
    however many zones or detections there are.
    """
    each = assigned.filter("zone_name IS NOT NULL").groupBy(*KEY, "zone_order", "zone_name", "zone_level").agg(
        F.count(F.lit(1)).alias("n"))
    return each.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("zone_order", "zone_name", "zone_level", "n"))).alias("_zone_hits"))


def _reason_texts(entries: Column, zones: list[dict] | None, keep: int | None) -> Column:
    if keep is not None:
        entries = F.slice(entries, 1, keep)
    labels = F.array(*[F.lit(z["label"]) for z in zones]) if zones else None
    return F.transform(entries, lambda e: text.violation_reason(
        e["class_name"], e["confidence"], e["zone"] if labels is None else F.get(labels, e["zone"]),
        e["class_name"].isin(C.ZONE_THREAT_CLASSES)))


def _zone_risk_of(risk: Column, level: Column, count: Column) -> Column:
    """Risk after one more zone; a SAFE one adds none."""
    base = F.lit(0.0)
    for name, (_, _, share) in C.ZONE_LEVELS.items():
        base = F.when(level == name, F.lit(share)).otherwise(base)
    more = risk + base * count + C.ZONE_CROWDING_RISK * F.greatest(count - 1, F.lit(0))
    return F.when(level == "SAFE", risk).otherwise(more)


def zone_risk(
    facts: DataFrame, zones: list[dict] | DataFrame | None = None, night: bool = True, keep_reasons: int | None = None,
    hits: DataFrame | None = None,
) -> DataFrame:
    """Severity, per-zone counts and risk from frame facts carrying zone aggregates.

    ``keep_reasons`` words only the first reasons of a frame, all when None. Zones of a
    table need their ``hits`` (``zone_hits``); ``zone_scores`` then lists the zones hit,
    where a set given as code lists all of its zones.
    """
    restricted = C.ZONE_HIGH_THREAT_RISK * F.coalesce("restricted_threats", F.lit(0))
    if is_table(zones):
        if hits is None:
            raise ValueError("zones of a table need the hits of zone_hits()")
        facts = facts.join(hits, KEY, "left")
        none = F.array().cast(hits.schema["_zone_hits"].dataType)
        entries, zones, columns = F.coalesce("_zone_hits", none), None, ["_zone_hits"]
        counted = F.map_from_arrays(
            F.transform(entries, lambda e: e["zone_name"]), F.transform(entries, lambda e: e["n"]))
        risk = F.aggregate(entries, restricted, lambda r, e: _zone_risk_of(r, e["zone_level"], e["n"]))
    else:
        zones = zone_defaults(zones)
        columns = [f"zone_{z['zone_order']}" for z in zones]
        n = {z["name"]: F.coalesce(F.col(f"zone_{z['zone_order']}"), F.lit(0)) for z in zones}
        counted = F.create_map(*[x for k, c in n.items() for x in (F.lit(k), c)])
        risk = restricted
        for z in zones:
            if z["level"] == "SAFE":
                continue
            base = C.ZONE_LEVELS.get(z["level"], ("", 0, 0.0))[2]
            count = n[z["name"]]
            risk = risk + base * count + C.ZONE_CROWDING_RISK * F.greatest(count - 1, F.lit(0))
    out = facts.withColumns({
        "violation_count": F.coalesce("violation_count", F.lit(0)),
        "max_severity": scores.severity_of_rank(F.coalesce("zone_rank", F.lit(0))),
        "zone_scores": counted,
        "zone_risk": F.least(F.lit(1.0), risk),
    })
    if "_zone_reasons" in facts.columns:
        out = out.withColumn(
            "zone_reasons",
            F.coalesce(_reason_texts(F.col("_zone_reasons"), zones, keep_reasons), F.array().cast("array<string>")),
        ).drop("_zone_reasons")
    if night:
        out = out.withColumn("zone_risk", scores.night_boost("zone_risk", "ts"))
    return out.drop("zone_rank", "restricted_threats", *columns)


def zone_summary(risk: DataFrame, zones: list[dict] | DataFrame | None = None) -> DataFrame:
    """Session summary per feed; SAFE hits count as visits, not violations.

    For zones of a table ``violations_by_zone`` lists the zones that were hit.
    """
    totals = [F.count(F.lit(1)).alias("total_frames"), F.sum("violation_count").alias("total_violations")]
    if is_table(zones):
        zones = as_table(risk.sparkSession, zones)
        keys = ["feed_id"] if "feed_id" in zones.columns else []
        each = risk.select("feed_id", F.explode("zone_scores").alias("name", "n")).groupBy("feed_id", "name").agg(
            F.sum("n").alias("n"))
        by_zone = each.join(zones.select(*keys, "name", "level").hint("merge"), [*keys, "name"]).groupBy("feed_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(
                "name", F.when(F.col("level") == "SAFE", F.lit(0).cast("bigint")).otherwise(F.col("n")).alias("n")
            )))).alias("violations_by_zone"))
        out = risk.groupBy("feed_id").agg(*totals).join(by_zone, "feed_id", "left")
        if keys:
            out = out.join(zones.groupBy("feed_id").agg(F.count(F.lit(1)).alias("zones_defined")).hint("merge"), "feed_id", "left")
        else:
            out = out.withColumn("zones_defined", zones.agg(F.count(F.lit(1))).scalar())
        return out.withColumns({
            "violations_by_zone": F.coalesce("violations_by_zone", F.create_map().cast("map<string,bigint>")),
            "zones_defined": F.coalesce("zones_defined", F.lit(0)).cast("int"),
        })
    zones = zone_defaults(zones)
    per_zone = [
        x
        for z in zones
        for x in (
            F.lit(z["name"]),
            F.sum(F.col("zone_scores")[z["name"]]) if z["level"] != "SAFE" else F.lit(0).cast("bigint"),
        )
    ]
    return risk.groupBy("feed_id").agg(
        *totals, F.create_map(*per_zone).alias("violations_by_zone"), F.lit(len(zones)).alias("zones_defined"))


def zones_from_json(text_value: str) -> list[dict]:
    """Zone set from its JSON form ``{name: {polygon, level, label, color}}``."""
    return [{"name": k, **v} for k, v in json.loads(text_value).items()]
