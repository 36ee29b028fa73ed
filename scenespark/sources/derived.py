"""Detections, frames, images and labels derived from the star-schema tables.

All rules are arithmetic on the given tables, so any SQL engine can derive the
same rows. Row counts grow with the inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES_PER_FEED = 240
FRAME_SECONDS = 10800
EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
# eight frames of twenty are quiet: their events are placed in the busy frames before (or after) them
BUSY_FRAME = """CASE WHEN frame_id % 20 >= 8 OR (feed_id % 3 <> 0 AND event_id % 5 = 0) THEN frame_id
                     WHEN frame_id > 8 THEN frame_id - 8 ELSE frame_id + 8 END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    seconds = F.expr(f"unix_micros(cast(ts as timestamp)) - unix_micros(cast({EPOCH} as timestamp))")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.expr("user_id div 15").alias("feed_id"),
            (F.col("user_id") % 15).alias("u"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            (F.floor(seconds / 1000000 / FRAME_SECONDS) + 1).alias("frame_id"),
            "event_id",
            "value",
        )
        .withColumn("frame_id", F.expr(BUSY_FRAME))
    )


def frame_ts(frame_id: str = "frame_id"):
    """Start of the frame's three-hour bucket."""
    return F.expr(
        f"cast({EPOCH} + make_dt_interval(0, cast(({frame_id} - 1) * 3 as int), 0, 0) as timestamp)"
    )


ZONES_PER_SUPPLIER = 20


def zone_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zone table with a set per feed: rectangles and triangles of widths from 0.01 to 0.32, which overlap."""
    feeds = _events(spark, sf_dir).agg(F.countDistinct("feed_id")).scalar()
    corner = "struct(cast({} as double) as x, cast({} as double) as y)".format
    return (
        table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.expr(f"sequence(0, {ZONES_PER_SUPPLIER - 1})")).alias("i"))
        .withColumns({
            "feed_id": F.col("s_suppkey") % feeds,
            "zone_order": F.col("s_suppkey") * ZONES_PER_SUPPLIER + F.col("i"),
            "w": F.expr("0.01D * power(2D, (s_suppkey * 7 + i * 3) % 6)"),
            "x": F.expr("((s_suppkey * 37 + i * 101) % 1000) / 1000D"),
            "y": F.expr("((s_suppkey * 53 + i * 29) % 1000) / 1000D"),
        })
        .withColumn("h", F.expr("w * (1 + i % 3) / 2D"))
        .select(
            "feed_id", "zone_order", F.expr("concat('z', zone_order)").alias("name"),
            F.expr("element_at(array('RESTRICTED', 'BUFFER', 'OBSERVATION', 'SAFE'), cast((s_suppkey + i) % 4 as int) + 1)").alias("level"),
            F.expr(f"""CASE WHEN i % 2 = 0
                THEN array({corner("x", "y")}, {corner("x + w", "y")}, {corner("x + w", "y + h")}, {corner("x", "y + h")})
                ELSE array({corner("x", "y")}, {corner("x + w", "y")}, {corner("x + w / 2D", "y + h")}) END""").alias("polygon"))
    )


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detection as a detector hands it over: class id and pixel box."""
    center_y = F.expr(
        """CASE u % 3
             WHEN 0 THEN 0.98D - 0.95D * (frame_id % 60) / 60
             WHEN 1 THEN 0.15D + (u / 15D) * 0.6D
             ELSE 0.05D + 0.9D * ((event_id * 37) % 101) / 101
           END"""
    )
    class_id = F.expr(
        """CASE WHEN u < 5 THEN 0
                WHEN u < 9 THEN 1
                WHEN u = 9 THEN 2
                WHEN u IN (10, 11) THEN CASE WHEN event_id % 20 = 0 THEN 3 ELSE 1 END
                WHEN u = 12 THEN 4
                WHEN u = 13 THEN 5
                ELSE CASE WHEN event_id % 20 = 1 THEN 6 ELSE 5 END END"""
    )
    return (
        _events(spark, sf_dir)
        .withColumn("cx", F.expr("(u + 0.5D) / 15D + (k - 50) * 0.0002D"))
        .withColumn("cy", center_y)
        .select(
            "feed_id",
            "frame_id",
            frame_ts().alias("ts"),
            F.col("event_id").alias("det_id"),
            class_id.cast("int").alias("class_id"),
            F.expr("0.30D + (event_id % 65) / 100D").alias("confidence"),
            F.expr("cx * 640D - 18D").alias("x1"),
            F.expr("cy * 640D - 80D").alias("y1"),
            F.expr("cx * 640D + 18D").alias("x2"),
            F.expr("cy * 640D + 80D").alias("y2"),
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All processed frames of all feeds, empty ones included; a feed goes on to its last event.

    Motion is built from whole cents so that the sum does not depend on the
    order in which rows arrive.
    """
    events = _events(spark, sf_dir)
    feeds = events.groupBy("feed_id").agg(F.greatest(F.lit(FRAMES_PER_FEED).cast("bigint"), F.max("frame_id")).alias("_last"))
    grid = feeds.select("feed_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_last"))).alias("frame_id"))
    motion = (
        events
        .groupBy("feed_id", "frame_id")
        .agg(
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
            F.count(F.lit(1)).alias("n"),
        )
        # mean value / 6 with four decimals, rounded in whole numbers
        .select("feed_id", "frame_id", F.expr("cast((100 * cents + 3 * n) div (6 * n) as double) / 10000").alias("motion_score"))
    )
    return grid.join(motion, ["feed_id", "frame_id"], "left").select(
        "feed_id",
        "frame_id",
        frame_ts().alias("ts"),
        "motion_score",
        F.expr("cast(80 + frame_id % 70 as double)").alias("inference_ms"),
    )


def images(spark: SparkSession, sf_dir: str, renamed: bool = False, more: dict[str, str] | None = None) -> DataFrame:
    """One image per order; ``renamed`` gives every fiftieth a name no label has; ``more`` adds expressions over the order."""
    prefix = "CASE WHEN o_orderkey % 50 = 0 THEN 'bare_' ELSE 'img_' END" if renamed else "'img_'"
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.expr(f"concat({prefix}, o_orderkey)").alias("stem"),
            F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'xview' WHEN 1 THEN 'visdrone' ELSE 'dota' END").alias("source"),
            F.expr("cast(320 + (o_orderkey * 131) % 2400 as int)").alias("img_w"),
            F.expr("cast(240 + (o_orderkey * 77) % 1800 as int)").alias("img_h"),
            *[F.expr(x).alias(name) for name, x in (more or {}).items()],
        )
    )


ANNOTATION_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def annotations(spark: SparkSession, sf_dir: str, renamed: bool = False, more: dict[str, str] | None = None) -> DataFrame:
    """Labels before the image size is known: class and box as shares.

    ``ann_id`` numbers the lines of one order, a handful of rows; ``renamed`` gives the
    labels of every fortieth order a name no image has; ``more`` names expressions over the
    line to be added.
    """
    from pyspark.sql import Window

    prefix = "CASE WHEN l_orderkey % 40 = 1 THEN 'lost_' ELSE 'img_' END" if renamed else "'img_'"

    w = Window.partitionBy("l_orderkey").orderBy(*ANNOTATION_ORDER)
    class_id = F.expr(
        """CASE WHEN l_partkey % 200 = 0 THEN 3
                WHEN l_partkey % 100 < 2 THEN 6
                WHEN l_partkey % 50 = 3 THEN 4
                WHEN l_partkey % 50 = 4 THEN 5
                WHEN l_partkey % 25 = 5 THEN 2
                WHEN l_partkey % 12 = 6 THEN 0
                ELSE 1 END"""
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.expr(f"concat({prefix}, l_orderkey)").alias("stem"),
            F.row_number().over(w).alias("ann_id"),
            F.col("l_linenumber").alias("line_no"),
            class_id.cast("int").alias("class_id"),
            F.expr("0.002D + l_quantity / 250D").alias("bw"),
            F.expr("0.002D + (l_partkey % 40) / 200D").alias("bh"),
            F.expr("((l_partkey * 7) % 1000) / 1000D").alias("fx"),
            F.expr("((l_suppkey * 13 + l_linenumber * 101) % 1000) / 1000D").alias("fy"),
            *[F.expr(x).alias(name) for name, x in (more or {}).items()],
        )
    )


def pixel_annotations(spark: SparkSession, sf_dir: str, more: dict[str, str] | None = None) -> DataFrame:
    """Labels joined with their image: pixel corner box, source and raw class code; ``more`` as in ``annotations``.

    They meet on the order's number, by which the lines are dealt out already when they are
    numbered; so lines are shuffled once and before they have names.
    """
    code = {
        # source: one raw code per class 0..6 (null where the source has none)
        "xview": ["77", "18", "79", "17", "11", "32", "83"],
        "visdrone": ["1", "4", None, None, None, None, None],
        "dota": [None, "small-vehicle", None, None, "plane", "ship", "storage-tank"],
    }
    raw = None
    for source, codes in code.items():
        by_class = F.get(F.array(*[F.lit(c) for c in codes]), F.col("class_id"))
        # line 7 carries a code no map knows
        unknown = F.lit({"xview": "0", "visdrone": "11", "dota": "bridge"}[source])
        value = F.when(F.col("line_no") == 7, unknown).otherwise(F.coalesce(by_class, unknown))
        raw = F.when(F.col("source") == source, value) if raw is None else raw.when(F.col("source") == source, value)
    return (
        annotations(spark, sf_dir, more={"_order": "l_orderkey", **(more or {})}).drop("stem")
        .join(images(spark, sf_dir, more={"_order": "o_orderkey"}), "_order")
        .withColumn("box_w", F.expr("img_w * bw"))
        .withColumn("box_h", F.expr("img_h * bh"))
        .withColumn("xmin", F.expr("(img_w - box_w) * fx"))
        .withColumn("ymin", F.expr("(img_h - box_h) * fy"))
        .select(
            "stem", "source", "img_w", "img_h", "ann_id", "line_no", "class_id",
            raw.alias("raw_code"),
            "xmin", "ymin",
            F.expr("xmin + box_w").alias("xmax"),
            F.expr("ymin + box_h").alias("ymax"),
            *(more or {}),
        )
    )
