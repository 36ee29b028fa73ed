"""Order-dependent work that never puts a whole feed or category in one task.

A window over ``partitionBy(feed)`` sends every row of a feed to one task, so one
busy feed decides the run time. Here the exact position of a row comes from two
levels (rank inside a small bucket + rows in earlier buckets), and ROWS windows
run on fixed blocks of positions, each with a halo of the preceding rows. Both
give the same values as the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenespark.operators.checkpoints import cut

FRAME_BUCKET = 4096
BLOCK_ROWS = 16384


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Exact 1-based position of each row within ``group`` by ``order``.

    ``bucket`` must be non-decreasing along ``order`` and hold few rows each.
    Buckets are counted with map-side combine; only the counts (one row per
    bucket) are ordered per group. ``total`` also adds the size of the group,
    which the bucket counts know already.
    """
    group = list(group)
    tagged = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    if total:
        offsets = offsets.withColumn(total, F.sum("_rows").over(Window.partitionBy(*group)))
    offsets = offsets.drop("_rows")
    local = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        tagged.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*group, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_bucket", "_local", "_before")
    )


def frame_bucket(frame: str = "frame_id", rows: int = FRAME_BUCKET) -> Column:
    """Bucket for rows that are unique per frame and ordered by it."""
    return F.floor(F.col(frame) / rows)


def hash_key(key: Column | str, seed: int) -> Column:
    """Deterministic shuffle order: the same on any engine and any run."""
    return F.md5(F.concat(F.col(key) if isinstance(key, str) else key, F.lit(f":{seed}")))


def with_hash_position(
    df: DataFrame, group: Sequence[str], key: str, seed: int, name: str = "pos", total: str | None = None
) -> DataFrame:
    """Position in hash order. The hash prefix is an even bucket by construction."""
    keyed = df.withColumn("_hash", hash_key(key, seed))
    return with_position(
        keyed, group, ["_hash", key], F.substring("_hash", 1, 3), name, total
    ).drop("_hash")


def with_sorted_position(
    df: DataFrame, group: Sequence[str], key: str, name: str = "pos", ranges: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Position by an arbitrary sort key (for example a name).

    Rows are dealt out by ranges of ``(group, key)``, so a large group spans many ranges and
    small ones share one. Spark samples the bounds; the rows are stored with the number of
    their range, so every later pass and every rerun of a lost task sees the same ranges.
    """
    group = list(group)
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = cut(df.repartitionByRange(n, *group, key).withColumn("_range", F.spark_partition_id()))
    return with_position(tagged, group, [key], F.col("_range"), name, total).drop("_range")


def with_blocks(
    df: DataFrame, pos: str, halo: int, rows: int = BLOCK_ROWS, ahead: int = 0
) -> DataFrame:
    """Copy the last ``halo`` rows of each block into the next one.

    Adds ``_block`` (window partition key beside the group) and ``_own`` (false
    on copies; drop those rows after the window). ``ahead`` copies that many
    leading rows into the block before, for windows that look forward.
    """
    if halo + ahead > rows:
        raise ValueError("halo must not exceed the block size")
    block = F.floor((F.col(pos) - 1) / rows)
    offset = (F.col(pos) - 1) % rows
    spread = F.array_compact(F.array(
        F.when((offset < ahead) & (block > 0), block - 1) if ahead else F.lit(None).cast("bigint"),
        block,
        F.when(offset >= rows - halo, block + 1),
    ))
    return (
        df.withColumn("_home", block)
        .withColumn("_block", F.explode(spread))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )


def block_window(group: Sequence[str], pos: str) -> Window:
    return Window.partitionBy(*group, "_block").orderBy(pos)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_block")


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows per group. Spark trims each task before the shuffle while ``n`` is small;
    for long heads of busy groups ``with_position`` spreads the work better."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by ``keys`` that adaptive execution does not merge.

    Merging goes by bytes; groups that are small but costly in Python would end up
    in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
