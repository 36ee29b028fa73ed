"""What the operators of this subpackage share: tables, stages in the shared folder, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.shipping import ship

# an Arrow batch ends at either; texts may be long, so a Python worker never holds many of them
BATCH_ROWS, BATCH_BYTES = "8192", "8388608"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the session ready for Python stages."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only local sessions get one of their own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="scenespark-")
        sc.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    """Delete what an application staged, if its session still runs when Python ends."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has gone before; its folder is the cluster's to clean
        pass


_roots: dict[str, str] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor never makes Spark repeat what came before.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_folder(spark).rstrip('/')}/stages-{app}"
        atexit.register(_remove, spark, _roots[app])
    path = f"{_roots[app]}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# bits of a filter that one group sets: 8 KB
FILTER_BLOCK = 16


def bit_filter(places: DataFrame, bits: int) -> np.ndarray:
    """A packed bit per place, set at the ``place`` values (0 to 2 ** bits - 1) of the only column.

    Blocks are set in the cluster and come to the driver as bytes, 2 ** bits / 8 of them at
    most, whatever the number of rows.
    """
    size = 1 << FILTER_BLOCK

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(size, bool)
        held[rows["place"].to_numpy() % size] = True
        return pd.DataFrame({"block": [int(key[0])], "held": [np.packbits(held).tobytes()]})

    packed = places.distinct().groupBy((F.expr(f"place div {size}")).alias("block")).applyInPandas(
        block, "block long, held binary")
    out = np.zeros(max(size, 1 << bits) // 8, np.uint8)
    for row in packed.collect():
        begin = row["block"] * size // 8
        out[begin:begin + size // 8] = np.frombuffer(row["held"], np.uint8)
    return out


def in_filter(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bits at the places are set."""
    return (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add result columns; a column of the input with the same name (in any case) gives way."""
    names = {c.lower() for c in columns}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def tmp(df: DataFrame, base: str) -> str:
    """A column name that the input does not use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) pairs: (id, root), root the smallest id of the component.

    Alternates large-star and small-star until no edge changes. Each round is two grouped
    passes over the edges, written to the shared folder; a star's centre is aggregated
    before the shuffle, so a vertex with many neighbours is no hot task's list.
    """
    edges = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a vertex moves to the smallest one
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        # small star: a vertex and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges_next = staged(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges_next.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = edges_next
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").unionAll(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
