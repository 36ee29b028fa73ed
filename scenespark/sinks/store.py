"""A store of alerts by id: every write appends a version, and a manifest says which versions count.

A batch writes its own rows and one small manifest entry, whatever the store holds. Readers
take the newest row of each id from the folders that count. Compaction merges the small ones
into one, with as many files as its rows need; folders that no longer count go in ``vacuum``.
An entry is created only if no one else has taken its number, so writers exclude each other
and a reader sees a write wholly or not at all.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# rows of one file of a compacted folder; folders below so many bytes are merged, from so many of them on
FILE_ROWS, SMALL_BYTES, SMALL_FOLDERS = 1_000_000, 128 << 20, 8


def _fs(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def latest_by_id(alerts: DataFrame, version: str) -> DataFrame:
    """One row per alert id, the latest; versions combine before the shuffle."""
    cols = alerts.columns
    newest = F.max_by(F.struct(*cols), F.col(version)).alias("r")
    return alerts.groupBy("alert_id").agg(newest).select(*[F.col(f"r.{c}").alias(c) for c in cols])


def _entries(spark: SparkSession, path: str) -> list[dict]:
    """Manifest entries in order; one short line per write."""
    fs, at = _fs(spark, path)
    folder = at(f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    files = [f"{path}/manifest/{n}" for n in names if n.endswith(".json")]
    if not files:
        return []
    rows = spark.read.text(files, wholetext=True).select("value", F.col("_metadata.file_name").alias("n")).collect()
    return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["n"])]


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that count, oldest first."""
    live: list[str] = []
    for entry in _entries(spark, path):
        live = [f for f in live if f not in entry["removes"] and f not in entry["adds"]] + entry["adds"]
    return live


def _commit(spark: SparkSession, path: str, adds: list[str], removes: list[str]) -> None:
    fs, at = _fs(spark, path)
    fs.mkdirs(at(f"{path}/manifest"))
    body = json.dumps({"adds": adds, "removes": removes}).encode()
    number = len(fs.listStatus(at(f"{path}/manifest")))
    while True:
        # whole under a name of its own first; the rename fails if the number is taken
        draft, target = at(f"{path}/.draft-{uuid.uuid4().hex}"), at(f"{path}/manifest/{number:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(body))
        out.close()
        if not fs.exists(target) and fs.rename(draft, target):
            return
        fs.delete(draft, False)
        number += 1


def append(batch: DataFrame, path: str, version: str = "written_at", name: str | None = None) -> str:
    """Write the rows of a batch, the newest of each id, and return their folder.

    ``name`` makes a repeated batch replace its own folder, as in ``foreachBatch``.
    """
    spark = batch.sparkSession
    folder = f"v-{name or uuid.uuid4().hex}"
    latest_by_id(batch, version).write.mode("overwrite").partitionBy("priority").parquet(f"{path}/data/{folder}")
    # an empty batch leaves no folder of any priority, and nothing to read
    fs, at = _fs(spark, path)
    held = any(s.isDirectory() for s in fs.listStatus(at(f"{path}/data/{folder}")))
    _commit(spark, path, [folder] if held else [], [] if held else [folder])
    return folder


def _rows(spark: SparkSession, path: str, live: list[str]) -> DataFrame:
    parts = [spark.read.parquet(f"{path}/data/{f}") for f in live]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read(spark: SparkSession, path: str, version: str = "written_at") -> DataFrame:
    """The newest row of every id."""
    live = folders(spark, path)
    if not live:
        raise ValueError(f"nothing was ever written to {path}")
    return latest_by_id(_rows(spark, path, live), version)


def compact(
    spark: SparkSession, path: str, version: str = "written_at", small: int = SMALL_BYTES, least: int = SMALL_FOLDERS
) -> str | None:
    """Merge the small folders into one if there are enough of them; older rows of an id among them go."""
    fs, at = _fs(spark, path)
    live = folders(spark, path)
    few = [f for f in live if fs.getContentSummary(at(f"{path}/data/{f}")).getLength() < small]
    if len(few) < least:
        return None
    merged = latest_by_id(_rows(spark, path, few), version)
    folder = f"c-{uuid.uuid4().hex}"
    files = math.ceil(_rows(spark, path, few).count() / FILE_ROWS) or 1
    merged.repartition(files, "alert_id").write.partitionBy("priority").parquet(f"{path}/data/{folder}")
    _commit(spark, path, [folder], few)
    return folder


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that no longer count; no reader may still hold them."""
    fs, at = _fs(spark, path)
    live, gone = set(folders(spark, path)), 0
    for status in fs.listStatus(at(f"{path}/data")):
        if status.getPath().getName() not in live:
            gone += int(fs.delete(status.getPath(), True))
    return gone
