"""The objects of large JSON arrays, read by many tasks.

A document that is one array has no line to split at. Here it is read as text that ends at
every closing brace, which a file splits at anywhere. Whether such a brace ends an object, an
inner object or stands in a string follows from what lies before: the parity of quotes and the
depth of braces. Both are sums, so each split counts its own, the splits of a file are added
up (a row per split), and every piece knows its place without any task reading the file from
its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block"]
# what stands before an opening brace outside of strings, and the rest of a string that began before
BEFORE_OPEN = r'(?s)^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
REST_OF_STRING = r'(?s)^(?:[^"\\]++|\\.)*+"'


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier pieces of the file."""
    rows = rows.withColumn("_v", value)
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*SPLIT).agg(F.sum("_v").alias("_sum")).withColumn(
        "_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    own = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_own", F.coalesce(F.sum("_v").over(own), F.lit(0))).join(sums, SPLIT).withColumn(
        name, F.col("_ahead") + F.col("_own")).drop("_v", "_own", "_ahead")


def read_objects(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """``file, value``: the text of every object at a depth of braces.

    ``level`` 1 are the objects of an array, 2 those of a list inside one object. The file
    must be valid JSON; what follows the last whole object is left out.
    """
    text = spark.read.option("lineSep", "}").text(path)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    found = _before(pieces.withColumn("_quotes", quotes), F.col("_quotes"), "_quotes_before")
    inside = F.col("_quotes_before") % 2 == 1
    rest = F.when(inside & (F.col("_quotes") == 0), "").when(inside, F.regexp_replace(bare, '^[^"]*"', "")).otherwise(bare)
    outside = F.regexp_replace(F.regexp_replace(rest, '"[^"]*"', ""), '"[^"]*$', "")
    found = found.withColumns({
        "_inside": inside, "_closes": ((F.col("_quotes_before") + F.col("_quotes")) % 2 == 0).cast("int"),
        "_opens": F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit(""))),
    })
    found = _before(found, F.col("_opens") - F.col("_closes"), "_depth")
    reached = F.col("_depth") + F.col("_opens")
    found = _before(found, ((reached == level) & (F.col("_closes") == 1)).cast("int"), "_number")
    start = F.when(F.col("_inside"), F.regexp_replace("value", REST_OF_STRING, "")).otherwise(F.col("value"))
    for k in range(level - 1):  # the braces around the object, if they open in this piece
        skipped = F.regexp_replace(start, BEFORE_OPEN + r"\{", "")
        start = F.when(F.col("_depth") <= k, skipped).otherwise(start)
    start = F.regexp_replace(start, BEFORE_OPEN + r"(?=\{)", "")
    part = F.when(F.col("_depth") >= level, F.col("value")).when(reached >= level, start)
    return (
        found.select("file", "block", "at", "_number", F.concat(part, F.lit("}")).alias("part")).filter("part IS NOT NULL")
        .groupBy("file", "_number").agg(F.array_sort(F.collect_list(F.struct("block", "at", "part"))).alias("parts"))
        .select("file", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("value"))
    )


def write_arrays(objects: DataFrame, path: str) -> None:
    """JSON texts (``value``) as files of one array each, one per partition; an empty one is an empty array."""
    def bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            lines = ["[" + v if first and not i else "," + v for i, v in enumerate(batch["value"])]
            first = first and not lines
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    objects.select("value").mapInPandas(bracketed, "value string").write.mode("overwrite").text(path)
