"""SQL names for the two geometry functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

IOU = """
CREATE OR REPLACE TEMPORARY FUNCTION iou(
  ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE)
RETURNS DOUBLE
RETURN coalesce(
  greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1))
  / nullif(
      greatest(0D, ax2 - ax1) * greatest(0D, ay2 - ay1) + greatest(0D, bx2 - bx1) * greatest(0D, by2 - by1)
      - greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)),
      0D),
  0D)
"""

POINT_IN_POLYGON = """
CREATE OR REPLACE TEMPORARY FUNCTION point_in_polygon(
  px DOUBLE, py DOUBLE, polygon ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>)
RETURNS BOOLEAN
RETURN size(filter(polygon, (a, i) ->
  (a.y > py) <> (polygon[pmod(i - 1, size(polygon))].y > py)
  AND px < (polygon[pmod(i - 1, size(polygon))].x - a.x) * (py - a.y)
           / (polygon[pmod(i - 1, size(polygon))].y - a.y + 1e-12D) + a.x
)) % 2 = 1
"""


def register(spark: SparkSession) -> None:
    """Create both functions in the session."""
    spark.sql(IOU)
    spark.sql(POINT_IN_POLYGON)
