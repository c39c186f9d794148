"""Metric rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(points: DataFrame, name: str, width: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """``(bucket, metric_type, points, total, least, largest, mean)`` of gauges and sums of deltas."""
    if width <= 0:
        raise ValueError("a bucket has a positive width")
    t = F.col("time")
    rows = points.where((F.col("metric_name") == name) & ((F.col("metric_type") == "gauge") | ((F.col("metric_type") == "sum") & (F.col("temporality") == "delta"))))
    rows = rows if start is None else rows.where(t >= start)
    rows = rows if end is None else rows.where(t < end)
    v = F.coalesce("value_double", F.col("value_int").cast("double"))
    return rows.groupBy((t - F.pmod(t, F.lit(width))).alias("bucket"), "metric_type").agg(
        F.count(v).alias("points"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("largest"), F.avg(v).alias("mean")
    )
