"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.plans.shared import remove, shared_dir

__all__ = ["materialise", "remove", "shared_dir", "small", "table", "whole_text"]
#: Rows of a table of numbers that is broadcast: some 16 MB of longs.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what is computed once
    is not computed again, and lost executors take nothing with them."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text_col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def small(numbers: DataFrame) -> DataFrame:
    """A written table of one number a row, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows; else as it
    is, for a join by a shuffle."""
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers
