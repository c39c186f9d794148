"""Published files by time: which of them can hold a window, and pages that open the newest files first.

Publication deals rows out by ranges of time, so that a file spans little of it, and writes each file's rows, undated ones, least and
largest time beside the manifest. Readers look at that table, of one row a file, before they open any file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.operators import explore
from emberlens.schema import LOGS

ZONES = "dataset_id string, signal string, run string, path string, file string, rows long, undated long, least long, largest long, hash_sum decimal(38,0), hash_xor long"
#: Rows of a file at most, and files that a page opens first.
SEGMENT_ROWS, FIRST_FILES = 4_000_000, 8


def clustered(rows: DataFrame, time: str) -> DataFrame:
    """``rows`` dealt out by ranges of time and sorted within them, the newest first. Ranges go by record id, too, so undated rows, or those of one
    time, are many files' like any others."""
    order = [F.desc_nulls_last(time), F.desc("record_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def row_hash(columns: list[str], time: str) -> Column:
    """A row's part of its dataset's revision."""
    return F.xxhash64("record_id", time, *[c for c in ("raw_hash", "display_message") if c in columns][:1])


def revision_of(n: str, total: str, xor: str) -> Column:
    """A dataset's revision by its rows, and the sum and xor of their hashes, which depend on neither order nor files."""
    return F.concat(F.lit("dsrev-"), F.substring(F.sha2(F.concat_ws("|", "dataset_id", n, total, xor), 256), 1, 32))


def measured(spark: SparkSession, data: str, schema, time: str) -> DataFrame:
    """``(file, rows, undated, least, largest, hash_sum, hash_xor)`` of the files in a folder, from their ids, times and hashes alone."""
    found = spark.read.schema(schema).parquet(data).select(F.col("_metadata.file_name").alias("file"), F.col(time).alias("time"), row_hash(schema.fieldNames(), time).alias("hash"))
    digest = (F.sum(F.col("hash").cast("decimal(19,0)")).cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("hash").alias("hash_xor"))
    return found.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.col("time").isNull()).alias("undated"), F.min("time").alias("least"), F.max("time").alias("largest"), *digest)


def write_zones(spark: SparkSession, warehouse: str, dataset_id: str, signal: str, run: str, data: str, schema, time: str) -> DataFrame:
    """Measures the files of a run, once, and keeps what it found."""
    at = f"{warehouse}/zones/{run}"
    named = measured(spark, data, schema, time).select(*[F.lit(v).alias(c) for c, v in (("dataset_id", dataset_id), ("signal", signal), ("run", run), ("path", data))], "file", "rows", "undated", "least", "largest", "hash_sum", "hash_xor")
    named.coalesce(1).write.mode("overwrite").parquet(at)
    return spark.read.schema(ZONES).parquet(at)


def zones(spark: SparkSession, runs: DataFrame, warehouse: str) -> DataFrame:
    """The zones of ``runs(run)``."""
    return spark.read.schema(ZONES).option("recursiveFileLookup", "true").parquet(f"{warehouse}/zones").join(runs.select("run").distinct(), "run", "left_semi")


def overlapping(found: DataFrame, window: explore.Window) -> DataFrame:
    """Those whose files can hold a dated row of the window."""
    return found.where((F.col("largest") >= window.start) & (F.col("least") < window.end)) if window.bounded else found


def read(spark: SparkSession, files: list, schema=LOGS) -> DataFrame:
    """The rows of zones' files."""
    return spark.read.schema(schema).parquet(*[f"{r['path']}/{r['file']}" for r in files]) if files else spark.createDataFrame([], schema)


def newest_page(spark: SparkSession, found: DataFrame, where: Column | None = None, window: explore.Window = explore.Window(), limit: int = 200) -> tuple[DataFrame, int]:
    """The page that ``explore.page`` gives without a cursor, and how many files it took: the newest are opened first, then four times as
    many, until no other file can hold a row of the page. Where a filter finds too few rows, that is all of them."""
    files = overlapping(found, window).orderBy(F.desc_nulls_last("largest"), "path", "file").collect()  # a row a file
    limit, n = max(1, min(explore.MOST_ROWS, limit)), FIRST_FILES
    while True:
        rows = explore.page(read(spark, files[:n]), where, window, limit).collect()
        left = files[n:]
        full = len(rows) > limit and rows[-1]["event_time"] is not None
        if not left or full and (left[0]["largest"] is None or rows[-1]["event_time"] > left[0]["largest"]):
            return spark.createDataFrame(rows, LOGS).coalesce(1), min(n, len(files))
        n *= 4
