"""Continuous ingestion: a folder that files are dropped into, read by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlens.sources.files import placed_lines
from emberlens.sources.ingest import normalised, publish_records, stable_run
from emberlens.sources.profiles import JSONL, Profile

_FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """``(path)`` of new files, some a micro-batch; their contents aren't read."""
    return spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_a_batch).load(folder).select("path")


def import_batch(spark: SparkSession, paths: list[str], folder: str, warehouse: str, dataset_id: str, profile: Profile, number: int) -> dict:
    """Publishes a batch's files as an import would, places of records and all. The run's id depends on stream and batch
    alone, so a batch that is tried again replaces its rows and its manifest row."""
    run = stable_run("stream", warehouse, dataset_id, folder, number)
    return publish_records(normalised(placed_lines(spark, paths), profile, dataset_id, folder), warehouse, dataset_id, run, f"batch={number}")


def start(spark: SparkSession, folder: str, warehouse: str, dataset_id: str, profile: Profile = JSONL, once: bool = False) -> StreamingQuery:
    """Publishes the files that are dropped into ``folder``. A record's id depends on its content and place, and a file
    is read once, so batches have no rows in common."""

    def write(batch: DataFrame, number: int) -> None:
        if paths := [r["path"] for r in batch.collect()]:  # at most files_a_batch
            import_batch(spark, paths, folder, warehouse, dataset_id, profile, number)

    writer = new_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", f"{warehouse}/_stream/{dataset_id}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def deduplicated_stream(logs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of canonical logs without the record ids seen within ``delay``; its state is bounded by the watermark."""
    timed = logs.withColumn("at", F.timestamp_micros(F.expr("event_time div 1000")))
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["record_id"]).drop("at")


def counts_by_window(logs: DataFrame, width: str = "1 minute", delay: str = "10 minutes", by: str = "severity_text", *sums: Column) -> DataFrame:
    """Rows by window and ``by``, and ``sums``; in the modes that ``to_table`` and ``closed_to_table`` use, state is dropped once the
    watermark has passed a window. Later rows of it are dropped and counted in the query's progress (``numRowsDroppedByWatermark``)."""
    timed = logs.withColumn("at", F.timestamp_micros(F.expr("event_time div 1000")))
    return timed.withWatermark("at", delay).groupBy(F.window("at", width), by).agg(F.count("*").alias("n"), *sums)


def _to_batches(counts: DataFrame, path: str, checkpoint: str, mode: str, once: bool) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counts.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_table(counts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Adds the windows that a batch changed to ``path``, in a folder of the batch's own; a batch that is tried again replaces its folder.
    Nothing that readers see is emptied, and state holds open windows only. ``latest`` reads the counts as they stand."""
    return _to_batches(counts, path, checkpoint, "update", once)


def closed_to_table(counts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Adds each window once, when the watermark has passed it."""
    return _to_batches(counts, path, checkpoint, "append", once)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of ``to_table``'s rows the last of each key."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")
