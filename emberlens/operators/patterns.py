"""Message patterns: how often each template occurs, when and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlens.functions.templates import SWITCHES, pattern_id, template

BUCKET = 60 * 1_000_000_000


def with_template(logs: DataFrame, text: Column | None = None, masks: tuple[str, ...] = SWITCHES, bounded: bool = True) -> DataFrame:
    """Rows with ``template``, of the whole text if not ``bounded``; those without a text are left out, as callers count."""
    message = F.col("display_message") if text is None else text
    return logs.where(message.isNotNull()).withColumn("template", template(message, masks, bounded))


def cells(rows: DataFrame, width: int = BUCKET) -> DataFrame:
    """Counts and ends by template, bucket (null for undated rows) and resource: what all
    the other results are sums of, so that templates are made and shuffled once."""
    t = F.col("event_time")
    at = F.when(t.isNotNull(), F.struct(t.alias("t"), F.col("record_id").alias("r")))
    return rows.groupBy("template", (t - F.pmod(t, F.lit(width))).alias("bucket"), "resource_id").agg(
        F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.min("record_id").alias("example")
    )


def buckets(rows: DataFrame, width: int = BUCKET, most: int | None = None) -> DataFrame:
    """``(template, bucket, n)`` of dated rows: all buckets, or the newest ``most`` of a template."""
    return _buckets(cells(rows, width), most)


def _buckets(of: DataFrame, most: int | None = None) -> DataFrame:
    return _capped(of.where("bucket is not null").groupBy("template", "bucket").agg(F.sum("n").alias("n")), F.desc("bucket"), most)


def resources(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``(template, resource_id, n)`` of dated rows: all, or the ``most`` of a template that were seen last."""
    return _resources(cells(rows), most)


def _resources(of: DataFrame, most: int | None = None) -> DataFrame:
    n = of.where("bucket is not null").groupBy("template", "resource_id").agg(F.sum("n").alias("n"), F.max("last.t").alias("last"))
    return _capped(n, F.struct(F.col("last").alias("l"), F.col("resource_id").alias("r")).desc(), most).drop("last")


def _capped(n: DataFrame, order: Column, most: int | None) -> DataFrame:
    if most is None:
        return n
    rank = F.row_number().over(W.partitionBy("template").orderBy(order))
    return n.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def fold(rows: DataFrame, width: int = BUCKET, masks: tuple[str, ...] = SWITCHES) -> DataFrame:
    """A row a template: counts, undated rows, first and last row (ties by record id), and
    the bucket with most rows, the earliest of equals. Counts are made before rows are
    shuffled, so a template that most messages have weighs no more than any other."""
    base = cells(rows, width)
    main = base.groupBy("template").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0)).alias("undated"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.min("example").alias("example"),
    )
    peak = _buckets(base).groupBy("template").agg(F.max(F.struct(F.col("n"), (-F.col("bucket")).alias("b"))).alias("peak"), F.count("*").alias("buckets"))
    of = _resources(base).groupBy("template").agg(F.count("*").alias("resources"))
    return (
        main.join(peak, "template", "left")
        .join(of, "template", "left")
        .select(
            pattern_id(F.col("template"), masks).alias("pattern_id"), "template", "n", "undated", F.col("first.t").alias("earliest"), F.col("first.r").alias("earliest_record"),
            F.col("last.t").alias("latest"), F.col("last.r").alias("latest_record"), (-F.col("peak.b")).alias("peak_bucket"), F.col("peak.n").alias("peak_n"),
            F.coalesce("buckets", F.lit(0)).alias("buckets"), F.coalesce("resources", F.lit(0)).alias("resources"), "example",
        )
    )


def run(rows: DataFrame, most: int | None = None, width: int = BUCKET) -> DataFrame:
    """All patterns in their order, commonest first. Of more than ``most``, if given, those of the
    newest rows stay, undated ones by record id after the dated; ``cut`` is the number of the others."""
    folded = fold(rows, width)
    if most is None:
        return folded.orderBy(F.desc("n"), "pattern_id")
    newest = folded.orderBy(F.desc_nulls_last("latest"), F.desc("latest_record"), F.desc("example"), "pattern_id").limit(most)
    cut = rows.select("template").distinct().agg(F.greatest(F.count("*") - most, F.lit(0)).alias("cut"))
    return newest.crossJoin(F.broadcast(cut)).orderBy(F.desc("n"), "pattern_id")


def drill(logs: DataFrame, pattern: str, masks: tuple[str, ...] = SWITCHES, most: int | None = None, stale: bool = False) -> DataFrame:
    """The rows of one pattern, the newest first, all of them unless ``most`` are asked for; refused where the run that named the pattern is stale."""
    if stale:
        raise ValueError("the run is of other rows than there are now")
    rows = with_template(logs, masks=masks).where(pattern_id(F.col("template"), masks) == pattern)
    ordered = rows.orderBy(F.desc_nulls_last("event_time"), F.desc("record_id"))
    return ordered if most is None else ordered.limit(most)
