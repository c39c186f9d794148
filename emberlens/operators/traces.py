"""Trace graphs of all traces at once: nodes with annotations, parent and link edges, integrity.

Joins are by (trace, span), not by trace, since one trace may hold a large part of all
spans; what joins the spans are narrow tables that are summed up before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAGS = ("duplicate_span_id", "missing_end", "clock_skew_before_parent", "orphan_parent", "root")


def parents(spans: DataFrame) -> DataFrame:
    """A row a span id of a trace: the latest start among its spans, and how many there are."""
    return spans.groupBy("trace_id", "span_id").agg(F.max("start_time").alias("parent_start"), F.count("*").alias("copies"))


def nodes(spans: DataFrame) -> DataFrame:
    """Spans with the annotations of ``FLAGS`` and ``sampled``, bit 0 of their flags (null without flags).
    Of a parent id that several spans have, the latest start counts."""
    ids = parents(spans)
    twice = ids.where("copies > 1").select("trace_id", "span_id", F.lit(True).alias("twice"))
    above = ids.select("trace_id", F.col("span_id").alias("parent_span_id"), "parent_start", F.lit(True).alias("there"))
    joined = spans.join(above, ["trace_id", "parent_span_id"], "left").join(twice, ["trace_id", "span_id"], "left")
    has_parent = F.col("parent_span_id").isNotNull()
    bits = F.col("flags") if "flags" in spans.columns else F.lit(None).cast("long")
    return joined.select(
        *spans.columns,
        F.col("twice").isNotNull().alias("duplicate_span_id"),
        F.col("end_time").isNull().alias("missing_end"),
        F.coalesce(F.col("start_time") < F.col("parent_start"), F.lit(False)).alias("clock_skew_before_parent"),
        (has_parent & F.col("there").isNull()).alias("orphan_parent"),
        (~has_parent).alias("root"),
        (bits.bitwiseAND(F.lit(1)) == 1).alias("sampled"),
    )


def parent_edges(spans: DataFrame) -> DataFrame:
    """``(trace_id, parent_span_id, span_id)``, a row each span whose parent is in its trace."""
    there = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return spans.where("parent_span_id is not null").select("trace_id", "parent_span_id", "span_id").join(there, ["trace_id", "parent_span_id"], "left_semi")


def unresolved(spans: DataFrame) -> DataFrame:
    """``(trace_id, parent_span_id, span_id)``, a row each span whose parent isn't in its trace, in this order."""
    there = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    rows = spans.where("parent_span_id is not null").select("trace_id", "parent_span_id", "span_id").join(there, ["trace_id", "parent_span_id"], "left_anti")
    return rows.orderBy("trace_id", "parent_span_id", "span_id")


def link_edges(spans: DataFrame) -> DataFrame:
    """``(trace_id, span_id, linked_trace_id, linked_span_id, resolved_in_trace)``: a link is resolved if
    it stays in its trace and that has the span; links may leave the trace."""
    links = F.explode(F.from_json("links_json", "array<struct<trace_id:string,span_id:string>>"))
    rows = spans.select("trace_id", "span_id", links.alias("l")).select("trace_id", "span_id", F.col("l.trace_id").alias("linked_trace_id"), F.col("l.span_id").alias("linked_span_id"))
    there = spans.select(F.col("trace_id").alias("linked_trace_id"), F.col("span_id").alias("linked_span_id")).distinct().withColumn("there", F.lit(True))
    own = F.col("there").isNotNull() & (F.col("trace_id") == F.col("linked_trace_id"))
    return rows.join(there, ["linked_trace_id", "linked_span_id"], "left").select("trace_id", "span_id", "linked_trace_id", "linked_span_id", F.coalesce(own, F.lit(False)).alias("resolved_in_trace"))


def integrity(spans: DataFrame) -> DataFrame:
    """Counts of each annotation for each trace, and ``missing_root`` where no span is a root."""
    counted = nodes(spans).groupBy("trace_id").agg(F.count("*").alias("spans"), *[F.count_if(f).alias(f) for f in FLAGS])
    return counted.withColumn("missing_root", F.col("root") == 0)


def trace(spans: DataFrame, trace_id: str, most: int | None = None) -> DataFrame:
    """One trace's nodes by start, and ``truncated``: whether there are more than ``most``, if given."""
    rows = nodes(spans.where(F.col("trace_id") == trace_id)).orderBy("start_time", "span_id", "record_id")
    if most is None:
        return rows.withColumn("truncated", F.lit(False))
    n = spans.where(F.col("trace_id") == trace_id).agg((F.count("*") > most).alias("truncated"))
    return rows.limit(most).crossJoin(F.broadcast(n))  # one row
