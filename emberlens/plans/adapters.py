"""The driver's tables as canonical logs, metric points and spans, in Spark and, for oracles, as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts: Column) -> Column:
    """A timestamp without zone as UTC nanoseconds."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def tagged(kind: str, value: Column) -> Column:
    """One value of an attribute map: its type and its value."""
    return F.struct(F.lit(kind).alias("t"), value.alias("v"))


SEVERITIES = {"error": (17, "ERROR"), "signup": (13, "WARN"), "purchase": (9, "INFO"), "click": (5, "DEBUG"), "view": (None, "trace")}


def _by_type(pick: int) -> Column:
    out = F.lit(None)
    for kind, pair in SEVERITIES.items():
        out = F.when(F.col("event_type") == kind, F.lit(pair[pick])).otherwise(out)
    return out


def events_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    attempt = F.when((F.col("event_type") == "error") & (k % 3 == 0), k % 4 + 1)
    moved = F.when(F.col("event_id") % 53 == 0, F.lit(86_400_000_000_000)).otherwise(F.lit(0))
    http = F.struct(tagged("int", status).alias("status"))
    attributes = F.struct(
        tagged("int", k).alias("k"), tagged("int", cents).alias("cents"), tagged("str", F.col("event_type")).alias("service.name"), tagged("map", http).alias("http"),
        F.when(attempt.isNotNull(), tagged("int", attempt)).alias("attempt"),
    )
    message = F.when(F.col("event_type") == "view", F.concat(F.lit("view heartbeat user "), F.col("user_id"))).otherwise(
        F.concat("event_type", F.lit(" user "), "user_id", F.lit(" took "), cents, F.lit("ms"))
    )
    return e.select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("record_id"),
        F.lit("events").alias("dataset_id"),
        F.when(F.col("event_id") % 97 != 0, nanos(F.col("ts")) - moved).alias("event_time"),
        _by_type(0).cast("int").alias("severity_number"),
        _by_type(1).alias("severity_text"),
        message.alias("display_message"),
        F.col("event_type").alias("operation"),
        F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").alias("outcome"),
        F.col("event_type"),
        F.concat(F.lit("u-"), F.col("user_id")).alias("request_id"),
        F.lit(None).cast("string").alias("message_id"),
        F.concat(F.lit("res-"), F.col("user_id") % 8).alias("resource_id"),
        F.concat(F.lit("src-"), F.col("event_id") % 4).alias("source_id"),
        F.col("event_id").alias("record_number"),
        F.to_json(attributes).alias("attributes_json"),
    )


EVENTS_SQL = """
logs AS (
  SELECT *, CASE WHEN event_type = 'error' AND k % 3 = 0 THEN k % 4 + 1 END AS attempt,
    CASE WHEN event_type = 'view' THEN 'view heartbeat user ' || user_id ELSE event_type || ' user ' || user_id || ' took ' || cents || 'ms' END AS display_message
  FROM (
    SELECT 'ev-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS record_id, 'events' AS dataset_id, event_id AS record_number, event_type, event_type AS operation, user_id,
      CASE WHEN event_id % 97 <> 0 THEN epoch_ns(ts) - CASE WHEN event_id % 53 = 0 THEN 86400000000000 ELSE 0 END END AS event_time,
      CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'purchase' THEN 9 WHEN 'click' THEN 5 END AS severity_number,
      CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'trace' END AS severity_text,
      CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' END AS outcome,
      'u-' || user_id AS request_id, 'res-' || (user_id % 8) AS resource_id, 'src-' || (event_id % 4) AS source_id,
      CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status
    FROM events
  )
)"""


def documents_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("record_id"),
        F.lit("documents").alias("dataset_id"),
        F.lit(None).cast("long").alias("event_time"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("display_message"),
        F.col("text").alias("body"),
        F.col("lang").alias("resource_id"),
        F.col("source").alias("source_id"),
        F.col("doc_id").alias("record_number"),
    )


DOCUMENTS_SQL = """
logs AS (
  SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS record_id, split_part(text, chr(10), 1) AS display_message, text AS body,
    lang AS resource_id, source AS source_id FROM documents
)"""


def lineitem_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem")
    pad = lambda c, w: F.lpad(F.col(c).cast("string"), w, "0")
    return n.select(
        F.concat_ws("-", F.lit("li"), pad("l_orderkey", 10), F.col("l_linenumber"), pad("l_partkey", 9), pad("l_suppkey", 7), nanos(F.col("l_shipdate"))).alias("record_id"),
        F.lit("lineitem").alias("dataset_id"),
        nanos(F.col("l_shipdate")).alias("event_time"),
        F.col("l_returnflag").alias("operation"),
        F.when(F.col("l_linestatus") == "F", "failure").otherwise("success").alias("outcome"),
        F.col("l_orderkey").cast("string").alias("request_id"),
        F.concat(F.lit("supp-"), F.col("l_suppkey")).alias("resource_id"),
        F.concat(F.lit("line "), F.col("l_linenumber"), F.lit(" part "), F.col("l_partkey")).alias("display_message"),
        F.lit("lineitem").alias("source_id"),
        F.lit(None).cast("long").alias("record_number"),
        F.when(F.col("l_returnflag") == "R", 17).when(F.col("l_returnflag") == "A", 13).otherwise(9).alias("severity_number"),
    )


LINEITEM_SQL = """
logs AS (
  SELECT 'li-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || l_linenumber || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-'
      || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || '-' || epoch_ns(l_shipdate) AS record_id,
    'lineitem' AS dataset_id, epoch_ns(l_shipdate) AS event_time, l_returnflag AS operation,
    CASE WHEN l_linestatus = 'F' THEN 'failure' ELSE 'success' END AS outcome, CAST(l_orderkey AS VARCHAR) AS request_id,
    'supp-' || l_suppkey AS resource_id, 'line ' || l_linenumber || ' part ' || l_partkey AS display_message,
    CASE l_returnflag WHEN 'R' THEN 17 WHEN 'A' THEN 13 ELSE 9 END AS severity_number
  FROM lineitem
)"""


def events_as_metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(
        F.col("event_type").alias("metric_name"),
        F.when(F.col("event_id") % 2 == 0, "gauge").otherwise("sum").alias("metric_type"),
        F.when(F.col("event_id") % 2 != 0, F.when(F.col("user_id") % 2 == 0, "delta").otherwise("cumulative")).alias("temporality"),
        nanos(F.col("ts")).alias("time"),
        F.when(F.col("event_id") % 3 == 0, cents).alias("value_int"),
        F.when(F.col("event_id") % 3 != 0, cents.cast("double")).alias("value_double"),
    )


METRICS_SQL = """
points AS (
  SELECT event_type AS metric_name, CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'sum' END AS metric_type,
    CASE WHEN event_id % 2 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN 'delta' ELSE 'cumulative' END END AS temporality,
    epoch_ns(ts) AS time, CAST(round(value * 100) AS BIGINT) AS value FROM events
)"""


def lineitem_as_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem")
    pad = lambda c, w: F.lpad(c.cast("string"), w, "0")
    own = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    start = nanos(F.col("l_shipdate"))
    link = lambda trace, span: F.to_json(F.array(F.struct(pad(trace, 32).alias("trace_id"), pad(span, 16).alias("span_id"))))
    return n.select(
        F.concat_ws("-", F.lit("sp"), pad(F.col("l_orderkey"), 10), F.col("l_linenumber"), pad(F.col("l_partkey"), 9), pad(F.col("l_suppkey"), 7), start).alias("record_id"),
        pad(F.col("l_orderkey") + 1, 32).alias("trace_id"),
        pad(own, 16).alias("span_id"),
        F.when(F.col("l_linenumber") > 1, pad(own - 1, 16)).alias("parent_span_id"),
        F.col("l_returnflag").alias("name"),
        start.alias("start_time"),
        F.when(F.col("l_partkey") % 13 != 0, start + F.col("l_quantity").cast("long") * 1_000_000).alias("end_time"),
        F.when(F.col("l_suppkey") % 10 == 0, link(F.col("l_orderkey") + 2, own)).when(F.col("l_suppkey") % 10 == 1, link(F.col("l_orderkey") + 1, own - 1)).alias("links_json"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_suppkey") % 4).cast("long").alias("flags"),
    )


SPANS_SQL = """
spans AS (
  SELECT 'sp-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || l_linenumber || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-'
      || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || '-' || epoch_ns(l_shipdate) AS record_id,
    lpad(CAST(l_orderkey + 1 AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), 16, '0') AS span_id,
    CASE WHEN l_linenumber > 1 THEN lpad(CAST(l_orderkey * 8 + l_linenumber - 1 AS VARCHAR), 16, '0') END AS parent_span_id,
    epoch_ns(l_shipdate) AS start_time, CASE WHEN l_partkey % 13 <> 0 THEN epoch_ns(l_shipdate) + CAST(l_quantity AS BIGINT) * 1000000 END AS end_time,
    CASE l_suppkey % 10 WHEN 0 THEN lpad(CAST(l_orderkey + 2 AS VARCHAR), 32, '0') WHEN 1 THEN lpad(CAST(l_orderkey + 1 AS VARCHAR), 32, '0') END AS link_trace,
    CASE l_suppkey % 10 WHEN 0 THEN lpad(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), 16, '0') WHEN 1 THEN lpad(CAST(l_orderkey * 8 + l_linenumber - 1 AS VARCHAR), 16, '0') END AS link_span,
    CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey % 4 END AS flags
  FROM lineitem
)"""
