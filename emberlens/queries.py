"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.case import evidence, redaction, report
from emberlens.functions import predicates as P
from emberlens.operators import catalog, compare, correlate, explore, findings, metrics, patterns, stacks, tokenindex, traces
from emberlens.plans import adapters as A
from emberlens.plans.shared import shared_dir
from emberlens.sources import files, ingest, otlp, profiles
from emberlens.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Nanoseconds of 2024-01-08, 2024-01-15 and 2024-01-22.
DAY = 86_400_000_000_000
W1, W2, W3 = 1_704_672_000_000_000_000, 1_705_276_800_000_000_000, 1_705_881_600_000_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _events(sql: str) -> str:
    """``sql`` over the logs of events; further common tables begin with a comma."""
    return f"WITH {A.EVENTS_SQL.strip()}{sql if sql.startswith(',') else ' ' + sql}"


def _certain(kind: str) -> str:
    return _SIGNAL.format(kind).replace("strength", "'corroborated' AS strength")


def _filter(name: str, make: Callable[[], Column], sql: str) -> None:
    """A filter over events: ids of what it keeps."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return explore.scoped(A.events_as_logs(spark, sf_dir), make()).select("record_id", "display_message")

    QUERIES[name] = run
    SQL[name] = _events(f"SELECT record_id, display_message FROM logs WHERE {sql}")


def _in_text(name: str, make: Callable[[], Column], sql: str) -> None:
    """A filter over whole document texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return explore.scoped(A.documents_as_logs(spark, sf_dir), make()).select("record_id", "resource_id")

    QUERIES[name] = run
    SQL[name] = f"WITH {A.DOCUMENTS_SQL.strip()} SELECT record_id, resource_id FROM logs WHERE {sql}"


_filter("match_all", P.match_all, "true")
_filter("severity_band_eq", lambda: P.severity("=", "ERROR") | P.severity("=", "WARN"), "severity_number BETWEEN 13 AND 20")
_filter("severity_ne_includes_missing", lambda: P.severity("!=", "ERROR"), "severity_number IS NULL OR severity_number NOT BETWEEN 17 AND 20")
_filter("severity_order", lambda: P.severity(">=", "WARN"), "severity_number >= 13")
_filter("severity_text_fallback", lambda: P.severity("=", "TRACE"), "severity_number BETWEEN 1 AND 4 OR (severity_number IS NULL AND upper(severity_text) = 'TRACE')")
_filter("severity_number_compare", lambda: P.severity_number(">", 9), "severity_number > 9")
_filter("timestamp_range", lambda: P.compare(P.field("timestamp"), ">=", W1) & P.compare(P.field("time"), "<", W2), f"event_time >= {W1} AND event_time < {W2}")
_filter("attr_int_compare", lambda: P.attribute_compare(("k",), ">=", 50), "k >= 50")
_filter("attr_nested_compare", lambda: P.attribute_compare(("http", "status"), "=", 500), "http_status = 500")
_filter("attr_double_compare", lambda: P.attribute_compare(("cents",), "<", 1000.5), "cents < 1000.5")
_filter("attr_exists", lambda: P.attribute_exists("attempt"), "attempt IS NOT NULL")
_filter("attr_missing", lambda: P.missing(P.attribute_exists("attempt")), "attempt IS NULL")
_filter("attr_ne", lambda: P.attribute_compare(("attempt",), "!=", 1), "attempt IS DISTINCT FROM 1")
_filter("attr_dotted_name", lambda: P.attribute_compare(("service.name",), "=", "error"), "event_type = 'error'")
_filter("bool_precedence", lambda: P.severity("=", "ERROR") | (P.compare(P.field("operation"), "=", "view") & ~P.attribute_compare(("k",), "<", 90)), "severity_number = 17 OR (operation = 'view' AND NOT k < 90)")
_filter("value_group", lambda: P.value_group(lambda v: P.compare(P.field("operation"), "=", v), ["click", "view"]) & ~P.compare(P.field("request_id"), "=", "u-1"), "operation IN ('click', 'view') AND request_id <> 'u-1'")
_filter("canon_exists", lambda: P.exists(P.field("outcome")), "outcome IS NOT NULL")
_filter("canon_ne_missing", lambda: P.compare(P.field("outcome"), "!=", "failure"), "outcome IS DISTINCT FROM 'failure'")
_filter("message_wildcard", lambda: P.wildcard(P.field("message"), "error*took ?*ms"), "regexp_matches(display_message, '^error.*took ..*ms$')")
_filter("phrase", lambda: P.phrase("HEARTBEAT user"), "regexp_matches(display_message, '(?i)(^|[^a-z0-9])heartbeat[^a-z0-9]+user([^a-z0-9]|$)')")
_in_text("term", lambda: P.term("the", F.col("body")), r"regexp_matches(body, '(?i)(?:^|[^\p{L}\p{N}])the(?:[^\p{L}\p{N}]|\z)')")
_in_text("term_unicode", lambda: P.term("ÉTRE", F.col("body")), r"regexp_matches(body, '(?i)(?:^|[^\p{L}\p{N}])étre(?:[^\p{L}\p{N}]|\z)')")
_in_text("regex_ci", lambda: P.regex(F.col("body"), "lic[a-z]+ under", True), "regexp_matches(body, '(?i)lic[a-z]+ under')")
_in_text("wildcard_line", lambda: P.wildcard(F.col("display_message"), "The*"), "regexp_matches(display_message, '^The.*$')")


@query(_events("SELECT record_id FROM logs WHERE request_id IN (SELECT 'u-' || user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 1)"))
def id_set_semijoin(spark, sf_dir):
    logs = A.events_as_logs(spark, sf_dir)
    often = logs.where("operation = 'error'").groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1")
    ids = logs.join(often, "request_id", "left_semi").select("record_id")
    return explore.by_ids(logs, ids).select("record_id")


@query(_events("SELECT record_id FROM logs WHERE operation <> 'error'"))
def anti_join_not(spark, sf_dir):
    logs = A.events_as_logs(spark, sf_dir)
    return explore.by_ids(logs, logs.where("operation = 'error'"), keep=False).select("record_id")


_ORDER = "event_time DESC NULLS LAST, record_id DESC"


@query(_events(f"SELECT record_id, event_time FROM logs WHERE severity_number >= 13 ORDER BY {_ORDER} LIMIT 201"))
def page_first(spark, sf_dir):
    return explore.page(A.events_as_logs(spark, sf_dir), P.severity(">=", "WARN")).select("record_id", "event_time")


def _cursor(record_id: str, event_time: int | None) -> str:
    return explore.cursor_of({"event_time": event_time, "record_id": record_id, "dataset_id": "events"})


@query(_events(f"SELECT record_id, event_time FROM logs WHERE event_time < {W2} OR event_time IS NULL ORDER BY {_ORDER} LIMIT 101"))
def page_next(spark, sf_dir):
    return explore.page(A.events_as_logs(spark, sf_dir), limit=100, cursor=_cursor("", W2)).select("record_id", "event_time")


@query(_events(f"SELECT record_id, event_time FROM logs WHERE event_time >= {W2} ORDER BY event_time, record_id LIMIT 101"))
def page_prev(spark, sf_dir):
    return explore.page(A.events_as_logs(spark, sf_dir), limit=100, cursor=_cursor("", W2), backward=True).select("record_id", "event_time")


@query(_events("SELECT record_id FROM logs WHERE event_time IS NULL AND record_id < 'ev-0000000500' ORDER BY record_id DESC LIMIT 1000"))
def page_undated_tail(spark, sf_dir):
    return explore.page(A.events_as_logs(spark, sf_dir), limit=999, cursor=_cursor("ev-0000000500", None)).select("record_id")


@query(_events("SELECT record_id FROM logs ORDER BY event_time ASC NULLS LAST, record_id LIMIT 100 OFFSET 200"))
def legacy_offset_page(spark, sf_dir):
    return explore.offset_page(A.events_as_logs(spark, sf_dir), limit=100, offset=200).select("record_id")


@query(_events(f"SELECT record_id FROM logs WHERE event_time >= {W1} AND event_time < {W2} AND severity_number = 17"))
def window_absolute(spark, sf_dir):
    return explore.scoped(A.events_as_logs(spark, sf_dir), P.severity("=", "ERROR"), explore.absolute(W1, W2)).select("record_id")


@query(_events(f"SELECT record_id FROM logs WHERE event_time >= (SELECT max(event_time) FROM logs) - {2 * DAY}"))
def window_relative_latest(spark, sf_dir):
    logs = A.events_as_logs(spark, sf_dir)
    return explore.scoped(logs, None, explore.relative_to_latest(logs, 2 * DAY)).select("record_id")


@query(_events(f"SELECT count(*) FILTER (event_time >= {W1} AND event_time < {W2}) AS matching, count(*) FILTER (event_time IS NULL) AS omitted_untimestamped FROM logs WHERE severity_number >= 13"))
def counts_with_omitted(spark, sf_dir):
    return explore.counts(A.events_as_logs(spark, sf_dir), P.severity(">=", "WARN"), explore.absolute(W1, W2))


@query(_events(f"SELECT b.s AS bin_start, count(event_time) AS n FROM (SELECT unnest(range({W1}, {W2}, 10800000000000)) AS s) b LEFT JOIN (SELECT event_time FROM logs WHERE severity_number = 17) l ON event_time >= b.s AND event_time < b.s + 10800000000000 GROUP BY b.s"))
def histogram_zero_fill(spark, sf_dir):
    return explore.histogram(A.events_as_logs(spark, sf_dir), P.severity("=", "ERROR"), explore.absolute(W1, W2))


def _facet_sql(name: str, value: str, most: int) -> str:
    return f"""SELECT '{name}' AS facet, value, n, missing, distinct_values > {most} AS truncated FROM (
      SELECT value, count(*) AS n, (SELECT count(*) FROM v WHERE value IS NULL) AS missing, (SELECT count(DISTINCT value) FROM v) AS distinct_values
      FROM v WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, value LIMIT {most}) WHERE true"""


@query(f"WITH {A.EVENTS_SQL.strip()}, v AS (SELECT CASE WHEN severity_number = 17 THEN 'ERROR' WHEN severity_number = 13 THEN 'WARN' WHEN severity_number = 9 THEN 'INFO' WHEN severity_number = 5 THEN 'DEBUG' ELSE upper(severity_text) END AS value FROM logs) {_facet_sql('severity', 'x', 10)}")
def facet_severity(spark, sf_dir):
    return explore.facets(A.events_as_logs(spark, sf_dir), {"severity": explore.severity_value()})


@query(f"WITH {A.EVENTS_SQL.strip()}, v AS (SELECT CAST(k AS VARCHAR) AS value FROM logs WHERE severity_number >= 13) {_facet_sql('k', 'x', 7)}")
def facet_attr_topk(spark, sf_dir):
    return explore.facets(A.events_as_logs(spark, sf_dir), {"k": P.attribute("k")}, P.severity(">=", "WARN"), most=7)


@query(
    f"WITH {A.EVENTS_SQL.strip()}, v AS (SELECT unnest(['operation', 'outcome', 'resource']) AS facet, unnest([operation, outcome, resource_id]) AS value FROM logs), "
    "c AS (SELECT facet, value, count(*) AS n FROM v GROUP BY facet, value), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY facet) AS vs FROM c WHERE value IS NOT NULL) "
    "SELECT facet, value, n, coalesce((SELECT m.n FROM c m WHERE m.facet = r.facet AND m.value IS NULL), 0) AS missing, vs > 5 AS truncated FROM r WHERE rank <= 5"
)
def facets_multi(spark, sf_dir):
    fields = {"operation": F.col("operation"), "outcome": F.col("outcome"), "resource": F.col("resource_id")}
    return explore.facets(A.events_as_logs(spark, sf_dir), fields, most=5)


@query(_events('SELECT count(k) AS present, count(*) FILTER (k IS NULL) AS missing, count(DISTINCT k) AS "distinct", true AS exact, CAST(min(k) AS DOUBLE) AS least, CAST(max(k) AS DOUBLE) AS largest FROM logs'))
def field_summary(spark, sf_dir):
    return explore.summary(A.events_as_logs(spark, sf_dir), P.attribute("k"), numeric=True)


@query()
def field_summary_approx(spark, sf_dir):
    return explore.summary(A.events_as_logs(spark, sf_dir), F.col("record_id"), exact_to=10)


@query(_events("SELECT CAST(k AS VARCHAR) AS value, count(*) AS n FROM logs GROUP BY k ORDER BY n DESC, value LIMIT 10"))
def field_top_values(spark, sf_dir):
    return explore.top_values(A.events_as_logs(spark, sf_dir), P.attribute("k"))


@query(_events("SELECT record_id, record_number FROM logs WHERE source_id = 'src-1' AND record_number BETWEEN 401 AND 441"))
def source_context(spark, sf_dir):
    return explore.source_context(A.events_as_logs(spark, sf_dir), "events", "src-1", 421, 20, 20).select("record_id", "record_number")


@query(_events("SELECT record_id, event_time, display_message, operation FROM logs WHERE record_id = 'ev-0000000042'"))
def record_detail(spark, sf_dir):
    return explore.record(A.events_as_logs(spark, sf_dir), "events", "ev-0000000042").select("record_id", "event_time", "display_message", "operation")


@query(
    _events(
        "SELECT record_id, coalesce(CAST(event_time AS VARCHAR), '') AS nanos, CASE severity_number WHEN 17 THEN 'ERROR' WHEN 13 THEN 'WARN' WHEN 9 THEN 'INFO' WHEN 5 THEN 'DEBUG' ELSE upper(severity_text) END AS severity, "
        "coalesce(CAST(severity_number AS VARCHAR), '') AS severity_number, display_message AS message, dataset_id AS dataset, source_id AS source, CAST(cents AS VARCHAR) AS cents, CAST(http_status AS VARCHAR) AS http_status FROM logs WHERE cents >= 0"
    )
)
def export_csv_rows(spark, sf_dir):
    logs = A.events_as_logs(spark, sf_dir).where(P.attribute_compare(("cents",), ">=", 0))
    rows = explore.csv_rows(logs, ("record_id", "timestamp.nanos", "severity", "severity.number", "message", "dataset", "source", "cents", "http.status"))
    return rows.toDF("record_id", "nanos", "severity", "severity_number", "message", "dataset", "source", "cents", "http_status")


@query(
    _events(
        """SELECT record_id, '{"record_id":"' || record_id || '"' || ',"timestamp":' || CASE WHEN event_time IS NULL THEN 'null' ELSE '"' || strftime(make_timestamp(event_time // 1000), '%Y-%m-%dT%H:%M:%S')
          || CASE WHEN event_time % 1000000000 = 0 THEN '' WHEN event_time % 1000000 = 0 THEN '.' || lpad(CAST(event_time % 1000000000 // 1000000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(event_time % 1000000000 // 1000 AS VARCHAR), 6, '0') END || 'Z"' END
          || ',"timestamp_nanos":' || coalesce(CAST(event_time AS VARCHAR), 'null')
          || ',"severity":"' || CASE severity_number WHEN 17 THEN 'ERROR' WHEN 13 THEN 'WARN' WHEN 9 THEN 'INFO' WHEN 5 THEN 'DEBUG' ELSE upper(severity_text) END || '"'
          || ',"severity_text":"' || severity_text || '"' || ',"severity_number":' || coalesce(CAST(severity_number AS VARCHAR), 'null') || ',"message":"' || display_message || '"'
          || ',"trace_id":null,"span_id":null,"dataset_id":"events"' || ',"source_id":"' || source_id || '"' || ',"record_number":' || record_number || ',"line_start":null'
          || ',"attributes":{"k":{"t":"int","v":' || k || '},"cents":{"t":"int","v":' || cents || '},"service.name":{"t":"str","v":"' || event_type || '"},"http":{"t":"map","v":{"status":{"t":"int","v":' || http_status || '}}}'
          || CASE WHEN attempt IS NOT NULL THEN ',"attempt":{"t":"int","v":' || attempt || '}' ELSE '' END || '}' || ',"provenance":null}' AS line FROM logs"""
    )
)
def export_jsonl_rows(spark, sf_dir):
    return explore.jsonl_rows(A.events_as_logs(spark, sf_dir))


@query(
    f"WITH {A.EVENTS_SQL.strip()}, cells AS (SELECT unnest(['k', 'cents', 'service.name', 'http.status', 'attempt']) AS path, unnest(['int', 'int', 'str', 'int', 'int']) AS types, "
    "unnest([CAST(k AS VARCHAR), CAST(cents AS VARCHAR), event_type, CAST(http_status AS VARCHAR), CAST(attempt AS VARCHAR)]) AS value FROM logs) "
    "SELECT 'events' AS dataset_id, path, types, CAST(count(*) AS BIGINT) AS present, count(DISTINCT value) AS \"distinct\", true AS exact, min(value) AS example, array_to_string(list_sort(list_distinct(list(value)))[1:3], ',') AS examples, true AS queryable FROM cells WHERE value IS NOT NULL GROUP BY path, types"
)
def field_catalog(spark, sf_dir):
    rows = catalog.field_catalog(A.events_as_logs(spark, sf_dir))
    return rows.drop("steps").withColumn("examples", F.array_join("examples", ","))


@query(
    f"WITH {A.EVENTS_SQL.strip()}, cells AS (SELECT source_id AS d, unnest(['k', 'cents', 'service.name', 'http.status', 'attempt']) AS path, unnest(['int', 'int', 'str', 'int', 'int']) AS types, "
    "unnest([CAST(k AS VARCHAR), CAST(cents AS VARCHAR), event_type, CAST(http_status AS VARCHAR), CAST(attempt AS VARCHAR)]) AS value FROM logs), "
    "per AS (SELECT d, path, types, count(*) AS present, count(DISTINCT value) AS n FROM cells WHERE value IS NOT NULL GROUP BY d, path, types) "
    "SELECT path, types, CAST(sum(present) AS BIGINT) AS present, max(n) AS \"distinct\", true AS exact, true AS queryable, count(*) AS datasets, false AS ambiguous FROM per GROUP BY path, types"
)
def field_catalog_merged(spark, sf_dir):
    """Each source of the events as a dataset of its own."""
    logs = A.events_as_logs(spark, sf_dir).withColumn("dataset_id", F.col("source_id"))
    return catalog.merged(catalog.field_catalog(logs)).drop("examples")


_TEMPLATES = r"t AS (SELECT *, regexp_replace(regexp_replace(display_message, '[0-9]+ms', '<dur>'), ' [0-9]+', ' <num>', 'g') AS template FROM logs)"


@query(_events(f", {_TEMPLATES} SELECT template, count(*) AS n, count(*) FILTER (event_time IS NULL) AS undated, min(event_time) AS earliest, max(event_time) AS latest FROM t GROUP BY template"))
def pattern_templates(spark, sf_dir):
    rows = patterns.with_template(A.events_as_logs(spark, sf_dir))
    return patterns.run(rows).select("template", "n", "undated", "earliest", "latest")


@query(
    _events(
        f", {_TEMPLATES}, b AS (SELECT template, event_time - event_time % 60000000000 AS bucket, count(*) AS n FROM t WHERE event_time IS NOT NULL GROUP BY 1, 2), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY n DESC, bucket) AS rank, count(*) OVER (PARTITION BY template) AS buckets FROM b) "
        "SELECT template, bucket AS peak_bucket, n AS peak_n, least(buckets, 1000000) AS buckets FROM r WHERE rank = 1"
    )
)
def pattern_buckets_peak(spark, sf_dir):
    rows = patterns.with_template(A.events_as_logs(spark, sf_dir))
    n = patterns.buckets(rows, most=1_000_000)
    peak = n.groupBy("template").agg(F.max(F.struct(F.col("n"), (-F.col("bucket")).alias("b"))).alias("p"), F.count("*").alias("buckets"))
    return peak.select("template", (-F.col("p.b")).alias("peak_bucket"), F.col("p.n").alias("peak_n"), "buckets")


@query(_events(f", {_TEMPLATES} SELECT template, resource_id, count(*) AS n FROM t WHERE event_time IS NOT NULL GROUP BY template, resource_id"))
def pattern_services(spark, sf_dir):
    return patterns.resources(patterns.with_template(A.events_as_logs(spark, sf_dir)))


@query()
def pattern_documents(spark, sf_dir):
    return patterns.run(patterns.with_template(A.documents_as_logs(spark, sf_dir), F.col("body"), bounded=False)).select("pattern_id", "template", "n")


#: A stack of each form, and what is to be read from it: form, type, frames, causes.
STACKS = {
    "java": ("com.shop.PayException: {}\n  at com.shop.Cart.pay(Cart.java:7)\n  at com.shop.Main.run(Main.java:9)\nCaused by: java.io.IOException: x", "com.shop.PayException", ["com.shop.Cart.pay", "com.shop.Main.run"], ["java.io.IOException"]),
    "dotnet": ("System.InvalidOperationException: {}\n   at Shop.Cart.Pay(Int32 n) in C:\\src\\Cart.cs:line 7\n   at Shop.Main.Run()", "System.InvalidOperationException", ["Shop.Cart.Pay", "Shop.Main.Run"], []),
    "python": ('Traceback (most recent call last):\n  File "/srv/app/cart.py", line 7, in pay\n  File "/srv/app/main.py", line 9, in run\nValueError: {}', "ValueError", ["pay@cart.py", "run@main.py"], []),
    "go": ("panic: {}\n\ngoroutine 1 [running]:\nmain.pay(0x1)\n\t/srv/cart.go:7 +0x1\nmain.main()\n\t/srv/main.go:9 +0x2", None, ["main.pay@cart.go", "main.main@main.go"], []),
    "node": ("TypeError: {}\n    at pay (/srv/app/cart.js:7:3)\n    at async run (/srv/app/main.js:9:1)", "TypeError", ["pay@cart.js", "run@main.js"], []),
}


def _stack_case(i: int, form: str) -> str:
    """SQL of a form's row: in Go the type is the panic's own text."""
    _, kind, frames, causes = STACKS[form]
    type_ = f"'{kind}'" if kind else "'panic:' || replace(display_message, ' ', '-')"
    pieces = [f"'{form}'", type_, "'0'", *(f"'{x}'" for x in [*frames, "|", *causes])]
    spelt = " || ".join(f"strlen({p}) || ':' || {p}" for p in pieces)
    return f"SELECT record_id, '{form}' AS form, 'parsed' AS quality, {type_} AS exception_type, '{' < '.join(frames)}' AS frames, '{','.join(causes)}' AS causes, false AS truncated, 'stk-' || substr(sha256({spelt}), 1, 32) AS fingerprint FROM logs WHERE operation = 'error' AND record_number % 5 = {i}"


@query(_events(" UNION ALL ".join(_stack_case(i, form) for i, form in enumerate(STACKS))))
def stack_fingerprints(spark, sf_dir):
    logs = A.events_as_logs(spark, sf_dir).where("operation = 'error'")
    text = F.lit(None)
    for i, (whole, *_) in enumerate(STACKS.values()):
        before, after = whole.split("{}")
        text = F.when(F.col("record_number") % 5 == i, F.concat(F.lit(before), "display_message", F.lit(after))).otherwise(text)
    rows = logs.select("record_id", stacks.stack(text).alias("s")).select("record_id", "s.*")
    return rows.withColumn("frames", F.array_join("frames", " < ")).withColumn("causes", F.array_join("causes", ","))


_CLASSIFIED = """c AS (SELECT *, CASE WHEN baseline = 0 AND suspect = 0 THEN 'insufficient' WHEN baseline = 0 THEN CASE WHEN suspect >= 5 THEN 'new' ELSE 'insufficient' END
    WHEN suspect = 0 THEN CASE WHEN baseline >= 5 THEN 'disappeared' ELSE 'insufficient' END WHEN greatest(baseline, suspect) < 5 THEN 'insufficient'
    WHEN abs(suspect * DB - baseline * DS) * 10000 >= baseline * DS * 5000 OR abs(suspect - baseline) >= 10
      THEN CASE WHEN suspect * DB > baseline * DS THEN 'increased' WHEN suspect * DB < baseline * DS THEN 'decreased' ELSE 'unchanged' END ELSE 'unchanged' END AS classification,
    CASE WHEN baseline = 0 THEN 'undefined' ELSE CAST(CAST(((suspect * DB - baseline * DS) * 10000) // (baseline * DS) AS BIGINT) AS VARCHAR) END AS rate_change_bp,
    baseline + suspect AS combined FROM n)"""


def _compare_sql(prelude: str, key: str, a: tuple[int, int], b: tuple[int, int]) -> str:
    from math import gcd

    d = gcd(a[1] - a[0], b[1] - b[0])
    inside = [f"event_time >= {x} AND event_time < {y}" for x, y in (a, b)]
    rows = f"n AS (SELECT {key} AS key, count(*) FILTER ({inside[0]}) AS baseline, count(*) FILTER ({inside[1]}) AS suspect, max(severity_number) AS ceiling FROM logs WHERE (({inside[0]}) OR ({inside[1]})) AND {key} IS NOT NULL GROUP BY 1)"
    return f"WITH {prelude.strip()}, {rows}, {_CLASSIFIED.replace('DB', str((a[1] - a[0]) // d)).replace('DS', str((b[1] - b[0]) // d))}"


_BASE, _SUSPECT = (W1, W2), (W2, W2 + 3 * DAY)


@query(_compare_sql(A.EVENTS_SQL, "operation", _BASE, _SUSPECT) + " SELECT key, baseline, suspect, ceiling, classification, rate_change_bp, combined FROM c")
def compare_operation(spark, sf_dir):
    return compare.compare(A.events_as_logs(spark, sf_dir), compare.key_of("operation"), _BASE, _SUSPECT)


@query(_compare_sql(A.EVENTS_SQL, "coalesce(severity_text, '(none)')", _BASE, _SUSPECT) + " SELECT key, baseline, suspect, ceiling, classification, rate_change_bp, combined FROM c")
def compare_severity(spark, sf_dir):
    return compare.compare(A.events_as_logs(spark, sf_dir), compare.key_of("severity"), _BASE, _SUSPECT)


@query(_compare_sql(A.EVENTS_SQL, r"regexp_replace(regexp_replace(display_message, '[0-9]+ms', '<dur>'), ' [0-9]+', ' <num>', 'g')", _BASE, _SUSPECT) + " SELECT key, baseline, suspect, classification, rate_change_bp FROM c")
def compare_template(spark, sf_dir):
    rows = compare.compare(A.events_as_logs(spark, sf_dir), compare.key_of("message_pattern"), _BASE, _SUSPECT)
    return rows.select("key", "baseline", "suspect", "classification", "rate_change_bp")


@query(
    _compare_sql(A.EVENTS_SQL, "request_id", _BASE, _SUSPECT) + ", r AS (SELECT *, row_number() OVER (ORDER BY combined DESC, key) AS rank FROM c) "
    "SELECT count(*) AS keys, count(*) FILTER (rank > 20) AS remainder_keys, CAST(coalesce(sum(baseline) FILTER (rank > 20), 0) AS BIGINT) AS remainder_baseline, CAST(coalesce(sum(suspect) FILTER (rank > 20), 0) AS BIGINT) AS remainder_suspect FROM r"
)
def compare_remainder(spark, sf_dir):
    return compare.remainder(compare.compare(A.events_as_logs(spark, sf_dir), F.col("request_id"), _BASE, _SUSPECT), 20)


@query(_events(f"SELECT count(*) FILTER (event_time >= {W1} AND event_time < {W2} AND outcome IS NOT NULL) AS accepted_baseline, count(*) FILTER (event_time >= {W2} AND event_time < {W2 + 3 * DAY} AND outcome IS NOT NULL) AS accepted_suspect, count(*) FILTER (event_time >= {W1} AND event_time < {W2 + 3 * DAY} AND outcome IS NULL) AS missing, count(*) FILTER (event_time IS NULL) AS undated FROM logs"))
def compare_left_out(spark, sf_dir):
    return compare.left_out(A.events_as_logs(spark, sf_dir), F.col("outcome"), _BASE, _SUSPECT)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.with_key(A.events_as_logs(spark, sf_dir))


_GROUPS = "SELECT request_id AS key, count(*) AS size, count(*) FILTER (event_time IS NULL) AS undated, min(event_time) AS first_time, max(event_time) AS last_time, count(DISTINCT resource_id) AS resources, 'correlated' AS confidence, count(event_time) AS kept, 0 AS truncated FROM logs GROUP BY request_id HAVING count(*) >= 2"


@query(_events(_GROUPS))
def corr_groups(spark, sf_dir):
    return correlate.groups(_keyed(spark, sf_dir))


@query(f"WITH {A.LINEITEM_SQL.strip()} {_GROUPS}")
def corr_groups_lineitem(spark, sf_dir):
    return correlate.groups(correlate.with_key(A.lineitem_as_logs(spark, sf_dir)))


@query(_events("SELECT 'missing_field' AS rejection, count(*) AS n FROM logs"))
def corr_rejections(spark, sf_dir):
    return correlate.rejections(correlate.with_key(A.events_as_logs(spark, sf_dir), "message_id"))


@query(_events("SELECT CAST(k AS VARCHAR) AS key, count(*) AS size FROM logs GROUP BY k HAVING count(*) >= 2"))
def corr_groups_attribute(spark, sf_dir):
    return correlate.groups(correlate.with_key(A.events_as_logs(spark, sf_dir), ("k",))).select("key", "size")


@query(_compare_sql(A.EVENTS_SQL, "event_type", _BASE, _SUSPECT) + " SELECT key, baseline, suspect, classification FROM c")
def compare_attribute(spark, sf_dir):
    rows = compare.compare(A.events_as_logs(spark, sf_dir), compare.key_of("attribute", "service.name"), _BASE, _SUSPECT)
    return rows.select("key", "baseline", "suspect", "classification")


@query(_events("SELECT CAST(user_id AS VARCHAR) AS key, 'strip_prefix' AS key_steps, count(*) AS n FROM logs GROUP BY user_id"))
def corr_normalised(spark, sf_dir):
    rows = correlate.with_key(A.events_as_logs(spark, sf_dir), trim=True, prefix="u-", fold=True)
    return rows.groupBy("key", "key_steps").agg(F.count("*").alias("n"))


_MEMBERS = "m AS (SELECT * FROM logs WHERE event_time IS NOT NULL)"


def _lag(columns: str, by: str = "request_id", order: str = "event_time, record_id", where: str = "true") -> str:
    lags = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in columns.split())
    return f"p AS (SELECT *, {lags}, row_number() OVER w AS place FROM m WHERE {where} WINDOW w AS (PARTITION BY {by} ORDER BY {order}))"


@query(_events(f", {_MEMBERS}, {_lag('record_id event_time')} SELECT request_id AS key, p_record_id AS from_id, record_id AS to_id, event_time - p_event_time AS delta FROM p WHERE p_record_id IS NOT NULL"))
def corr_edges(spark, sf_dir):
    return correlate.edges(correlate.members(_keyed(spark, sf_dir)))


@query(f"WITH {A.LINEITEM_SQL.strip()}, {_MEMBERS}, {_lag('record_id event_time')} SELECT request_id AS key, p_record_id AS from_id, record_id AS to_id, event_time - p_event_time AS delta FROM p WHERE p_record_id IS NOT NULL")
def corr_edges_lineitem(spark, sf_dir):
    return correlate.edges(correlate.members(correlate.with_key(A.lineitem_as_logs(spark, sf_dir))))


_SIGNAL = "request_id AS key, '{}' AS kind, strength, p_record_id AS from_id, record_id AS to_id, event_time - p_event_time AS delta"
_RETRY = (
    _lag("record_id event_time operation outcome attempt")
    + ", s AS (SELECT *, CASE WHEN (attempt IS NOT NULL AND p_attempt IS NOT NULL AND attempt <= p_attempt) OR operation <> p_operation THEN NULL WHEN attempt > p_attempt OR (p_attempt IS NULL AND attempt >= 1) THEN 'documented' WHEN operation = p_operation AND p_outcome IN ('failure', 'failed', 'error', 'timeout', 'rejected') THEN 'corroborated' WHEN operation = p_operation THEN 'indicative' END AS strength FROM p WHERE p_record_id IS NOT NULL)"
)


@query(_events(f", {_MEMBERS}, {_RETRY} SELECT {_SIGNAL.format('retry')} FROM s WHERE strength IS NOT NULL"))
def signal_retry(spark, sf_dir):
    return correlate.retries(correlate.members(_keyed(spark, sf_dir)), P.attribute("attempt").try_cast("bigint")).select(*correlate.SIGNAL)


@query(_events(f", {_MEMBERS}, {_lag('record_id event_time')} SELECT {_certain('gap')} FROM p WHERE event_time - p_event_time > 3600000000000"))
def signal_gap(spark, sf_dir):
    return correlate.gaps(correlate.members(_keyed(spark, sf_dir)), 3_600_000_000_000).select(*correlate.SIGNAL)


@query(_events(f", {_MEMBERS}, {_lag('record_id event_time record_number', 'request_id, source_id', 'record_number, record_id')} SELECT {_certain('clock_skew')} FROM p WHERE record_number > p_record_number AND p_event_time - event_time > 1000000"))
def signal_skew(spark, sf_dir):
    return correlate.clock_skews(correlate.members(_keyed(spark, sf_dir))).select(*correlate.SIGNAL)


@query(_events(f", {_MEMBERS}, {_lag('record_id event_time', 'request_id, display_message')} SELECT {_certain('operational_duplicate')} FROM p WHERE p_record_id IS NOT NULL"))
def signal_duplicate(spark, sf_dir):
    return correlate.duplicates(correlate.members(_keyed(spark, sf_dir))).select(*correlate.SIGNAL)


@query(_events(f"SELECT record_id, event_time - {W2} AS delta, 'probable' AS confidence FROM logs WHERE abs(event_time - {W2}) <= 7200000000000 AND resource_id = 'res-3' AND record_id <> 'ev-0000000001' ORDER BY abs(event_time - {W2}), event_time, record_id LIMIT 1000"))
def neighborhood(spark, sf_dir):
    return correlate.neighbourhood(A.events_as_logs(spark, sf_dir), W2, "ev-0000000001", 7_200_000_000_000, {"resource_id": "res-3"}, 1000).select("record_id", "delta", "confidence")


@query(
    _events(
        "SELECT a.record_id AS anchor_id, l.record_id, l.event_time - a.event_time AS delta, 'probable' AS confidence FROM logs a JOIN logs l ON l.event_time - a.event_time BETWEEN -90000000000 AND 90000000000 "
        "AND l.resource_id = a.resource_id AND l.record_id <> a.record_id WHERE a.operation = 'error'"
    )
)
def neighbourhood_many(spark, sf_dir):
    logs = A.events_as_logs(spark, sf_dir)
    return correlate.neighbourhoods(logs.where("operation = 'error'"), logs, 90_000_000_000, ["resource_id"]).select("anchor_id", "record_id", "delta", "confidence")


@query(SQL["term"])
def fts_term(spark, sf_dir):
    logs, path = A.documents_as_logs(spark, sf_dir), shared_dir(spark, "token-index")
    tokenindex.write(logs, path, F.col("body"))
    return tokenindex.search(logs, tokenindex.read(spark, path), "the", F.col("body")).select("record_id", "resource_id")


@query(SQL["phrase"])
def fts_phrase(spark, sf_dir):
    logs, path = A.events_as_logs(spark, sf_dir), shared_dir(spark, "token-index")
    tokenindex.write(logs, path)
    return tokenindex.search(logs, tokenindex.read(spark, path), "HEARTBEAT user").select("record_id", "display_message")


@query(_events("SELECT 'pin-' || i AS evidence_id, (SELECT count(*) FROM logs WHERE request_id = 'u-' || i AND (i % 2 = 0 OR operation = 'error')) AS n FROM range(100) t(i)"))
def verify_queries(spark, sf_dir):
    logs = A.events_as_logs(spark, sf_dir)
    pins = {f"pin-{i}": ((F.col("request_id") == f"u-{i}") & (F.lit(True) if i % 2 == 0 else F.col("operation") == "error"), explore.Window()) for i in range(100)}
    return evidence.recount(logs, pins)


_FIND_WINDOWS = (W1, W1 + DAY), (W3, W3 + DAY)


@query(
    _compare_sql(A.EVENTS_SQL, "request_id", *_FIND_WINDOWS)
    + """, f AS (
      SELECT 'new-high-severity-pattern' AS rule, key AS subject, ceiling, suspect AS measured, CASE WHEN suspect >= 50 THEN 2 WHEN suspect >= 15 THEN 1 ELSE 0 END AS m FROM c WHERE classification = 'new' AND suspect >= 5 AND ceiling >= 13
      UNION ALL SELECT 'increased-error-pattern', key, ceiling, suspect, CASE WHEN CAST(rate_change_bp AS BIGINT) >= 20000 THEN 2 WHEN CAST(rate_change_bp AS BIGINT) >= 5000 THEN 1 ELSE 0 END FROM c WHERE classification = 'increased' AND suspect >= 10 AND ceiling >= 17
      UNION ALL SELECT 'disappeared-pattern', key, ceiling, baseline, CASE WHEN baseline >= 50 THEN 2 WHEN baseline >= 15 THEN 1 ELSE 0 END FROM c WHERE classification = 'disappeared' AND baseline >= 5),
    g AS (SELECT *, CASE WHEN ceiling >= 17 AND ceiling <= 20 THEN 'error' WHEN ceiling >= 13 THEN 'warn' WHEN ceiling >= 9 THEN 'info' WHEN ceiling >= 5 THEN 'debug' WHEN ceiling >= 1 THEN 'trace' ELSE 'unknown' END AS band FROM f)
    SELECT rule, subject, CASE band WHEN 'error' THEN CASE m WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END WHEN 'warn' THEN CASE m WHEN 2 THEN 'medium' ELSE 'low' END ELSE CASE m WHEN 2 THEN 'low' ELSE 'informational' END END AS severity,
      'measured' AS confidence, band AS ceiling, CASE m WHEN 0 THEN 'small' WHEN 1 THEN 'moderate' ELSE 'large' END AS magnitude, measured FROM g"""
)
def finding_comparison(spark, sf_dir):
    return findings.from_comparison(compare.compare(A.events_as_logs(spark, sf_dir), F.col("request_id"), *_FIND_WINDOWS))


@query(
    _events(
        f", {_MEMBERS}, {_RETRY}, n AS (SELECT request_id AS key, count(*) AS n, max(CASE strength WHEN 'documented' THEN 2 WHEN 'corroborated' THEN 1 ELSE 0 END) AS sure FROM s WHERE strength IS NOT NULL GROUP BY request_id HAVING count(*) >= 3), "
        "k AS (SELECT request_id AS key, max(severity_number) AS ceiling FROM m GROUP BY request_id), f AS (SELECT n.*, ceiling, CASE WHEN n.n >= 30 THEN 2 WHEN n.n >= 9 THEN 1 ELSE 0 END AS mag FROM n JOIN k USING (key)), "
        "g AS (SELECT *, CASE WHEN ceiling >= 17 THEN 'error' WHEN ceiling >= 13 THEN 'warn' WHEN ceiling >= 9 THEN 'info' WHEN ceiling >= 5 THEN 'debug' ELSE 'unknown' END AS band FROM f) "
        "SELECT 'repeated-retry-signal' AS rule, key AS subject, CASE band WHEN 'error' THEN CASE mag WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END WHEN 'warn' THEN CASE mag WHEN 2 THEN 'medium' ELSE 'low' END ELSE CASE mag WHEN 2 THEN 'low' ELSE 'informational' END END AS severity, "
        "CASE sure WHEN 2 THEN 'measured' WHEN 1 THEN 'corroborated' ELSE 'indicative' END AS confidence, band AS ceiling, CASE mag WHEN 0 THEN 'small' WHEN 1 THEN 'moderate' ELSE 'large' END AS magnitude, n AS measured FROM g"
    )
)
def finding_repeated_retry(spark, sf_dir):
    rows = correlate.members(_keyed(spark, sf_dir))
    found = correlate.retries(rows, P.attribute("attempt").try_cast("bigint"))
    return findings.from_signals(found, rows)


_CONCENTRATED = (W1, W1 + 7 * DAY), (W2, W2 + 7 * DAY)


@query(
    _compare_sql(A.EVENTS_SQL, "operation", *_CONCENTRATED).replace("FROM logs WHERE ((", f"FROM logs WHERE NOT coalesce(event_time >= {W2} AND operation IN ('error', 'click', 'signup'), false) AND ((")
    + """, r AS (SELECT *, abs(suspect - baseline) AS change, row_number() OVER (ORDER BY abs(suspect - baseline) DESC, key) AS rank FROM c),
    t AS (SELECT count(*) AS keys, sum(change) AS whole, sum(change) FILTER (rank <= 3) AS part, max(ceiling) FILTER (rank <= 3) AS ceiling FROM r), s AS (SELECT CAST(part * 10000 // whole AS BIGINT) AS measured, ceiling FROM t WHERE keys > 3 AND whole > 0),
    m AS (SELECT *, CASE WHEN measured >= 9500 THEN 2 WHEN measured >= 9000 THEN 1 ELSE 0 END AS m FROM s WHERE measured >= 8000)
    SELECT 'concentrated-dimension-change' AS rule, 'operation' AS subject, CASE m WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity, 'measured' AS confidence, 'error' AS ceiling,
      CASE m WHEN 0 THEN 'small' WHEN 1 THEN 'moderate' ELSE 'large' END AS magnitude, measured FROM m WHERE ceiling = 17"""
)
def finding_concentrated(spark, sf_dir):
    """Three of five operations stop, so that they make nearly all of the change."""
    stop = F.coalesce((F.col("event_time") >= W2) & F.col("operation").isin("error", "click", "signup"), F.lit(False))
    return findings.concentrated(compare.compare(A.events_as_logs(spark, sf_dir).where(~stop), F.col("operation"), *_CONCENTRATED), "operation")


_EACH = (
    "n AS (SELECT request_id AS key, count(*) AS n, max(CASE strength WHEN 'corroborated' THEN 1 ELSE 0 END) AS sure FROM s GROUP BY request_id HAVING count(*) >= 3), "
    "k AS (SELECT request_id AS key, max(severity_number) AS ceiling FROM m GROUP BY request_id), f AS (SELECT n.*, ceiling, CASE WHEN n.n >= 30 THEN 2 WHEN n.n >= 9 THEN 1 ELSE 0 END AS mag FROM n JOIN k USING (key)), "
    "g AS (SELECT *, CASE WHEN ceiling >= 17 THEN 'error' WHEN ceiling >= 13 THEN 'warn' WHEN ceiling >= 9 THEN 'info' WHEN ceiling >= 5 THEN 'debug' ELSE 'unknown' END AS band FROM f) "
    "SELECT '{}' AS rule, key AS subject, CASE band WHEN 'error' THEN CASE mag WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END WHEN 'warn' THEN CASE mag WHEN 2 THEN 'medium' ELSE 'low' END ELSE CASE mag WHEN 2 THEN 'low' ELSE 'informational' END END AS severity, "
    "CASE sure WHEN 1 THEN 'corroborated' ELSE 'indicative' END AS confidence, band AS ceiling, CASE mag WHEN 0 THEN 'small' WHEN 1 THEN 'moderate' ELSE 'large' END AS magnitude, n AS measured FROM g"
)


@query(_events(f", {_MEMBERS}, {_lag('record_id event_time', 'request_id, display_message')}, s AS (SELECT *, 'corroborated' AS strength FROM p WHERE p_record_id IS NOT NULL), {_EACH.format('operational-duplicate')}"))
def finding_operational_duplicate(spark, sf_dir):
    rows = correlate.members(_keyed(spark, sf_dir))
    return findings.from_signals(correlate.duplicates(rows), rows)


@query(
    _events(
        f", {_MEMBERS}, {_lag('record_id event_time record_number', 'request_id, source_id', 'record_number, record_id')}, "
        f"s AS (SELECT *, 'corroborated' AS strength FROM p WHERE record_number > p_record_number AND p_event_time - event_time > 1000000), {_EACH.format('clock-skew-warning')}"
    )
)
def finding_clock_skew(spark, sf_dir):
    rows = correlate.members(_keyed(spark, sf_dir))
    return findings.from_signals(correlate.clock_skews(rows), rows)


@query(
    _events(
        f", {_MEMBERS}, {_lag('record_id event_time record_number')}, g AS (SELECT *, (record_number % 29 = 0) AS i, (p_record_number % 29 = 0) AS pi FROM p WHERE event_time - p_event_time > 3600000000000) "
        "SELECT request_id AS key, 'gap' AS kind, CASE WHEN i OR pi THEN 'indicative' ELSE 'corroborated' END AS strength, p_record_id AS from_id, record_id AS to_id, event_time - p_event_time AS delta, 'gap/1' AS rule, true AS lead, "
        "p_event_time AS from_time, event_time AS to_time, 3600000000000 AS tolerance, 'event_time' || CASE WHEN pi THEN '' ELSE ',earlier_timestamp_observed' END || CASE WHEN i THEN '' ELSE ',later_timestamp_observed' END AS matched, "
        "concat_ws(',', CASE WHEN pi THEN 'earlier_timestamp_observed' END, CASE WHEN i THEN 'later_timestamp_observed' END) AS missing FROM g"
    )
)
def signal_rows(spark, sf_dir):
    """Gaps with what they rest on; of every 29th record the zone was assumed."""
    flags = F.when(F.col("record_number") % 29 == 0, '{"flags":["timezone_assumed"]}').otherwise('{"flags":[]}')
    rows = correlate.members(_keyed(spark, sf_dir).withColumn("provenance_json", flags))
    found = correlate.gaps(rows, 3_600_000_000_000, correlate.inferred(rows)).drop("signal_id", "reason")
    return found.withColumn("matched", F.array_join("matched", ",")).withColumn("missing", F.array_join("missing", ","))


@query(_events("SELECT CASE WHEN event_time IS NULL THEN 'missing' WHEN record_number % 29 = 0 THEN 'inferred' ELSE 'observed' END AS quality, count(*) AS n FROM logs GROUP BY 1"))
def time_quality(spark, sf_dir):
    flags = F.when(F.col("record_number") % 29 == 0, '{"flags":["timezone_assumed"]}').otherwise('{"flags":["severity_unmapped"]}')
    logs = A.events_as_logs(spark, sf_dir).withColumn("provenance_json", flags)
    return logs.groupBy(correlate.time_quality(logs).alias("quality")).agg(F.count("*").alias("n"))


@query(
    _events(
        ", g AS (SELECT request_id, count(event_time) AS dated, least(count(event_time), 16) AS kept FROM logs GROUP BY request_id HAVING count(*) >= 2) "
        "SELECT greatest(count(*) - 10, 0) AS groups, CAST(sum(dated - kept) AS BIGINT) AS members, CAST(sum(greatest(dated - 1, 0) - least(greatest(kept - 1, 0), 8)) AS BIGINT) AS edges FROM g"
    )
)
def corr_dropped(spark, sf_dir):
    """What bounds of 10 groups, 16 members and 8 edges would leave out."""
    return correlate.dropped(_keyed(spark, sf_dir), 10, 16, 8)


@query(_events("SELECT record_id, resource_id, n_name AS name, r_name AS region FROM logs LEFT JOIN (SELECT 'res-' || n_nationkey AS id, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3) ON resource_id = id"))
def resource_lookup_join(spark, sf_dir):
    nations = A.table(spark, sf_dir, "nation").join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey <> 3")
    resources = nations.select(F.concat(F.lit("res-"), "n_nationkey").alias("resource_id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return explore.with_dimension(A.events_as_logs(spark, sf_dir), resources, "resource_id").select("record_id", "resource_id", "resource.name", "resource.region")


@query(_events("SELECT record_id, min(record_number) AS record_number, count(*) AS copies FROM (SELECT 'u-' || user_id || '-' || k AS record_id, record_number FROM logs) GROUP BY record_id"))
def dedup_first_wins(spark, sf_dir):
    """Rows that get one id by user and k: the first in the source stays, the others are counted."""
    ids = F.concat("request_id", F.lit("-"), P.attribute("k"))
    logs = A.events_as_logs(spark, sf_dir).withColumn("record_id", ids).withColumn("origin_id", F.lit("o"))
    kept = ingest.deduplicated(logs).select("record_id", "record_number")
    return kept.join(logs.groupBy("record_id").agg(F.count("*").alias("copies")), "record_id")


def _written(spark: SparkSession, sf_dir: str, purpose: str, line: Column) -> str:
    """Events as text files, one for each of four sources, in their order, with an empty line before every 7th."""
    path = shared_dir(spark, purpose)
    gap = F.when(F.col("event_id") % 7 == 0, F.lit("\n")).otherwise(F.lit(""))
    rows = A.table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("part"), "event_id", F.concat(gap, line).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").drop("event_id").write.partitionBy("part").text(path)
    return path


_LINE_PLACES = """WITH l AS (SELECT event_id, event_id % 4 AS part, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS gap, '{"id":' || event_id || ',"op":"' || event_type || '"}' AS line FROM events)"""


@query(
    _LINE_PLACES + " SELECT part, event_id, row_number() OVER w AS record_number, CAST(count(*) OVER w + sum(gap) OVER w AS BIGINT) AS line_start, "
    "CAST(sum(gap + strlen(line) + 1) OVER w - strlen(line) - 1 AS BIGINT) AS byte_start, CAST(sum(gap + strlen(line) + 1) OVER w - 1 AS BIGINT) AS byte_end, true AS ended FROM l WINDOW w AS (PARTITION BY part ORDER BY event_id)"
)
def lines_with_places(spark, sf_dir):
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("op")))
    rows = files.placed_lines(spark, _written(spark, sf_dir, "lines", line) + "/*")
    number = F.get_json_object("raw", "$.id").cast("long")
    return rows.select((number % 4).alias("part"), number.alias("event_id"), "record_number", "line_start", "byte_start", "byte_end", "ended")


@query("SELECT event_id % 4 AS part, event_id, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS record_number, 'a \"' || event_type || '\", b' AS op, CASE WHEN event_id % 5 = 0 THEN 'more' END AS column_2 FROM events")
def csv_with_places(spark, sf_dir):
    more = F.when(F.col("event_id") % 5 == 0, F.lit(",more")).otherwise(F.lit(""))
    line = F.concat("event_id", F.lit(',"a ""'), "event_type", F.lit('"", b"'), more)
    rows = files.placed_csv(spark, _written(spark, sf_dir, "csv", line) + "/*", header=False)
    cell = lambda i: F.get_json_object("raw", f"$.column_{i}")
    return rows.select((cell(0).cast("long") % 4).alias("part"), cell(0).cast("long").alias("event_id"), "record_number", cell(1).alias("op"), cell(2).alias("column_2"))


@query(f"WITH {A.METRICS_SQL.strip()} SELECT time - time % 21600000000000 AS bucket, metric_type, count(*) AS points, CAST(sum(value) AS DOUBLE) AS total, CAST(min(value) AS DOUBLE) AS least, CAST(max(value) AS DOUBLE) AS largest, CAST(sum(value) AS DOUBLE) / count(*) AS mean FROM points WHERE metric_name = 'click' AND (metric_type = 'gauge' OR temporality = 'delta') AND time >= {W1} AND time < {W3} GROUP BY 1, 2")
def metric_rollup(spark, sf_dir):
    return metrics.rollup(A.events_as_metric_points(spark, sf_dir), "click", 21_600_000_000_000, W1, W3)


#: By the rules of the trace graph: the latest start of a parent id counts, each child has an edge of its own, a link
#: is resolved only within its trace.
_SPAN_NODES = """nodes AS (SELECT s.*, (SELECT count(*) FROM spans o WHERE o.trace_id = s.trace_id AND o.span_id = s.span_id) > 1 AS duplicate_span_id, s.end_time IS NULL AS missing_end,
  coalesce(s.start_time < (SELECT max(p.start_time) FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id), false) AS clock_skew_before_parent,
  s.parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id) AS orphan_parent,
  s.parent_span_id IS NULL AS root, flags % 2 = 1 AS sampled FROM spans s)"""


@query(f"WITH {A.SPANS_SQL.strip()}, {_SPAN_NODES} SELECT record_id, trace_id, span_id, duplicate_span_id, missing_end, clock_skew_before_parent, orphan_parent, root, sampled FROM nodes")
def trace_nodes(spark, sf_dir):
    return traces.nodes(A.lineitem_as_spans(spark, sf_dir)).select("record_id", "trace_id", "span_id", *traces.FLAGS, "sampled")


@query(f"WITH {A.SPANS_SQL.strip()} SELECT trace_id, parent_span_id, span_id FROM spans s WHERE EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id)")
def trace_parent_edges(spark, sf_dir):
    return traces.parent_edges(A.lineitem_as_spans(spark, sf_dir))


@query(f"WITH {A.SPANS_SQL.strip()} SELECT trace_id, parent_span_id, span_id FROM spans s WHERE parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id)")
def trace_unresolved(spark, sf_dir):
    return traces.unresolved(A.lineitem_as_spans(spark, sf_dir))


@query(
    f"WITH {A.SPANS_SQL.strip()} SELECT trace_id, span_id, link_trace AS linked_trace_id, link_span AS linked_span_id, "
    "trace_id = link_trace AND EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.link_trace AND p.span_id = s.link_span) AS resolved_in_trace FROM spans s WHERE link_trace IS NOT NULL"
)
def trace_link_edges(spark, sf_dir):
    return traces.link_edges(A.lineitem_as_spans(spark, sf_dir))


@query(
    f"WITH {A.SPANS_SQL.strip()}, {_SPAN_NODES} SELECT trace_id, count(*) AS spans, count(*) FILTER (duplicate_span_id) AS duplicate_span_id, count(*) FILTER (missing_end) AS missing_end, "
    "count(*) FILTER (clock_skew_before_parent) AS clock_skew_before_parent, count(*) FILTER (orphan_parent) AS orphan_parent, count(*) FILTER (root) AS root, NOT bool_or(root) AS missing_root FROM nodes GROUP BY trace_id"
)
def trace_integrity(spark, sf_dir):
    return traces.integrity(A.lineitem_as_spans(spark, sf_dir))


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw JSON lines: times as text, some unreadable, and a broken line for every 250th."""
    e = A.table(spark, sf_dir, "events")
    time = F.when(F.col("event_id") % 40 == 0, "soon").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    line = F.to_json(F.struct(time.alias("ts"), F.upper("event_type").alias("level"), F.concat(F.lit("user "), "user_id").alias("message"), "event_id", "value"))
    return e.select(F.lit("events").alias("origin_id"), F.when(F.col("event_id") % 250 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("raw"), F.col("event_id").alias("record_number"))


@query(
    "SELECT event_id AS record_number, CASE WHEN event_id % 40 <> 0 THEN epoch_ns(ts) END AS event_time, CASE event_type WHEN 'error' THEN 17 END AS severity_number, "
    "'user ' || user_id AS display_message, CAST(event_id AS VARCHAR) AS id_attribute FROM events WHERE event_id % 250 <> 0"
)
def normalise_jsonl(spark, sf_dir):
    logs, _ = ingest.normalise(_raw_lines(spark, sf_dir), profiles.JSONL, "events", "s")
    return logs.select("record_number", "event_time", "severity_number", "display_message", P.attribute("event_id").alias("id_attribute"))


@query("SELECT 'parse/invalid-json' AS reason, event_id AS record_number FROM events WHERE event_id % 250 = 0")
def normalise_rejects(spark, sf_dir):
    return ingest.normalise(_raw_lines(spark, sf_dir), profiles.JSONL, "events", "s")[1].select("reason", "record_number")


def _odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw JSON lines of which most are odd in one way, by the id's remainder."""
    user = F.col("user_id").cast("string")
    deep = F.concat(F.lit('{"message":"deep","v":'), F.repeat(F.lit("["), 200), user, F.repeat(F.lit("]"), 200), F.lit("}"))
    odd = [
        F.concat(F.lit('{"message":"user '), user, F.lit(' cut \\ud83d"}')), F.concat(F.lit('{"message":"user '), user, F.lit(' whole \\ud83d\\ude00"}')),
        F.concat(F.lit('{"v":NaN,"message":"user '), user, F.lit('"}')), F.concat(F.lit('{"message":"user '), user, F.lit('","v":'), F.repeat(F.lit("7"), 5000), F.lit("}")),
        F.concat(F.lit('{"ts":"9999-12-31T23:59:59Z","message":"user '), user, F.lit('"}')), F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("["), 3000)).otherwise(deep),
        F.concat(F.lit('{"ts":"0001-01-01T00:00:00+14:00","message":"user '), user, F.lit('"}')), F.concat(F.lit('{"ts":"2024-01-08T00:00:00Z","message":"user '), user, F.lit('","v":[[1,"]"]]}')),
    ]
    line = F.get(F.array(*odd), (F.col("event_id") % len(odd)).cast("int"))
    return A.table(spark, sf_dir, "events").select(F.lit("odd").alias("origin_id"), line.alias("raw"), F.col("event_id").alias("record_number"))


@query(
    "SELECT event_id AS record_number, k IN (0, 2, 5) AS rejected, CASE WHEN k NOT IN (0, 2, 5) THEN 'user ' || user_id || CASE WHEN k = 1 THEN ' whole ' || chr(128512) ELSE '' END END AS display_message, "
    f"CASE WHEN k = 7 THEN {W1} END AS event_time, k IN (4, 6) AS unread, CASE WHEN k = 3 THEN 5000 ELSE 0 END AS digits FROM (SELECT *, event_id % 8 AS k FROM events)"
)
def normalise_odd(spark, sf_dir):
    rows = ingest.normalised(_odd_lines(spark, sf_dir), profiles.JSONL, "odd", "s")
    bad = F.col("reason").isNotNull()
    unread = F.col("provenance_json").contains('"timestamp_unparsed"')
    digits = F.coalesce(F.length(F.get_json_object("attributes_json", "$.v.v")), F.lit(0))
    number = F.get_json_object("attributes_json", "$.v.t") == "str"
    return rows.select("record_number", bad.alias("rejected"), F.when(~bad, F.col("display_message")).alias("display_message"), "event_time", unread.alias("unread"), F.when(number, digits).otherwise(0).alias("digits"))


@query("SELECT event_id % 4 AS part, event_id, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS record_number, CAST(CASE WHEN event_id % 997 = 0 THEN 140000 ELSE 4 END AS INT) AS size FROM events")
def csv_odd(spark, sf_dir):
    cell = F.when(F.col("event_id") % 997 == 0, F.repeat(F.lit("xyz\n"), 35_000)).otherwise(F.lit("xyz\n"))
    rows = files.placed_csv(spark, _written(spark, sf_dir, "csv-odd", F.concat("event_id", F.lit(',"'), cell, F.lit('"'))) + "/*", header=False)
    number = F.get_json_object("raw", "$.column_0").cast("long")
    return rows.select((number % 4).alias("part"), number.alias("event_id"), "record_number", F.length(F.get_json_object("raw", "$.column_1")).alias("size"))


def _envelopes(spark: SparkSession, sf_dir: str, outer: str, middle: str, inner: str, record: Column) -> DataFrame:
    """An OTLP envelope for each event. Few bytes of the table are many texts' work, so its rows are dealt out to all cores before the texts are made."""
    wrap = lambda name, x: F.struct(F.array(x).alias(name))
    line = F.to_json(wrap(outer, wrap(middle, wrap(inner, record))))
    events = A.table(spark, sf_dir, "events").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    return events.select(F.lit("f").alias("origin_id"), line.alias("raw"))


def _list(**values: Column) -> Column:
    pairs = [F.struct(F.lit(k).alias("key"), F.struct(v.alias("intValue")).alias("value")) for k, v in values.items()]
    return F.array(*pairs)


def _text(c: Column) -> Column:
    return c.cast("string")


@query("SELECT epoch_ns(ts) AS event_time, CASE WHEN event_type = 'error' THEN 17 END AS severity_number, 'user ' || user_id AS display_message, CAST(event_id AS VARCHAR) AS id_attribute FROM events WHERE event_id % 100 <> 0")
def otlp_logs(spark, sf_dir):
    time = F.when(F.col("event_id") % 100 == 0, "99999999999999999999").otherwise(_text(A.nanos(F.col("ts"))))
    record = F.struct(
        time.alias("timeUnixNano"), F.when(F.col("event_type") == "error", 17).alias("severityNumber"),
        F.struct(F.concat(F.lit("user "), "user_id", F.lit("\nmore")).alias("stringValue")).alias("body"), _list(id=_text(F.col("event_id"))).alias("attributes"),
    )
    rows, _ = otlp.logs(_envelopes(spark, sf_dir, "resourceLogs", "scopeLogs", "logRecords", record), "d")
    return rows.select("event_time", "severity_number", "display_message", P.attribute("id").alias("id_attribute"))


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'array' ELSE 'map' END AS type, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_attribute, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind, "
    "CASE WHEN event_id % 3 <> 0 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END END AS flag, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS second_item FROM events WHERE event_id % 3 <> 1 OR user_id >= 100"
)
def otlp_nested(spark, sf_dir):
    """Values within maps within maps, and within arrays, by the paths that filters take; one filter is by such a path."""
    whole = lambda c: F.concat(F.lit('{"intValue":"'), c, F.lit('"}'))
    string = lambda c: F.concat(F.lit('{"stringValue":"'), c, F.lit('"}'))
    pair = lambda k, v: F.concat(F.lit(f'{{"key":"{k}","value":'), v, F.lit("}"))
    several = lambda name, *v: F.concat(F.lit(f'{{"{name}":{{"values":['), F.concat_ws(",", *v), F.lit("]}}"))
    flag = F.concat(F.lit('{"boolValue":'), _text(F.col("user_id") % 2 == 0), F.lit("}"))
    deep = several("kvlistValue", pair("kind", string(F.col("event_type"))), pair("flag", flag))
    value = F.when(F.col("event_id") % 3 == 0, several("arrayValue", string(F.col("event_type")), whole(F.col("user_id")))).otherwise(several("kvlistValue", pair("user", whole(F.col("user_id"))), pair("deep", deep)))
    listed = F.concat(F.lit("["), pair("id", whole(F.col("event_id"))), F.lit(","), pair("http", value), F.lit("]"))
    raw = F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"attributes":'), listed, F.lit("}]}]}]}"))
    rows, _ = otlp.logs(A.table(spark, sf_dir, "events").select(F.lit("f").alias("origin_id"), raw.alias("raw")), "d")
    number, path = P.attribute("id").cast("long"), P.attribute_compare(("http", "user"), ">=", 100)
    return rows.where((number % 3 != 1) | path).select(
        number.alias("event_id"), P.attribute_type("http").alias("type"), P.attribute("http", "user").alias("user_attribute"), P.attribute("http", "deep", "kind").alias("kind"),
        P.attribute("http", "deep", "flag").alias("flag"), F.get_json_object("attributes_json", "$['http'].v[1].v").alias("second_item"),
    )


@query("SELECT lpad(CAST(user_id + 1 AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(event_id + 1 AS VARCHAR), 16, '0') AS span_id, event_type AS name, epoch_ns(ts) AS start_time, CASE WHEN event_id % 7 <> 0 THEN 1000 END AS duration_nanos FROM events WHERE event_id % 90 <> 0")
def otlp_spans(spark, sf_dir):
    start = A.nanos(F.col("ts"))
    record = F.struct(
        F.when(F.col("event_id") % 90 == 0, "0" * 32).otherwise(F.lpad(_text(F.col("user_id") + 1), 32, "0")).alias("traceId"), F.lpad(_text(F.col("event_id") + 1), 16, "0").alias("spanId"),
        F.col("event_type").alias("name"), _text(start).alias("startTimeUnixNano"), F.when(F.col("event_id") % 7 != 0, _text(start + 1000)).alias("endTimeUnixNano"),
    )
    rows, _ = otlp.spans(_envelopes(spark, sf_dir, "resourceSpans", "scopeSpans", "spans", record), "d")
    return rows.select("trace_id", "span_id", "name", "start_time", "duration_nanos")


@query("SELECT event_type AS metric_name, 'sum' AS metric_type, 'delta' AS temporality, epoch_ns(ts) AS time, CASE WHEN event_id % 2 = 0 THEN user_id END AS value_int, CASE WHEN event_id % 2 <> 0 THEN CAST(user_id AS DOUBLE) END AS value_double FROM events WHERE event_id % 60 <> 0")
def otlp_metrics(spark, sf_dir):
    there = F.col("event_id") % 60 != 0
    point = F.struct(
        _text(A.nanos(F.col("ts"))).alias("timeUnixNano"), F.when(there & (F.col("event_id") % 2 == 0), _text(F.col("user_id"))).alias("asInt"),
        F.when(there & (F.col("event_id") % 2 != 0), F.col("user_id").cast("double")).alias("asDouble"),
    )
    record = F.struct(F.col("event_type").alias("name"), F.struct(F.lit(1).alias("aggregationTemporality"), F.array(point).alias("dataPoints")).alias("sum"))
    rows, _ = otlp.metric_points(_envelopes(spark, sf_dir, "resourceMetrics", "scopeMetrics", "metrics", record), "d")
    return rows.select("metric_name", "metric_type", "temporality", "time", "value_int", "value_double")


@query(_compare_sql(A.EVENTS_SQL, "operation", *_FIND_WINDOWS) + """, r AS (SELECT *, abs(suspect - baseline) AS change, row_number() OVER (ORDER BY abs(suspect - baseline) DESC, key) AS rank FROM c),
    t AS (SELECT count(*) AS keys, sum(change) AS whole, sum(change) FILTER (rank <= 3) AS part FROM r) SELECT CAST(part * 10000 // whole AS BIGINT) AS share FROM t WHERE keys > 3 AND whole > 0""")
def change_share(spark, sf_dir):
    return findings.shares(compare.compare(A.events_as_logs(spark, sf_dir), F.col("operation"), *_FIND_WINDOWS)).select("share")


@query(
    "SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS bucket, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1, 2"
)
def stream_window_counts(spark, sf_dir):
    """The table as a stream of files, counted by windows as it comes."""
    found = spark.readStream.schema(A.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    logs = found.parquet(f"{sf_dir}/events.parquet*").withColumn("event_time", A.nanos(F.col("ts")))
    counts = stream.counts_by_window(logs, "6 hours", "1 day", "event_type", F.sum("user_id").alias("total"))
    path = shared_dir(spark, "stream-counts")
    stream.to_table(counts.select(F.unix_micros("window.start").alias("bucket"), "event_type", "n", "total"), path, f"{path}-state", once=True).awaitTermination()
    return stream.latest(spark, path, ["bucket", "event_type"])


def _pins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Errors of each user as one pin, of which every third names a record that isn't there."""
    logs = A.events_as_logs(spark, sf_dir)
    ids = F.sort_array(F.collect_list("record_id"))
    pins = logs.where("operation = 'error'").groupBy("request_id").agg(ids.alias("ids"), F.count("*").alias("n"))
    lost = F.when(F.substring("request_id", 3, 9).cast("int") % 3 == 0, F.array(F.lit("ev-none"))).otherwise(F.array().cast("array<string>"))
    return pins.select(
        F.col("request_id").alias("evidence_id"), F.lit("selection").alias("kind"), F.lit("events").alias("dataset_id"), F.lit(None).cast("string").alias("revision"),
        F.concat("ids", lost).alias("record_ids"), F.col("n").alias("expected"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit("").alias("note"),
    ), logs


@query(_events("SELECT request_id AS evidence_id, CASE WHEN user_id % 3 = 0 THEN 'partially_resolved' ELSE 'verified' END AS state, count(*) AS resolved, count(*) AS expected FROM logs WHERE operation = 'error' GROUP BY request_id, user_id"))
def verify_batch(spark, sf_dir):
    return evidence.verify(*_pins(spark, sf_dir))


@query(
    _events(
        ", t AS (SELECT request_id AS id, min(event_time) AS a, max(event_time) AS b FROM logs WHERE operation = 'error' GROUP BY request_id), "
        "u AS (SELECT id, a, CASE WHEN b > a THEN b END AS z FROM t) "
        "SELECT row_number() OVER (ORDER BY a NULLS LAST, z IS NOT NULL, z, id) AS place, id, 'selection' AS kind, a AS \"at\", z AS \"until\", CASE WHEN a IS NULL THEN 'none of its records is dated' END AS undated_reason, '' AS title FROM u"
    )
)
def timeline_merge(spark, sf_dir):
    return evidence.timeline(*_pins(spark, sf_dir))


@query(_events("SELECT record_id, regexp_replace(display_message, '[0-9]+ms', '<time>') AS display_message, '[masked]' AS request_id, 'who-' || substr(sha256(resource_id), 1, 16) AS resource_id, CAST(2 + CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END + CASE WHEN source_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS redactions FROM logs"))
def redact_project(spark, sf_dir):
    rows = A.events_as_logs(spark, sf_dir).select("record_id", "display_message", "request_id", "resource_id", "source_id")
    profile = redaction.Profile((("replace_regex", "[0-9]+ms", "<time>"), ("mask", "request_id"), ("pseudonymize", "resource_id", "who")), deny=("source_id",))
    return redaction.redact(rows, profile)


@query(_events("SELECT record_id, display_message FROM logs WHERE operation = 'error'"))
def bundle_subset(spark, sf_dir):
    return report.subset(*_pins(spark, sf_dir)).select("record_id", "display_message")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
