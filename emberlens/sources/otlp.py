"""OTLP JSON lines: export envelopes to canonical log, metric and span rows, in built-in functions.

An envelope a line; resources, scopes and records are opened by ``posexplode``, so a
row keeps its index at each level. Field names are read in camel or snake case.
Values within values, which may go any depth, are tagged in Arrow batches; only texts that have some are sent there.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from emberlens.functions.normalise import content_id, hex_id

ATTRIBUTES = "array<struct<key:string,value:string>>"
_NAMES = {"logs": ("resourceLogs", "scopeLogs", "logRecords"), "metrics": ("resourceMetrics", "scopeMetrics", "metrics"), "spans": ("resourceSpans", "scopeSpans", "spans")}


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _json(column: Column, name: str) -> Column:
    """A member's JSON text, whichever way it is spelt."""
    return F.coalesce(F.get_json_object(column, f"$.{name}"), F.get_json_object(column, f"$.{_snake(name)}"))


def _items(column: Column) -> Column:
    return F.from_json(column, "array<string>")


def _members(rows: DataFrame, column: str, *names: str) -> DataFrame:
    """``rows`` with members of a column's JSON objects, whichever way they are spelt, as JSON texts ``<column>__<name>``: each object
    is read once for all of them, and no expression above reads it again. Of members of one name the last that isn't null counts."""
    spelt = list(dict.fromkeys(x for n in names for x in (n, _snake(n))))
    read = rows.select("*", F.json_tuple(F.col(column), *spelt).alias(*[f"{column}:{n}" for n in spelt]))
    of = lambda n: F.coalesce(*[F.col(f"{column}:{x}") for x in dict.fromkeys((n, _snake(n)))])
    return read.select(*rows.columns, *[of(n).alias(f"{column}__{n}") for n in names])


def _of(column: str):
    """A member that ``_members`` read."""
    return lambda name: F.col(f"{column}__{name}")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def opened(lines: DataFrame, signal: str) -> DataFrame:
    """``(origin_id, resource, scope, record, at)`` of a signal's records, each as JSON text."""
    outer, middle, inner = _NAMES[signal]
    keep = "origin_id" if "origin_id" in lines.columns else F.lit(None).cast("string").alias("origin_id")
    r = _members(lines.select(keep, "raw"), "raw", outer).select("origin_id", F.posexplode(_items(F.col(f"raw__{outer}"))).alias("ri", "r"))
    r = _members(r, "r", "resource", middle)
    s = r.select("origin_id", "ri", F.col("r__resource").alias("resource"), F.posexplode(_items(F.col(f"r__{middle}"))).alias("si", "s"))
    return _members(s, "s", "scope", inner).select(
        "origin_id", "resource", F.col("s__scope").alias("scope"), "ri", "si", F.posexplode(_items(F.col(f"s__{inner}"))).alias("i", "record")
    ).select("origin_id", "resource", "scope", "record", F.concat_ws("/", "ri", "si", "i").alias("at"))


def signal_of(lines: DataFrame) -> DataFrame:
    """``(origin_id, raw, signal)``; null where a line is no envelope."""
    out = F.lit(None).cast("string")
    for signal, (outer, _, _) in _NAMES.items():
        out = F.when(_json(F.col("raw"), outer).isNotNull(), F.lit(signal)).otherwise(out)
    return lines.withColumn("signal", out)


def envelope_rejects(lines: DataFrame) -> DataFrame:
    return signal_of(lines).where("signal is null").select("origin_id", F.lit("otlp/invalid-envelope").alias("reason"), F.substring("raw", 1, 4096).alias("excerpt"))


#: The members of an AnyValue, in the order in which one is taken where there are several, and the types of their values.
_VALUES = {"stringValue": "str", "boolValue": "bool", "intValue": "int", "doubleValue": "double", "bytesValue": "bytes", "arrayValue": "array", "kvlistValue": "map"}
_ODD = {"NaN": "NaN", "Infinity": "+Inf", "-Infinity": "-Inf"}


def _tag(value: object) -> dict:
    """A parsed AnyValue with the type of each value in it: of equal keys the last stays, keys in order."""
    value = value if isinstance(value, dict) else {}
    for name, kind in _VALUES.items():
        v = value.get(name, value.get(_snake(name)))
        if v is None:
            continue
        if kind == "map":
            return {"t": kind, "v": _tag_list(v.get("values") if isinstance(v, dict) else None)}
        if kind == "array":
            items = v.get("values") if isinstance(v, dict) else None
            return {"t": kind, "v": [_tag(x) for x in items] if isinstance(items, list) else []}
        if kind == "int" and isinstance(v, str):
            try:
                v = int(v)
            except ValueError:
                return {"t": "str", "v": v}
        if kind == "double" and v in _ODD:
            v = _ODD[v]
        return {"t": kind, "v": v}
    return {"t": "empty"}


def _tag_list(pairs: object) -> dict:
    found = {str(p["key"]): p.get("value") for p in pairs if isinstance(p, dict) and p.get("key") is not None} if isinstance(pairs, list) else {}
    return {k: _tag(found[k]) for k in sorted(found)}


def _plain(tagged: dict) -> object:
    """A tagged value without its types, as messages show it."""
    v = tagged.get("v")
    if tagged["t"] == "map":
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if tagged["t"] == "array" else v


def _retagged(text: str | None, tag) -> str | None:
    """Null where the text can't be read, or is nested too deeply to be."""
    try:
        return None if text is None else json.dumps(tag(json.loads(text)), separators=(",", ":"), ensure_ascii=False).encode("utf-8", "replace").decode()
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _nested_value(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _retagged(t, _tag))


@F.pandas_udf(StringType())
def _nested_list(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _retagged(t, _tag_list))


@F.pandas_udf(StringType())
def _nested_shown(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _retagged(t, lambda v: _plain(_tag(v))))


def _with_nested(text: Column, nested, flat: Column) -> Column:
    """``flat``, but what ``nested`` makes of texts that have values within values; null goes there for all others."""
    deep = text.rlike('"(kvlist|array)(Value|_value)"')
    return F.coalesce(nested(F.when(deep, text)), flat)


def tagged_value(value: Column) -> Column:
    """An AnyValue's JSON as its type and value, and so are the values in maps and arrays, at any depth. What is nested more deeply
    than a JSON reader goes stays as it came."""
    return _with_nested(value, _nested_value, _flat_value(value))


def _quoted(value: Column) -> Column:
    return _let(F.to_json(F.array(value)), lambda q: F.substr(q, F.lit(2), F.length(q) - 2))


def _flat_value(value: Column) -> Column:
    text = lambda kind, v: F.concat(F.lit(f'{{"t":"{kind}","v":'), v, F.lit("}"))
    double = lambda v: F.when(v.isin(*_ODD), _quoted(F.replace(F.replace(v, F.lit("Infinity"), F.lit("+Inf")), F.lit("-+"), F.lit("-")))).otherwise(v)
    of = {"str": _quoted, "bytes": _quoted, "double": double}
    # the first that there is; null gives null but for the quoted ones
    tagged = lambda kind: lambda v: F.when(v.isNotNull(), text(kind, of.get(kind, lambda x: x)(v)))
    return F.coalesce(*[_let(_json(value, name), tagged(kind)) for name, kind in _VALUES.items()], F.lit('{"t":"empty"}'))


def attributes(column: Column) -> Column:
    """A key-value list as tagged JSON; of equal keys the last stays, keys in order."""
    later = lambda pairs, e, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"])
    last = _let(F.from_json(column, ATTRIBUTES), lambda pairs: F.filter(pairs, lambda e, i: ~later(pairs, e, i)))
    texts = F.transform(F.array_sort(last), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _flat_value(e["value"])))
    flat = F.concat(F.lit("{"), F.coalesce(F.array_join(texts, ","), F.lit("")), F.lit("}"))
    return _with_nested(column, _nested_list, flat)


def attribute_text(list_json: Column, key: str) -> Column:
    pairs = F.from_json(list_json, ATTRIBUTES)
    hit = F.filter(pairs, lambda p: p["key"] == key)
    return F.get_json_object(F.get(hit, F.size(hit) - 1)["value"], "$.stringValue")


def _nanos(column: Column) -> Column:
    """0 is absent; what doesn't fit is null."""
    value = column.try_cast("long")
    return F.when(value > 0, value)


def _out_of_range(column: Column) -> Column:
    return column.isNotNull() & column.try_cast("long").isNull()


def _context(rows: DataFrame) -> DataFrame:
    return rows.withColumn("resource_id", content_id("res", attributes(_json(F.col("resource"), "attributes")))).withColumn(
        "scope_id", content_id("scp", _json(F.col("scope"), "name"), _json(F.col("scope"), "version"))
    )


#: Members that are read of records and points.
_LOG = ("timeUnixNano", "observedTimeUnixNano", "severityText", "severityNumber", "body", "traceId", "spanId", "attributes", "eventName")
_SPAN = ("traceId", "spanId", "parentSpanId", "name", "kind", "startTimeUnixNano", "endTimeUnixNano", "status", "attributes", "events", "links")
_POINT = ("timeUnixNano", "startTimeUnixNano", "flags", "asInt", "asDouble", "attributes", "count", "sum", "min", "max", "exemplars")


def logs(lines: DataFrame, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of log records. Attributes come by ``explode``, so that filters and columns that read them don't have them tagged anew."""
    rows = _members(_context(opened(lines, "logs")), "record", *_LOG)
    at = _of("record")
    trace, span = at("traceId"), at("spanId")
    reason = F.when(_out_of_range(at("timeUnixNano")), "otlp/timestamp-out-of-range")
    body = tagged_value(at("body"))
    out = rows.withColumn("reason", reason)
    good = out.where("reason is null").select(
        content_id("log", F.col("record"), F.col("resource_id"), F.col("scope_id"), F.col("at")).alias("record_id"), _nanos(at("timeUnixNano")).alias("event_time"),
        _nanos(at("observedTimeUnixNano")).alias("observed_time"), at("severityText").alias("severity_text"),
        F.when(at("severityNumber").try_cast("int").between(1, 24), at("severityNumber").try_cast("int")).alias("severity_number"), body.alias("body_json"),
        F.split_part(F.coalesce(_with_nested(at("body"), _nested_shown, F.get_json_object(body, "$.v")), F.lit("")), F.lit("\n"), F.lit(1)).alias("display_message"), hex_id(trace, 32).alias("trace_id"), hex_id(span, 16).alias("span_id"),
        F.explode(F.array(attributes(at("attributes")))).alias("attributes_json"), "resource_id", "scope_id", at("eventName").alias("event_name"), F.lit(dataset_id).alias("dataset_id"), "origin_id",
    )
    return good, out.where("reason is not null").select("origin_id", "at", "reason")


def spans(lines: DataFrame, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: a span needs its trace and span id; an end that is missing stays missing."""
    rows = _members(_context(opened(lines, "spans")), "record", *_SPAN)
    at = _of("record")
    trace, span = hex_id(at("traceId"), 32), hex_id(at("spanId"), 16)
    parent = F.when(F.coalesce(at("parentSpanId"), F.lit("")) != "", at("parentSpanId"))
    reason = (
        F.when(trace.isNull(), "otlp/invalid-trace-id")
        .when(span.isNull() | (parent.isNotNull() & ~parent.rlike("(?i)^[0-9a-f]{16}$")), "otlp/invalid-span-id")
        .when(_out_of_range(at("startTimeUnixNano")) | _out_of_range(at("endTimeUnixNano")), "otlp/timestamp-out-of-range")
    )
    links = F.transform(F.from_json(at("links"), "array<struct<traceId:string,spanId:string>>"), lambda x: F.struct(hex_id(x["traceId"], 32).alias("trace_id"), hex_id(x["spanId"], 16).alias("span_id")))
    start, end = F.coalesce(_nanos(at("startTimeUnixNano")), F.lit(0)), _nanos(at("endTimeUnixNano"))
    out = rows.withColumn("reason", reason)
    good = out.where("reason is null").select(
        content_id("spn", F.col("record"), F.col("resource_id"), F.col("scope_id"), F.col("at")).alias("record_id"), trace.alias("trace_id"), span.alias("span_id"), hex_id(parent, 16).alias("parent_span_id"),
        at("name").alias("name"), F.coalesce(at("kind").try_cast("int"), F.lit(0)).alias("kind"), start.alias("start_time"), end.alias("end_time"), (end - start).alias("duration_nanos"),
        F.coalesce(F.get_json_object(at("status"), "$.code").try_cast("int"), F.lit(0)).alias("status_code"), F.get_json_object(at("status"), "$.message").alias("status_message"),
        attributes(at("attributes")).alias("attributes_json"), at("events").alias("events_json"), F.to_json(F.filter(links, lambda x: x["trace_id"].isNotNull())).alias("links_json"),
        "resource_id", "scope_id", F.lit(dataset_id).alias("dataset_id"), "origin_id",
    )
    return good, out.where("reason is not null").select("origin_id", "at", "reason")


_KINDS = {"gauge": "gauge", "sum": "sum", "histogram": "histogram", "exponentialHistogram": "exponential_histogram", "summary": "summary"}


def metric_points(lines: DataFrame, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``, a row a data point: whole and decimal values in columns of their own; "no recorded value" is NaN."""
    rows = _members(_context(opened(lines, "metrics")), "record", "name", "description", "unit", *_KINDS)
    metric = _of("record")
    kind, data = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, own in _KINDS.items():
        kind, data = F.when(metric(name).isNotNull(), F.lit(own)).otherwise(kind), F.coalesce(metric(name), data)
    typed = rows.withColumn("metric_type", kind).withColumn("data", data)
    of = _members(typed, "data", "dataPoints", "aggregationTemporality", "isMonotonic")
    points = _members(of.select("*", F.posexplode(_items(_of("data")("dataPoints"))).alias("point_index", "point")), "point", *_POINT)
    at = _of("point")
    nothing = F.coalesce(at("flags").try_cast("long"), F.lit(0)).bitwiseAND(F.lit(1)) == 1
    plain = F.col("metric_type").isin("gauge", "sum")
    reason = F.when(_out_of_range(at("timeUnixNano")), "otlp/timestamp-out-of-range").when(plain & ~nothing & at("asInt").isNull() & at("asDouble").isNull(), "otlp/point-without-value")
    temporality = F.get(F.array(*map(F.lit, ("unspecified", "delta", "cumulative"))), F.coalesce(_of("data")("aggregationTemporality").try_cast("int"), F.lit(0)))
    out = points.withColumn("reason", reason)
    good = out.where("reason is null").select(
        content_id("met", F.col("record"), F.col("resource_id"), F.col("scope_id"), F.col("at"), F.col("point_index")).alias("record_id"), F.col("point_index").cast("long").alias("point_index"),
        metric("name").alias("metric_name"), metric("description").alias("description"), metric("unit").alias("unit"), "metric_type",
        F.when(F.col("metric_type") != "gauge", temporality).alias("temporality"), _of("data")("isMonotonic").try_cast("boolean").alias("is_monotonic"),
        attributes(at("attributes")).alias("point_attributes_json"), _nanos(at("startTimeUnixNano")).alias("start_time"), F.coalesce(_nanos(at("timeUnixNano")), F.lit(0)).alias("time"),
        at("asInt").try_cast("long").alias("value_int"), F.when(nothing, F.lit(float("nan"))).otherwise(at("asDouble").try_cast("double")).alias("value_double"),
        at("count").try_cast("long").alias("count"), at("sum").try_cast("double").alias("sum"), at("min").try_cast("double").alias("min"), at("max").try_cast("double").alias("max"),
        F.when(~plain, F.col("point")).alias("histogram_json"), at("exemplars").alias("exemplars_json"), "resource_id", "scope_id", F.lit(dataset_id).alias("dataset_id"), "origin_id",
    )
    unknown = typed.where("metric_type is null").select("origin_id", "at", F.lit("otlp/unknown-metric-type").alias("reason"))
    return good, out.where("reason is not null").select("origin_id", "at", "reason").unionByName(unknown)


def resources(lines: DataFrame, signal: str) -> DataFrame:
    """``(resource_id, attributes_json)``: a row a resource, as the rows of ``signal`` name it."""
    rows = _context(opened(lines, signal))
    return rows.select("resource_id", attributes(_json(F.col("resource"), "attributes")).alias("attributes_json")).distinct()


def scopes(lines: DataFrame, signal: str) -> DataFrame:
    """``(scope_id, name, version)``: a row an instrumentation scope."""
    rows = _context(opened(lines, signal))
    return rows.select("scope_id", _json(F.col("scope"), "name").alias("name"), _json(F.col("scope"), "version").alias("version")).distinct()
