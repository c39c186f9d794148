"""Canonical rows: logs, metric points and spans. Times are UTC nanoseconds in longs."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (field.split() for field in spec.split(","))])


PROVENANCE = "dataset_id string, source_id string, origin_id string, archive_entry string, record_number long, line_start long, byte_start long, byte_end long, raw_hash string, ingest_time long, provenance_json string"
LOGS = _struct(
    "record_id string, event_time long, observed_time long, original_timestamp_text string, timezone_assumption_json string, severity_text string, severity_number int, "
    "body_json string, display_message string, event_name string, trace_id string, span_id string, trace_flags long, resource_id string, scope_id string, operation string, "
    "outcome string, event_type string, request_id string, transaction_id string, message_id string, entity_id string, attributes_json string, dropped_attributes_count long, "
    + PROVENANCE
)
METRICS = _struct(
    "record_id string, point_index long, metric_name string, description string, unit string, metric_type string, temporality string, is_monotonic boolean, "
    "point_attributes_json string, start_time long, time long, point_flags long, value_int long, value_double double, count long, sum double, histogram_json string, "
    "min double, max double, exemplars_json string, point_quality_json string, metric_metadata_json string, resource_id string, scope_id string, " + PROVENANCE
)
SPANS = _struct(
    "record_id string, trace_id string, span_id string, parent_span_id string, trace_state string, flags long, name string, kind int, start_time long, end_time long, "
    "duration_nanos long, status_code int, status_message string, resource_id string, scope_id string, attributes_json string, events_json string, links_json string, "
    "dropped_attributes_count long, dropped_events_count long, dropped_links_count long, " + PROVENANCE
)
#: Fixed value: the total order of pages, caps and exports is time descending with undated rows last, then these descending.
TIEBREAK = ("record_id", "dataset_id")
SECOND = 1_000_000_000
