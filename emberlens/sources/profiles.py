"""Import profiles: which fields of a raw record become which canonical ones."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    """The first candidate that is present wins, and leaves the attributes."""

    name: str
    timestamp: tuple[str, ...] = ()
    severity: tuple[str, ...] = ()
    message: tuple[str, ...] = ()
    trace_id: tuple[str, ...] = ("trace_id", "trace.id")
    span_id: tuple[str, ...] = ("span_id", "span.id")
    generic: dict[str, tuple[str, ...]] = field(default_factory=dict)
    time_format: str = "rfc3339"  # or epoch_s, epoch_ms, epoch_us, epoch_ns, or a strftime pattern
    timezone: str = "UTC"
    delimiter: str = ","
    header: bool = True
    version: str = "1"


#: The fields that the built-in profiles name.
JSONL = Profile("builtin.jsonl.generic", ("@timestamp", "timestamp", "time", "ts"), ("log.level", "level", "severity"), ("message", "msg"))
ELASTIC = Profile(
    "builtin.elasticsearch.export", ("@timestamp", "timestamp", "event.created"), ("log.level", "level", "severity"), ("message", "event.original", "msg"),
    ("trace.id", "trace_id"), ("span.id", "span_id"),
    {"event_type": ("event.type", "event.action"), "outcome": ("event.outcome",), "request_id": ("http.request.id",), "transaction_id": ("transaction.id",)},
)
CSV = Profile("builtin.csv.basic", ("timestamp", "@timestamp", "time"), ("level", "severity"), ("message",), ("trace_id",), ("span_id",))
GENERIC = ("event_name", "operation", "outcome", "event_type", "request_id", "transaction_id", "message_id", "entity_id")
