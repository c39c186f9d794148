"""Predicates over canonical logs, as Columns.

Every leaf is two-valued: what is missing matches ``!=`` and ``NOT``, never a
comparison. Equality is null-safe; leaves of other kinds also ask that their column
isn't null. Spark pushes both to Parquet, which it wouldn't with ``coalesce``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A level's numbers, and the canonical fields with their aliases.
BANDS = {"TRACE": (1, 4), "DEBUG": (5, 8), "INFO": (9, 12), "WARN": (13, 16), "ERROR": (17, 20), "FATAL": (21, 24)}
FIELDS = {
    "timestamp": "event_time", "@timestamp": "event_time", "time": "event_time", "observed_timestamp": "observed_time", "observed.timestamp": "observed_time",
    "severity.text": "severity_text", "severity_text": "severity_text", "severity.number": "severity_number", "severity_number": "severity_number",
    "message": "display_message", "msg": "display_message", "body": "display_message", "event.name": "event_name", "event_name": "event_name",
    "trace_id": "trace_id", "trace.id": "trace_id", "span_id": "span_id", "span.id": "span_id", "operation": "operation", "outcome": "outcome",
    "event_type": "event_type", "event.type": "event_type", "request_id": "request_id", "request.id": "request_id", "transaction_id": "transaction_id",
    "transaction.id": "transaction_id", "message_id": "message_id", "message.id": "message_id", "entity_id": "entity_id", "entity.id": "entity_id",
    "dataset": "dataset_id", "record_id": "record_id",
}


def two_valued(leaf: Column) -> Column:
    """False where ``leaf`` is null, whatever made it so."""
    return F.coalesce(leaf, F.lit(False))


def known(column: Column, leaf: Column) -> Column:
    """``leaf``, which only a null ``column`` makes null, and false there."""
    return column.isNotNull() & leaf


def match_all() -> Column:
    return F.lit(True)


def all_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def field(name: str) -> Column:
    """A canonical field by its name or an alias."""
    if name not in FIELDS:
        raise ValueError(f"no canonical field {name!r}; attributes are reached by attribute()")
    return F.col(FIELDS[name])


def instant(text: str) -> int:
    """The nanoseconds of an RFC 3339 time, or of the beginning of a date; without a zone it is UTC."""
    found = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})?)?", text)
    if not found:
        raise ValueError(f"no time: {text!r}")
    date, clock, fraction, zone = found.groups()
    whole = datetime.fromisoformat(f"{date}T{clock or '00:00:00'}{'+00:00' if zone in (None, 'Z', 'z') else zone}")
    return int((whole - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000_000 + int((fraction or "").ljust(9, "0"))


def time_compare(op: str, text: str, column: Column | None = None) -> Column:
    """``event_time``, or another column of nanoseconds, against an RFC 3339 time or a date."""
    return compare(F.col("event_time") if column is None else column, op, instant(text))


def quoted(value: str) -> str:
    """A value as it stands between quotes in a filter's text."""
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def compare(column: Column, op: str, value) -> Column:
    """``=``, ``!=``, ``>``, ``>=``, ``<`` or ``<=`` to a literal."""
    if op in ("=", "!="):
        same = column.eqNullSafe(F.lit(value))
        return same if op == "=" else ~same
    return known(column, {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[op])


def severity(op: str, level: str) -> Column:
    """By level: equality by number, or by text where the number is missing; order by
    number alone, against the level's edges."""
    low, high = BANDS[level.upper()]
    number = F.col("severity_number")
    if op in ("=", "!="):
        same = known(number, number.between(low, high)) | (number.isNull() & F.upper("severity_text").eqNullSafe(level.upper()))
        return same if op == "=" else ~same
    return compare(number, op, {">": high, ">=": low, "<": low, "<=": high}[op])


def severity_number(op: str, value: int) -> Column:
    if not 1 <= value <= 24:
        raise ValueError("severity numbers are 1 to 24")
    return compare(F.col("severity_number"), op, value)


def severity_exists() -> Column:
    return F.col("severity_number").isNotNull() | F.col("severity_text").isNotNull()


def exists(column: Column) -> Column:
    return column.isNotNull()


def _json_path(path: tuple[str, ...]) -> str:
    """Spark's JSON paths have no escapes, so names that would need one are refused."""
    if not path or any(not p or set(p) & set("'\\[]*") for p in path):
        raise ValueError(f"no attribute can be reached by {path!r}")
    return "$" + ".v".join(f"['{p}']" for p in path)


def attribute(*path: str) -> Column:
    """An attribute's value as text; a dotted name is one step, nested maps take several."""
    return F.get_json_object("attributes_json", _json_path(path) + ".v")


def attribute_type(*path: str) -> Column:
    return F.get_json_object("attributes_json", _json_path(path) + ".t")


def attribute_exists(*path: str) -> Column:
    kind = attribute_type(*path)
    return known(kind, kind != "empty")


def attribute_compare(path: tuple[str, ...], op: str, value) -> Column:
    """By the literal's own type: whole numbers, doubles, truth values or text."""
    text = attribute(*path)
    if isinstance(value, bool):
        return compare(text, op, str(value).lower())
    if isinstance(value, int):
        return compare(text.try_cast("bigint"), op, value)
    if isinstance(value, float):
        return compare(text.try_cast("double"), op, value)
    if op not in ("=", "!="):
        raise ValueError("text has no order")
    return compare(text, op, value)


def attribute_typed(path: tuple[str, ...], op: str, text: str, types: str) -> Column:
    """An attribute against a literal's text, which is read as the ``types`` that the field catalog has of it: as a number if
    all of them are numbers, else as text. A text that isn't of the type is an error."""
    kinds = set(types.split(",")) - {"empty"}
    if kinds <= {"int"}:
        return attribute_compare(path, op, int(text))
    if kinds <= {"int", "double"}:
        return attribute_compare(path, op, float(text))
    if kinds <= {"bool"}:
        if text not in ("true", "false"):
            raise ValueError(f"no truth value: {text!r}")
        return attribute_compare(path, op, text == "true")
    if len(kinds) > 1 and op not in ("=", "!="):
        raise ValueError(f"{'.'.join(path)} has values of the types {types}, which have no common order")
    return attribute_compare(path, op, text)


def tokens(text: str) -> list[str]:
    """Maximal runs of letters and digits."""
    return re.findall(r"[^\W_]+", text)


def phrase(text: str, column: Column | None = None) -> Column:
    """The words of ``text`` one after the other, whole words, in any case; false without words."""
    words = tokens(text)
    if not words:
        return F.lit(False)
    gap, edge = r"[^\p{L}\p{N}]+", r"[^\p{L}\p{N}]"
    pattern = rf"(?iu)(?:^|{edge}){gap.join(map(re.escape, words))}(?:{edge}|\z)"
    column = F.col("display_message") if column is None else column
    return known(column, column.rlike(pattern))


term = phrase


def wildcard(column: Column, pattern: str) -> Column:
    """``*`` is any run, ``?`` any character but a line break; backslash makes them themselves; the whole value must match."""
    out = []
    for part in re.findall(r"\\[*?]|.", pattern, re.S):
        out.append({"*": ".*", "?": "."}.get(part) or re.escape(part[-1] if len(part) == 2 else part))
    return known(column, column.rlike(rf"(?d)\A{''.join(out)}\z"))


def regex(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Found anywhere; patterns that need more than linear time are refused."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k", pattern):
        raise ValueError("look-around and references are not supported")
    return known(column, column.rlike(f"(?d{'iu' if ignore_case else ''}){pattern}"))


def value_group(make, values: Iterable) -> Column:
    """One predicate for each value, any of which may hold."""
    return any_of(make(v) for v in values)


def missing(predicate: Column) -> Column:
    return ~predicate
