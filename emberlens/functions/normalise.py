"""Severity texts, times and ids of raw records as Columns."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity numbers by text.
SEVERITY = {
    "TRACE": 1, "VERBOSE": 1, "FINEST": 1, "FINER": 2, "DEBUG": 5, "FINE": 5, "DBG": 5, "CONFIG": 7, "INFO": 9, "INFORMATION": 9, "INFORMATIONAL": 9,
    "NOTICE": 10, "WARN": 13, "WARNING": 13, "ERROR": 17, "ERR": 17, "SEVERE": 17, "FATAL": 21, "CRITICAL": 21, "CRIT": 21, "ALERT": 22,
    "EMERGENCY": 23, "EMERG": 23, "PANIC": 23,
}
UNITS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}


def severity_number(text: Column) -> Column:
    """By name in any case; numbers 1 to 24 are themselves; null for the rest."""
    token = F.upper(F.trim(text))
    names = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    number = token.try_cast("int")
    return F.when(token.rlike(r"^[+-]?[0-9]+$"), F.when(number.between(1, 24), number)).otherwise(F.try_element_at(names, token))


def rfc3339_nanos(text: Column) -> Column:
    """UTC nanoseconds of an RFC 3339 time, all nine digits of a fraction; a text without
    offset is UTC; null if it is no such time, or one beyond 64 bits of nanoseconds (the years 1677 to 2262)."""
    shape = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(?:([Zz])|([+-])(\d{2}):(\d{2}))?$"
    part = lambda i: F.regexp_extract(text, shape, i)
    whole = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2)), F.lit("yyyy-MM-dd HH:mm:ss")))
    fraction = F.rpad(part(3), 9, "0").cast("long")
    offset = (F.when(part(5) == "", 0).otherwise(part(6).try_cast("int") * 3600 + part(7).try_cast("int") * 60)) * F.when(part(5) == "-", -1).otherwise(1)
    return F.when(text.rlike(shape), F.try_add(F.try_multiply(whole - offset, F.lit(1_000_000_000)), fraction))


def rfc3339(nanos: Column) -> Column:
    """The text of an instant in UTC, with as many of three, six or nine digits as it needs."""
    rest = F.pmod(nanos, F.lit(1_000_000_000))
    whole = F.date_format(F.timestamp_seconds(((nanos - rest) / 1_000_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    parts = [(1_000_000_000, ""), (1_000_000, "%03d"), (1_000, "%06d"), (1, "%09d")]
    fraction = F.lit(None).cast("string")
    for unit, form in reversed(parts):
        digits = F.lit("") if not form else F.concat(F.lit("."), F.format_string(form, (rest / unit).cast("long")))
        fraction = F.when(rest % unit == 0, digits).otherwise(fraction)
    return F.concat(whole, fraction, F.lit("Z"))


def precision(text: Column) -> Column:
    """Of a time's fraction: s, ms, us or ns."""
    n = F.length(F.regexp_extract(text, r"\.(\d+)", 1))
    return F.when(n == 0, "s").when(n <= 3, "ms").when(n <= 6, "us").otherwise("ns")


def epoch_nanos(text: Column, unit: str) -> Column:
    """Whole or decimal counts of ``unit`` since the epoch; null if they are none or go beyond 64 bits of nanoseconds."""
    value = text.try_cast("decimal(38,9)")
    return F.try_multiply(value, F.lit(UNITS[unit])).try_cast("long")


def local_nanos(text: Column, pattern: str, zone: str) -> Column:
    """A local time by a strftime pattern. What an overlap makes ambiguous is the earlier
    instant; what a gap leaves out is null, as are times beyond 64 bits of nanoseconds."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: local_instant(t, pattern, zone)).astype("Int64")

    return F.pandas_udf(of, "long")(text)


def local_instant(text: str | None, pattern: str, zone: str) -> int | None:
    try:
        local = datetime.strptime(text or "", pattern)
        if local.tzinfo is None:
            if zone[:1] in "+-":
                sign, hours, minutes = (-1 if zone[0] == "-" else 1), int(zone[1:3]), int(zone[-2:])
                local = local.replace(tzinfo=timezone(sign * timedelta(hours=hours, minutes=minutes)))
            else:
                naive, local = local, local.replace(tzinfo=ZoneInfo(zone), fold=0)
                if local.astimezone(timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None) != naive:
                    return None
        since = local.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    except (ValueError, OverflowError):
        return None
    nanos = (since.days * 86_400 + since.seconds) * 1_000_000_000 + since.microseconds * 1_000
    return nanos if -(1 << 63) <= nanos < 1 << 63 else None


def hex_id(text: Column, n: int) -> Column:
    """A lower-case id of ``n`` hexadecimal digits, not all zero; else null."""
    low = F.lower(text)
    return F.when(low.rlike(f"^[0-9a-f]{{{n}}}$") & ~low.rlike("^0+$"), low)


def content_id(prefix: str, *parts: Column) -> Column:
    """An id of its parts alone: each with its length, so that no two lists of parts are
    spelt alike, and null unlike the empty text."""
    spelt = [F.coalesce(F.concat(F.lit("+"), F.octet_length(p.cast("string")), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat(*spelt), 256), 1, 32))
