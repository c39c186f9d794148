"""Raw records to canonical logs and rejects, and their publication."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlens.functions import normalise as N
from emberlens.operators.explore import Window
from emberlens.plans import alive
from emberlens.plans.shared import remove
from emberlens.schema import LOGS, METRICS, SPANS
from emberlens.sources.files import EXCERPT, MOST_LINE_BYTES
from emberlens.sources.profiles import GENERIC, Profile
from emberlens.sources.segments import SEGMENT_ROWS, clustered, overlapping, revision_of, write_zones, zones
from emberlens.sources.segments import read as read_zones

SCHEMAS, TIMES = {"logs": LOGS, "metrics": METRICS, "spans": SPANS}, {"logs": "event_time", "metrics": "time", "spans": "start_time"}
MANIFEST = "dataset_id string, signal string, run string, path string, accepted long, undated long, rejected long, duplicates long"
_PARSED = "problem string, time_text string, severity_text string, message string, trace_raw string, span_raw string, attributes_json string, body_json string, flags array<string>, " + ", ".join(f"{g} string" for g in GENERIC)


def tag(value) -> dict:
    """A JSON value with its type; whole numbers past 64 bits are text."""
    if value is None:
        return {"t": "empty"}
    if isinstance(value, bool):
        return {"t": "bool", "v": value}
    if isinstance(value, int):
        return {"t": "int", "v": value} if -(1 << 63) <= value < 1 << 63 else {"t": "str", "v": str(value)}
    if isinstance(value, float):
        odd = value != value or value in (float("inf"), float("-inf"))
        return {"t": "double", "v": {"nan": "NaN", "inf": "+Inf", "-inf": "-Inf"}[str(value)] if odd else value}
    if isinstance(value, str):
        return {"t": "str", "v": value}
    if isinstance(value, list):
        return {"t": "array", "v": [tag(v) for v in value]}
    return {"t": "map", "v": {k: tag(value[k]) for k in sorted(value)}}


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _compact(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


#: Fixed value: brackets within brackets beyond which a text is no JSON that is read.
MOST_DEPTH = 127
_SEPARATE = re.compile(r'"(?:[^"\\]|\\.)*"?|[^\[\]{}"]+', re.S)


def _no_json(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def _too_deep(raw: str) -> bool:
    """Whether brackets, those in strings left out, lie deeper than ``MOST_DEPTH``."""
    if raw.count("[") + raw.count("{") <= MOST_DEPTH:
        return False
    depth = 0
    for c in _SEPARATE.sub("", raw):
        depth += 1 if c in "[{" else -1
        if depth > MOST_DEPTH:
            return True
    return False


def parse_record(raw: str | None, profile: Profile, strings_only: bool = False) -> dict:
    """One raw JSON record by a profile, whatever it holds; ``flat_record`` does the plain ones in SQL functions.

    Not JSON, too, are NaN and infinities, halves of surrogate pairs, and what nests deeper than ``MOST_DEPTH``. Whole numbers of
    any length are read; those past 64 bits stay as they are written.
    """
    if raw is None:
        return {}
    flags: list[str] = []

    def pairs(items):
        out = dict(items)
        if len(out) < len(items):
            flags.append("duplicate_key")
        return out

    try:
        if _too_deep(raw):
            raise ValueError("nested too deep")
        record = json.loads(raw, object_pairs_hook=pairs, parse_constant=_no_json, parse_int=lambda digits: int(digits) if len(digits) <= 20 else digits)
        if "\\u" in raw:
            _json(record).encode()  # an error for half a surrogate pair
    except (ValueError, RecursionError):
        return {"problem": "parse/invalid-json", "flags": flags}
    if not isinstance(record, dict):
        return {"message": _compact(record).split("\n")[0], "body_json": _json(tag(record)), "attributes_json": "{}", "flags": flags}

    def first(names):
        for n in names:
            if n in record and not isinstance(record[n], dict):
                return record.pop(n)
        return None

    taken = {key: first(getattr(profile, key)) for key in ("timestamp", "severity", "message", "trace_id", "span_id")}
    out = {g: first(profile.generic.get(g, ())) for g in GENERIC}
    out = {g: None if v is None else _compact(v) for g, v in out.items()}
    text = {k: None if v is None else _compact(v) for k, v in taken.items()}
    for key, n in (("trace_id", 32), ("span_id", 16)):
        if text[key] is not None and not _is_hex(text[key], n):
            record[f"{key}.raw"] = text[key]
            flags.append(f"invalid_{key}")
    attributes = {k: tag(_compact(v) if strings_only and v is not None else v) for k, v in sorted(record.items())}
    return out | {
        "time_text": text["timestamp"], "severity_text": text["severity"], "message": (text["message"] or "").split("\n")[0], "trace_raw": text["trace_id"],
        "span_raw": text["span_id"], "attributes_json": _json(attributes), "body_json": None if taken["message"] is None else _json(tag(taken["message"])), "flags": flags,
    }


def _is_hex(text: str, n: int) -> bool:
    return len(text) == n and set(text.lower()) <= set("0123456789abcdef") and set(text) != {"0"}


#: Fixed patterns: what a flat record is, and its pairs. Strings have no escapes but those that are spelt alike by every
#: writer, numbers are whole ones of 64 bits or short decimals.
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\["\\bfnrt][^"\\\x00-\x1f]*+)*+"'
_VALUE = rf"{_STRING}|-?[1-9][0-9]{{0,17}}|0|-?(?:0|[1-9][0-9]{{0,9}})\.(?:0|[0-9]{{0,3}}[1-9])|true|false|null"
_PAIR = rf'"([^"\\\x00-\x1f]*+)"[ \t]*+:[ \t]*+({_VALUE})(?=[ \t]*+[,}}])'
_FLAT = rf"\A[ \t]*+\{{[ \t]*+(?:{_PAIR}[ \t]*+(?:,[ \t]*+(?=\")|(?=\}})))*+\}}[ \t\r]*+\z"
#: Characters up to which a record is matched as a whole.
_MOST_FLAT = 8_192


def flat_pairs(raw: Column) -> Column:
    """A flat record as a map of names to values as they are written; null for all other records."""
    plain = F.when((F.length(raw) <= _MOST_FLAT) & raw.rlike(_FLAT), raw)
    names, values = F.regexp_extract_all(plain, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(plain, F.lit(_PAIR), F.lit(2))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, values))


def _unquoted(value: Column) -> Column:
    """A written value's text; null of null."""
    text = F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")
    return F.when(value.startswith('"'), text).when(value != "null", value)


def _tagged(value: Column, strings_only: bool) -> Column:
    kind = F.when(value.startswith('"'), "str")
    for name, of in (("bool", value.isin("true", "false")), ("double", value.contains(".")), ("int", F.lit(True))):
        kind = kind.when(of, name)
    written = value
    if strings_only:
        kind, written = F.lit("str"), F.when(value.startswith('"'), value).otherwise(F.concat(F.lit('"'), value, F.lit('"')))
    return F.when(value == "null", F.lit('{"t":"empty"}')).otherwise(F.concat(F.lit('{"t":"'), kind, F.lit('","v":'), written, F.lit("}")))


_FIELDS = ("timestamp", "severity", "message", "trace_id", "span_id")


def flat_record(rows: DataFrame, profile: Profile, strings_only: bool = False) -> DataFrame:
    """``rows`` with the columns of ``parse_record`` from ``pairs``, in SQL functions. The first of a field's
    candidates that is there wins; one that an earlier field took is not there any more. Each step is a
    projection of its own, so that nothing is spelt out twice."""
    candidates = {**{k: getattr(profile, k) for k in _FIELDS}, **{g: tuple(profile.generic.get(g, ())) for g in GENERIC}}
    pairs, before = F.col("pairs"), []
    for key, names in candidates.items():
        found = F.lit(None).cast("string")
        for name in reversed(names):
            there = F.map_contains_key(pairs, F.lit(name))
            for other in before:
                if name in candidates[other]:
                    there = there & ~F.col(f"f_{other}").eqNullSafe(F.lit(name))
            found = F.when(there, F.lit(name)).otherwise(found)
        rows = rows.withColumn(f"f_{key}", found)
        before.append(key)
    rows = rows.withColumns({f"w_{k}": F.when(F.col(f"f_{k}").isNotNull(), F.try_element_at(pairs, F.col(f"f_{k}"))) for k in candidates})
    rows = rows.withColumns({f"t_{k}": _unquoted(F.col(f"w_{k}")) for k in candidates})
    ids = (("trace_id", 32), ("span_id", 16))
    rows = rows.withColumns({f"bad_{k}": F.col(f"t_{k}").isNotNull() & N.hex_id(F.col(f"t_{k}"), n).isNull() for k, n in ids})
    pair = lambda k: F.struct(F.lit(f"{k}.raw").alias("key"), F.when(F.col(f"w_{k}").startswith('"'), F.col(f"w_{k}")).otherwise(F.concat(F.lit('"'), F.col(f"w_{k}"), F.lit('"'))).alias("value"))
    raw_ids = F.filter(F.array(*[F.when(F.col(f"bad_{k}"), pair(k)) for k, _ in ids]), lambda e: e.isNotNull())
    rows = rows.withColumns({"raw_ids": raw_ids, "used": F.array(*[F.col(f"f_{k}") for k in candidates])})
    own = F.filter(F.map_entries(pairs), lambda e: ~F.coalesce(F.array_contains("used", e["key"]), F.lit(False)) & ~F.exists("raw_ids", lambda r: r["key"] == e["key"]))
    rows = rows.withColumn("entries", F.array_sort(F.concat(own, "raw_ids")))
    attributes = F.transform("entries", lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), _tagged(e["value"], strings_only)))
    out = {f"p_{g}": F.col(f"t_{g}") for g in GENERIC} | {
        "p_problem": F.lit(None).cast("string"), "p_time_text": F.col("t_timestamp"), "p_severity_text": F.col("t_severity"),
        "p_message": F.split_part(F.coalesce("t_message", F.lit("")), F.lit("\n"), F.lit(1)), "p_trace_raw": F.col("t_trace_id"), "p_span_raw": F.col("t_span_id"),
        "p_attributes_json": F.concat(F.lit("{"), F.array_join(attributes, ","), F.lit("}")), "p_body_json": F.when(F.col("t_message").isNotNull(), _tagged(F.col("w_message"), False)),
        "p_flags": F.filter(F.array(*[F.when(F.col(f"bad_{k}"), F.lit(f"invalid_{k}")) for k, _ in ids]), lambda x: x.isNotNull()),
    }
    return rows.withColumns(out)


def _time(text: Column, profile: Profile) -> Column:
    if profile.time_format == "rfc3339":
        return N.rfc3339_nanos(text)
    if profile.time_format.startswith("epoch_"):
        return N.epoch_nanos(text, profile.time_format[6:])
    return N.local_nanos(text, profile.time_format, profile.timezone)


def _zone_assumed(text: Column, profile: Profile) -> Column:
    """Whether a time that was read lacks a zone of its own."""
    if profile.time_format.startswith("epoch_"):
        return F.lit(False)
    if profile.time_format == "rfc3339":
        return ~text.rlike(r"(?:[Zz]|[+-][0-9]{2}:[0-9]{2})$")
    return F.lit("%z" not in profile.time_format)


def normalised(records: DataFrame, profile: Profile, dataset_id: str, source_id: str, strings_only: bool = False) -> DataFrame:
    """Canonical logs of ``records(origin_id, raw[, places])`` with ``reason``, ``message``, ``excerpt`` and ``retryable``,
    which are null for rows that are no rejects.

    Flat records are read by SQL functions; Python sees the others alone: nested values,
    repeated names, rare escapes and numbers, and what is no JSON. A time that can't be read
    keeps its record, undated and flagged. Ids that aren't hexadecimal become attributes.
    Broken JSON is a reject; so are a line that is too large, and a last line that was cut off, which may be
    tried again.
    """
    names = [c.split()[0] for c in _PARSED.split(", ")]

    def parse(raws: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_record(r, profile, strings_only) for r in raws]).reindex(columns=names).astype(object).where(lambda d: d.notna(), None)

    has = set(records.columns)
    place = {c: F.col(c) if c in has else F.lit(None).cast("long") for c in ("record_number", "line_start", "byte_start", "byte_end")}
    large = F.col("large") if "large" in has else F.octet_length("raw") > MOST_LINE_BYTES
    flat = records.select(
        "origin_id", "raw", *[c.alias(n) for n, c in place.items()], (F.col("ended") if "ended" in has else F.lit(True)).alias("ended"), F.coalesce(large, F.lit(False)).alias("large"),
        (F.col("replaced") if "replaced" in has else F.lit(0).cast("long")).alias("replaced"), flat_pairs(F.col("raw")).alias("pairs"),
    )
    odd = F.when(F.col("pairs").isNull() & ~F.col("large"), F.col("raw"))
    both = flat_record(flat.withColumn("odd", F.pandas_udf(parse, _PARSED)(odd)), profile, strings_only)
    is_flat = F.col("pairs").isNotNull()
    p = both.select(
        "origin_id", "raw", "ended", "large", "replaced", *place, *[F.when(is_flat, F.col(f"p_{n}")).otherwise(F.col(f"odd.{n}")).alias(f"p_{n}") for n in names]
    )
    time = _time(F.col("p_time_text"), profile)
    number = N.severity_number(F.col("p_severity_text"))
    one = lambda name, when: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    assumed = time.isNotNull() & _zone_assumed(F.col("p_time_text"), profile)
    flags = F.concat(
        F.coalesce("p_flags", F.array().cast("array<string>")), one("timestamp_missing", F.col("p_time_text").isNull()), one("timestamp_unparsed", F.col("p_time_text").isNotNull() & time.isNull()),
        one("timezone_assumed", assumed), one("severity_unmapped", F.col("p_severity_text").isNotNull() & number.isNull()), one("invalid_utf8", F.col("replaced") > 0),
    )
    zone = F.when(assumed, F.to_json(F.struct(F.lit(profile.timezone).alias("zone"), N.precision(F.col("p_time_text")).alias("precision"))))
    raw_hash = F.sha2("raw", 256)
    columns = {
        "event_time": time, "original_timestamp_text": F.col("p_time_text"), "timezone_assumption_json": zone, "severity_text": F.col("p_severity_text"), "severity_number": number,
        "body_json": F.col("p_body_json"), "display_message": F.col("p_message"), "trace_id": N.hex_id(F.col("p_trace_raw"), 32), "span_id": N.hex_id(F.col("p_span_raw"), 16),
        "attributes_json": F.col("p_attributes_json"), "dropped_attributes_count": F.lit(0).cast("long"), "dataset_id": F.lit(dataset_id), "source_id": F.lit(source_id),
        "origin_id": F.col("origin_id"), "raw_hash": raw_hash,
        "provenance_json": F.to_json(F.struct(flags.alias("flags"), F.lit(profile.name).alias("profile"), N.precision(F.col("p_time_text")).alias("precision"))),
        **{g: F.col(f"p_{g}") for g in GENERIC}, **{n: F.col(n) for n in place},
    }
    columns["record_id"] = N.content_id("log", time, F.col("p_severity_text"), F.col("p_message"), F.col("p_attributes_json"), raw_hash, F.col("record_number"), F.col("byte_start"), F.lit(profile.name), F.lit(profile.version))
    bad = F.col("large") | F.col("p_problem").isNotNull()
    cut = bad & ~F.col("large") & ~F.col("ended")
    reason = F.when(F.col("large"), "parse/record-too-large").when(cut, "parse/truncated-record").otherwise(F.col("p_problem"))
    return p.select(
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOGS.fields], reason.alias("reason"),
        F.when(bad, _excerpt(F.col("raw"))).alias("excerpt"), F.when(bad, cut).alias("retryable"), F.lit(f"{profile.name}/{profile.version}").alias("profile"),
    )


def _excerpt(raw: Column) -> Column:
    """The first ``EXCERPT`` bytes of a text as text."""
    return F.when(F.octet_length(raw) <= EXCERPT, raw).otherwise(F.decode(F.substring(F.encode(F.substring(raw, 1, EXCERPT), "UTF-8"), 1, EXCERPT), "UTF-8"))


_REASONS = {"parse/invalid-json": "the line is no JSON value", "parse/truncated-record": "the last line has no end and is no JSON value", "parse/record-too-large": "the line is larger than a record may be"}


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(logs, rejects)`` of ``normalised`` rows."""
    said = F.lit(None).cast("string")
    for reason, text in _REASONS.items():
        said = F.when(F.col("reason") == reason, F.lit(text)).otherwise(said)
    places = ("record_number", "line_start", "byte_start", "byte_end")
    rejects = rows.where("reason is not null").select("origin_id", *places, "reason", said.alias("message"), "excerpt", "profile", "retryable")
    return rows.where("reason is null").select(*LOGS.fieldNames()), rejects


def normalise(records: DataFrame, profile: Profile, dataset_id: str, source_id: str, strings_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(logs, rejects)`` of ``records``; see ``normalised``."""
    return split(normalised(records, profile, dataset_id, source_id, strings_only))


def deduplicated(logs: DataFrame) -> DataFrame:
    """The first row of each record id, by origin and record number."""
    order = ["origin_id", "record_number"] if "record_number" in logs.columns else ["origin_id"]
    first = F.row_number().over(W.partitionBy("record_id").orderBy(*order))
    return logs.withColumn("copy", first).where("copy = 1").drop("copy")


def publish_records(rows: DataFrame, warehouse: str, dataset_id: str, run: str | None = None, folder: str | None = None) -> dict:
    """Publishes ``normalised`` rows, which are computed once: logs and rejects are read from what that wrote."""
    run = run or uuid.uuid4().hex
    staged = f"{warehouse}/_staging/{run}"
    with alive.alive(rows.sparkSession, warehouse, run):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(staged)
        counts = _publish(*split(rows.sparkSession.read.schema(rows.schema).parquet(staged)), warehouse, dataset_id, "logs", run, folder)
        remove(rows.sparkSession, staged)
    return counts


def publish(rows: DataFrame, rejects: DataFrame, warehouse: str, dataset_id: str, signal: str = "logs", run: str | None = None, folder: str | None = None) -> dict:
    """Writes a dataset in files of ranges of time, their zones, its rejects, and then the
    manifest row that makes it visible; what has no such row isn't read. A run that is
    published again replaces what it wrote before."""
    run = run or uuid.uuid4().hex
    with alive.alive(rows.sparkSession, warehouse, run):
        return _publish(rows, rejects, warehouse, dataset_id, signal, run, folder)


def _publish(rows: DataFrame, rejects: DataFrame, warehouse: str, dataset_id: str, signal: str, run: str, folder: str | None) -> dict:
    spark, time, folder = rows.sparkSession, TIMES[signal], folder or run
    data, bad = f"{warehouse}/{signal}/{dataset_id}/{folder}", f"{warehouse}/rejects/{dataset_id}/{folder}"
    clustered(deduplicated(rows), time).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", SEGMENT_ROWS).parquet(data)
    rejects.write.mode("overwrite").option("compression", "zstd").parquet(bad)
    found = write_zones(spark, warehouse, dataset_id, signal, run, data, rows.schema, time)
    n = found.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("undated"), F.lit(0)).alias("undated")).first()
    counts = {"accepted": n["accepted"], "undated": n["undated"], "rejected": spark.read.schema(rejects.schema).parquet(bad).count(), "duplicates": rows.count() - n["accepted"]}
    row = [(dataset_id, signal, run, data, *counts.values())]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{warehouse}/manifest/{run}")
    return counts


def manifest(spark: SparkSession, warehouse: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{warehouse}/manifest")


def stable_run(*parts: object) -> str:
    """A run's id that depends on ``parts`` alone."""
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:32]


def published_runs(spark: SparkSession, warehouse: str, names: list[str] | None = None, signal: str = "logs") -> DataFrame:
    """The manifest's rows of a signal's datasets; an unknown name is an error."""
    rows = manifest(spark, warehouse).where(F.col("signal") == signal)
    rows = rows.where(F.col("dataset_id").isin(names)) if names else rows
    if names and (missing := set(names) - {r["dataset_id"] for r in rows.select("dataset_id").distinct().collect()}):
        raise ValueError(f"no published dataset {sorted(missing)}")
    return rows


def published(spark: SparkSession, warehouse: str, names: list[str] | None = None, signal: str = "logs", window: Window = Window()) -> DataFrame:
    """All rows of a signal's published datasets, columns by name; an unknown name is an error. With a window, the dated rows of it, from
    the files alone that can hold any."""
    runs = published_runs(spark, warehouse, names, signal)
    if window.bounded:
        time = F.col(TIMES[signal])
        return read_zones(spark, overlapping(zones(spark, runs, warehouse), window).collect(), SCHEMAS[signal]).where((time >= window.start) & (time < window.end))
    found = [r["path"] for r in runs.select("path").distinct().collect()]  # a row a run
    return spark.read.schema(SCHEMAS[signal]).parquet(*found) if found else spark.createDataFrame([], SCHEMAS[signal])


def orphans(spark: SparkSession, warehouse: str, signal: str = "logs") -> DataFrame:
    """``(path)`` of folders named by a run that have files but no manifest row: imports that broke off, safe to
    delete. Batches of streams aren't among them: one that broke off is written again when the stream goes on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{warehouse}/{signal}")
    runs = files.select(F.regexp_extract("path", r"/([0-9a-f]{32})/[^/]*$", 1).alias("run"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).where("run <> ''").distinct()
    return runs.join(manifest(spark, warehouse).select("run"), "run", "left_anti").select("path")


def sweep(spark: SparkSession, warehouse: str, living: alive.Living) -> list[str]:
    """Deletes what imports left that broke off: their staged rows, and data, rejects and zones without a manifest row. Those that
    still live are left alone. Returns the runs."""
    swept = set()
    for run, changed in alive.listed(spark, f"{warehouse}/_staging").items():
        if not living.has(run, changed):
            alive.delete(spark, f"{warehouse}/_staging/{run}")
            swept.add(run)
    made = {r["run"] for r in manifest(spark, warehouse).select("run").distinct().collect()} if alive.listed(spark, f"{warehouse}/manifest") else set()  # a row a run
    for kind in (*SCHEMAS, "rejects"):
        for dataset in alive.listed(spark, f"{warehouse}/{kind}"):
            for run, changed in alive.listed(spark, f"{warehouse}/{kind}/{dataset}").items():
                if re.fullmatch("[0-9a-f]{32}", run) and run not in made and not living.has(run, changed):
                    alive.delete(spark, f"{warehouse}/{kind}/{dataset}/{run}")
                    alive.delete(spark, f"{warehouse}/zones/{run}")
                    swept.add(run)
    return sorted(swept)


def revisions(spark: SparkSession, warehouse: str, names: list[str] | None = None) -> DataFrame:
    """``(dataset_id, revision)`` of the published logs as ``evidence.revision`` has it, from the zones alone: no row is read. Null
    where zones were written without hashes."""
    found = zones(spark, published_runs(spark, warehouse, names), warehouse)
    parts = found.groupBy("dataset_id").agg(F.sum("rows").alias("n"), F.sum("hash_sum").alias("a"), F.bit_xor("hash_xor").alias("b"), F.count_if(F.col("hash_xor").isNull()).alias("unknown"))
    return parts.select("dataset_id", F.when(F.col("unknown") == 0, revision_of("n", F.col("a").cast("decimal(38,0)"), "b")).alias("revision"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, modified, digest)`` of source files, to tell whether they changed."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", "length", F.unix_micros("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def raw_excerpt(spark: SparkSession, path: str, start: int, end: int, most: int = 65_536) -> bytes | None:
    """Bytes of a record's place in its original file, of a packed one as it is unpacked, or None if that is gone or shorter."""
    return excerpt(spark, path, start, end, most=most)[1]


def excerpt(spark: SparkSession, path: str, start: int | None, end: int | None, digest: str | None = None, most: int = 65_536) -> tuple[str, bytes | None]:
    """``(status, bytes)`` of a record's place in its original file: ``available``; ``changed`` if the file isn't that of
    ``digest`` or ends before the place; ``missing`` if there is none; ``unsupported`` for records without a place."""
    if start is None or end is None:
        return "unsupported", None
    packed = path.endswith(".gz")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return "missing", None
    part = F.col("content") if packed else F.substring("content", start + 1, min(end - start, most))
    row = spark.read.format("binaryFile").load(path).select("length", part.alias("part"), F.sha2("content", 256).alias("digest")).first()
    if digest is not None and row["digest"] != digest:
        return "changed", None
    if not packed:
        return ("available", bytes(row["part"])) if row["length"] >= end else ("changed", None)
    stream = gzip.GzipFile(fileobj=io.BytesIO(bytes(row["part"])))
    stream.seek(start)
    found = stream.read(end - start)
    return ("available", found[:most]) if len(found) == end - start else ("changed", None)
