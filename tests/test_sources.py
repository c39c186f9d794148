"""Readers, normalisation, OTLP and streaming on small files of their own."""

import csv
import gzip
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from emberlens.functions import normalise as N
from emberlens.functions import predicates as P
from emberlens.sources import files, ingest, otlp
from emberlens.sources.profiles import CSV, ELASTIC, JSONL, Profile
from emberlens.streaming import ingest as stream


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{path}"


def test_places_of_lines(spark, tmp_path):
    data = b'\xef\xbb\xbf{"a":1}\r\n\n{"b":"\xff"}\n{"c":'
    for name, body in (("x.jsonl", data), ("x.jsonl.gz", gzip.compress(data))):
        rows = sorted(files.placed_lines(spark, put(tmp_path / name, body)).collect(), key=lambda r: r["record_number"])
        assert [(r["record_number"], r["line_start"], r["byte_start"], r["byte_end"], r["ended"], r["replaced"]) for r in rows] == [(1, 1, 3, 10, True, 0), (2, 3, 13, 22, True, 1), (3, 4, 23, 28, False, 0)]


def test_places_of_many_splits(spark, tmp_path):
    rng, conf = random.Random(1), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    parts = [b"", b" \t", b"x" * 150, b"ab\r", b"\xffz", "é".encode()]
    bodies = {f"f{k}.jsonl": b"\xef\xbb\xbf" * (k % 2) + b"\n".join(rng.choice(parts) for _ in range((3, 800)[k // 2 % 2])) + b"\n" * (k % 3 == 0) for k in range(6)}
    for name, body in bodies.items():
        put(tmp_path / name, body)
    spark.conf.set(conf[0], "4k")
    spark.conf.set(conf[1], "1")
    try:
        got = {}
        for r in files.placed_lines(spark, f"file://{tmp_path}").collect():
            got.setdefault(r["origin_id"].rsplit("/", 1)[1], []).append(tuple(r)[1:-1])
    finally:
        for c in conf:
            spark.conf.unset(c)
    for name, body in bodies.items():
        at, want = 3 if body.startswith(b"\xef\xbb\xbf") else 0, []
        for i, line in enumerate(body[at:].split(b"\n"), 1):
            begin, at = at, at + len(line) + 1
            if line.strip():
                text = line.removesuffix(b"\r")
                want.append((len(want) + 1, i, begin, begin + len(text), text.decode("utf-8", "replace"), at <= len(body), text.count(b"\xff")))
        assert sorted(got.get(name, [])) == want, name


def test_lines_that_are_too_large(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_LINE_BYTES", 5_000)
    raw = '{"message":"' + "é" * 4_000 + '"}\n{"message":"b"}\n'
    logs, rejects = ingest.normalise(files.placed_lines(spark, put(tmp_path / "l.jsonl", raw)), JSONL, "d", "s")
    bad = rejects.collect()
    assert [(r["reason"], r["record_number"], r["retryable"]) for r in bad] == [("parse/record-too-large", 1, False)] and len(bad[0]["excerpt"].encode()) <= 4_100
    assert [r["display_message"] for r in logs.collect()] == ["b"] and bad[0]["message"]


def test_json_lines(spark, tmp_path):
    lines = [
        {"@timestamp": "2024-05-01T10:00:00.123456789+02:00", "level": "warn", "message": "first\nsecond", "trace_id": "A" * 32, "http": {"status": 500}, "n": 1, "big": 1 << 70, "x": None},
        {"time": "yesterday", "severity": "30", "msg": {"a": 1}, "trace_id": "nope"}, [1, 2],
    ]
    raw = "\n".join(json.dumps(x) for x in lines) + '\n{"k":1,"k":2}\n{broken}\n{"cut":'
    logs, rejects = ingest.normalise(files.placed_lines(spark, put(tmp_path / "a.jsonl", raw)), JSONL, "d", "s")
    a, b, c, d = sorted(logs.collect(), key=lambda r: r["record_number"])
    assert a["event_time"] == 1714550400123456789 and a["severity_number"] == 13 and a["display_message"] == "first" and a["trace_id"] == "a" * 32
    attributes = json.loads(a["attributes_json"])
    assert attributes["http"] == {"t": "map", "v": {"status": {"t": "int", "v": 500}}} and attributes["big"]["t"] == "str" and attributes["x"] == {"t": "empty"}
    assert b["event_time"] is None and b["severity_number"] is None and "trace_id.raw" in b["attributes_json"]
    assert set(json.loads(b["provenance_json"])["flags"]) == {"invalid_trace_id", "timestamp_unparsed", "severity_unmapped"}
    assert c["display_message"] == "[1,2]" and json.loads(d["attributes_json"])["k"]["v"] == 2 and "duplicate_key" in d["provenance_json"]
    assert sorted((r["reason"], r["retryable"]) for r in rejects.collect()) == [("parse/invalid-json", False), ("parse/truncated-record", True)]
    assert len({r["record_id"] for r in (a, b, c, d)}) == 4
    again, _ = ingest.normalise(files.placed_lines(spark, put(tmp_path / "a.jsonl", raw)), JSONL, "other", "s")
    assert {r["record_id"] for r in again.collect()} == {r["record_id"] for r in (a, b, c, d)}


FLAT = [
    '{"ts":"2024-01-01T00:00:00Z","level":"info","message":"a \\"b\\" c","n":-5,"x":12.5,"ok":true,"none":null}', '{ "time" : "2024-01-01T00:00:00", "message": "é\\nmore", "trace_id":"A1", "span_id": 7, "b":0, "a":"" }',
    '{}', '{"message":5}', '{"message":null,"msg":"taken"}', '{"trace_id":"' + "a" * 32 + '","timestamp":"x","ts":"y","severity":"WARN"}', '{"n":123456789012345678}', '{"msg":"tab\\t","trace_id.raw":"old","trace_id":"no"}',
]
ODD_RECORDS = ['{"k":1,"k":2}', '{"n":1e5}', '{"n":1.10}', '{"n":-0}', '{"s":"\\u00e9"}', '{"s":"\\/"}', '{"o":{"a":1}}', '{"l":[1]}', '{"n":12345678901234567890}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1,}', '{"a" 1}', "[1]", '"s"', "{"]


@pytest.mark.parametrize("profile, strings_only", [(JSONL, False), (ELASTIC, False), (CSV, True)])
def test_flat_records_are_read_as_by_the_parser(spark, profile, strings_only):
    rows = spark.createDataFrame([("o", x) for x in FLAT + ODD_RECORDS], "origin_id string, raw string")
    flat = ingest.flat_record(rows.withColumn("pairs", ingest.flat_pairs(F.col("raw"))), profile, strings_only).collect()
    assert [r["pairs"] is not None for r in flat] == [True] * len(FLAT) + [False] * len(ODD_RECORDS)
    for r in flat[: len(FLAT)]:
        want = ingest.parse_record(r["raw"], profile, strings_only)
        for key, value in want.items():
            assert r[f"p_{key}"] == value, (r["raw"], key)


def test_nested_objects_are_no_candidates(spark, tmp_path):
    raw = json.dumps({"log.level": "ERROR", "trace": {"id": "b" * 32}, "event.outcome": "failure", "message": "m"}) + "\n"
    logs, _ = ingest.normalise(files.placed_lines(spark, put(tmp_path / "e.jsonl", raw)), ELASTIC, "d", "s")
    row = logs.first()
    assert row["severity_number"] == 17 and row["trace_id"] is None and row["outcome"] == "failure"


def test_csv(spark, tmp_path):
    raw = '﻿timestamp,level,message,part\n2024-01-01T00:00:00Z,INFO,"a, b\nc",x\n2024-01-01T00:00:01Z,ERR,short\n2024-01-01T00:00:02Z,INFO,long,y,extra\n'
    rows = files.placed_csv(spark, put(tmp_path / "a.csv", raw))
    logs, rejects = ingest.normalise(rows, CSV, "d", "s", strings_only=True)
    got = sorted(logs.collect(), key=lambda r: r["record_number"])
    assert [r["display_message"] for r in got] == ["a, b", "short", "long"] and [r["severity_number"] for r in got] == [9, 17, 9]
    assert json.loads(got[2]["attributes_json"])["column_4"] == {"t": "str", "v": "extra"} and rejects.count() == 0


def test_publish_and_dedup(spark, tmp_path):
    raw = (json.dumps({"ts": "2024-01-01T00:00:00Z", "message": "m"}) + "\n") * 2 + "{bad\n"
    lines = files.placed_lines(spark, put(tmp_path / "p.jsonl", raw)).drop("record_number", "byte_start", "byte_end", "line_start")
    warehouse = f"file://{tmp_path}/w"
    assert ingest.publish(*ingest.normalise(lines, JSONL, "d", "s"), warehouse, "d") == {"accepted": 1, "undated": 0, "rejected": 1, "duplicates": 1}
    assert ingest.published(spark, warehouse, ["d"]).count() == 1


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-05-01T10:00:00Z", 1714557600 * 10**9), ("2024-05-01 10:00:00.5-01:30", 1714563000 * 10**9 + 5 * 10**8), ("2024-13-01T00:00:00Z", None), ("", None), (None, None),
        ("1969-12-31T23:59:59.999999999Z", -1),
    ],
)
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(N.rfc3339_nanos(F.col("t"))).first()[0] == want


def test_local_times():
    fmt = "%Y-%m-%d %H:%M"
    assert N.local_instant("2024-03-31 02:30", fmt, "Europe/Berlin") is None
    assert N.local_instant("2024-10-27 02:30", fmt, "Europe/Berlin") == 1729989000 * 10**9
    assert N.local_instant("2024-01-01 00:00", fmt, "+02:00") == 1704060000 * 10**9 and N.local_instant("x", fmt, "UTC") is None


def test_epochs_and_severities(spark):
    row = spark.createDataFrame([("1714557600.25", "emerg", " 24 ", "30", "odd")], "a string, b string, c string, d string, e string").select(N.epoch_nanos(F.col("a"), "s"), *[N.severity_number(F.col(c)) for c in "bcde"]).first()
    assert tuple(row) == (1714557600250000000, 23, 24, None, None)


def value(**kind):
    return {"key": "k", "value": kind}


def test_otlp_nested_values(spark):
    pair = lambda k, v: {"key": k, "value": v}
    deep = {"stringValue": "end"}
    for _ in range(12):
        deep = {"kvlistValue": {"values": [pair("d", {"arrayValue": {"values": [deep, {}]}})]}}
    pairs = [pair("m", {"kvlist_value": {"values": [pair("b", {"intValue": "-5"}), pair("a", {"doubleValue": "NaN"}), pair("b", {"bool_value": False})]}}), pair("none", None), pair("deep", deep), pair("e", {"arrayValue": {}})]
    bodies = [{"kvlistValue": {"values": [pair("x", {"stringValue": "y\nz"}), pair("h", {"stringValue": "cut \ud83d"})]}}, {"doubleValue": "-Infinity"}, {"stringValue": '"kvlistValue" {'}, None]
    lines = [json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": b, "attributes": pairs}]}]}]}) for b in bodies]
    lines.append('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"attributes":[]}]}]}]}')
    got = otlp.logs(spark.createDataFrame([("o", x) for x in lines], "origin_id string, raw string").coalesce(1), "d")[0].collect()
    found = json.loads(got[0]["attributes_json"])
    assert found["m"] == {"t": "map", "v": {"a": {"t": "double", "v": "NaN"}, "b": {"t": "bool", "v": False}}} and found["none"] == {"t": "empty"} and found["e"] == {"t": "array", "v": []}
    at = found["deep"]
    for _ in range(12):
        assert at["v"]["d"]["v"][1] == {"t": "empty"}
        at = at["v"]["d"]["v"][0]
    assert at == {"t": "str", "v": "end"} and got[4]["attributes_json"] == "{}"
    assert json.loads(got[0]["body_json"])["v"]["x"] == {"t": "str", "v": "y\nz"} and got[0]["display_message"] == '{"h":"cut ?","x":"y\\nz"}'
    assert json.loads(got[1]["body_json"]) == {"t": "double", "v": "-Inf"} and json.loads(got[2]["body_json"]) == {"t": "str", "v": '"kvlistValue" {'} and json.loads(got[3]["body_json"]) == {"t": "empty"}


def test_otlp(spark):
    span = {"traceId": "A" * 32, "spanId": "b" * 16, "name": "n", "kind": 2, "startTimeUnixNano": "10", "endTimeUnixNano": "0", "links": [{"traceId": "c" * 32, "spanId": "d" * 16}], "attributes": [value(intValue="5"), value(stringValue='q"x')]}
    bad = {"traceId": "0" * 32, "spanId": "b" * 16, "name": "z"}
    log = {"timeUnixNano": "5", "severityNumber": 17, "body": {"stringValue": "hello\nthere"}}
    gauge = {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "7", "asInt": "3"}, {"timeUnixNano": "8", "flags": 1}, {"timeUnixNano": "9"}]}}
    total = {"name": "s", "sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": [{"timeUnixNano": "7", "asDouble": 1.5}]}}
    envelopes = [
        {"resourceSpans": [{"resource": {"attributes": [value(stringValue="svc")]}, "scopeSpans": [{"scope": {"name": "i"}, "spans": [span, bad]}]}]},
        {"resource_logs": [{"scope_logs": [{"log_records": [log, {"timeUnixNano": "99999999999999999999"}]}]}]},
        {"resourceMetrics": [{"scopeMetrics": [{"metrics": [gauge, total, {"name": "u"}]}]}]}, {"other": 1},
    ]
    lines = spark.createDataFrame([("f", json.dumps(e)) for e in envelopes], "origin_id string, raw string")
    rows, rejects = otlp.spans(lines, "d")
    s = rows.first()
    assert rows.count() == 1 and s["trace_id"] == "a" * 32 and s["end_time"] is None and json.loads(s["links_json"]) == [{"trace_id": "c" * 32, "span_id": "d" * 16}]
    assert json.loads(s["attributes_json"]) == {"k": {"t": "str", "v": 'q"x'}} and [r["reason"] for r in rejects.collect()] == ["otlp/invalid-trace-id"]
    rows, rejects = otlp.logs(lines, "d")
    assert [(r["event_time"], r["severity_number"], r["display_message"]) for r in rows.collect()] == [(5, 17, "hello")] and rejects.count() == 1
    rows, rejects = otlp.metric_points(lines, "d")
    got = sorted(str((r["metric_name"], r["metric_type"], r["temporality"], r["value_int"], r["value_double"])) for r in rows.collect())
    assert got == ["('g', 'gauge', None, 3, None)", "('g', 'gauge', None, None, nan)", "('s', 'sum', 'delta', None, 1.5)"]
    assert sorted(r["reason"] for r in rejects.collect()) == ["otlp/point-without-value", "otlp/unknown-metric-type"]
    assert otlp.envelope_rejects(lines).count() == 1


def read_again(df):
    """How often a plan's most loaded operator reads JSON texts by paths."""
    return max(line.count("get_json_object") for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_otlp_records_are_read_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    rows, _ = otlp.logs(spark.createDataFrame([("o", "{}")], "origin_id string, raw string"), "d")
    try:
        assert read_again(rows.select("event_time", "severity_number", "display_message", "attributes_json")) < 100
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_otlp_attributes_are_tagged_once(spark):
    line = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"attributes":[{"key":"a","value":{"kvlistValue":{"values":[{"key":"b","value":{"intValue":"5"}}]}}}]}]}]}]}'
    rows, _ = otlp.logs(spark.createDataFrame([("o", line)], "origin_id string, raw string"), "d")
    found = rows.where(P.attribute_compare(("a", "b"), ">=", 5)).select(P.attribute("a", "b").alias("b"), P.attribute_type("a").alias("t"))
    assert found._jdf.queryExecution().executedPlan().toString().count("_nested_list(") == 1 and tuple(found.first()) == ("5", "map")


def test_otlp_points_are_read_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    rows, _ = otlp.metric_points(spark.createDataFrame([("o", "{}")], "origin_id string, raw string"), "d")
    try:
        assert read_again(rows.select("metric_name", "metric_type", "temporality", "time", "value_int", "value_double")) == 0
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.jsonl", json.dumps({"ts": "2024-01-01T00:00:00Z", "message": "m", "level": "info"}) + "\n\n{bad\n")
    for name in ("b", "c"):
        stream.start(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/w", "d", Profile("p", ("ts",), ("level",), ("message",)), once=True).awaitTermination()
        put(tmp_path / "in" / f"{name}.jsonl", json.dumps({"message": name}) + "\n")
    warehouse = f"file://{tmp_path}/w"
    assert sorted(r["display_message"] for r in ingest.published(spark, warehouse, ["d"]).collect()) == ["b", "m"]
    profile = Profile("p", ("ts",), ("level",), ("message",))
    again = stream.import_batch(spark, [f"file://{tmp_path}/in/a.jsonl"], f"file://{tmp_path}/in", warehouse, "d", profile, 0)  # as if the batch were tried again
    assert again == {"accepted": 1, "undated": 0, "rejected": 1, "duplicates": 0}
    assert ingest.published(spark, warehouse).count() == 2 and ingest.orphans(spark, warehouse).count() == 0
    broken = f"{warehouse}/logs/d/{'a' * 32}"
    ingest.published(spark, warehouse).limit(1).write.parquet(broken)  # an import that broke off before its manifest row
    assert [r["path"][-32:] for r in ingest.orphans(spark, warehouse).collect()] == ["a" * 32] and ingest.published(spark, warehouse).count() == 2
    ingest.remove(spark, broken)
    rows = spark.read.parquet(f"file://{tmp_path}/w/logs/d").collect()
    assert sorted(r["display_message"] for r in rows) == ["b", "m"]
    assert spark.read.parquet(f"file://{tmp_path}/w/rejects/d").count() == 1


ODD_LINES = {
    '{"message":"cut \\ud83d"}': None, '{"message":"pair \\ud83d\\ude00"}': "pair 😀", '{"v":NaN,"message":"n"}': None, '{"v":-Infinity}': None,
    '{"message":"long","v":' + "9" * 5_000 + "}": "long", "[" * 100_000: None, '{"message":"deep","v":' + "[" * 126 + "]" * 126 + "}": "deep",
    '{"message":"deeper","v":' + "[" * 500 + "]" * 500 + "}": None, '{"message":"' + "[" * 300 + '","v":[]}': "[" * 300, '{"ts":"9999-12-31T23:59:59Z","message":"never"}': "never",
    '{"ts":"2263-01-01T00:00:00Z","message":"late"}': "late", '{"message":"fine"}': "fine",
}


def test_odd_lines_end_no_import(spark, tmp_path):
    raw = "\n".join(ODD_LINES).encode() + b"\n"
    want = sorted(m for m in ODD_LINES.values() if m is not None)
    logs, rejects = ingest.normalise(files.placed_lines(spark, put(tmp_path / "odd.jsonl", raw)), JSONL, "d", "s")
    rows = logs.collect()
    assert sorted(r["display_message"] for r in rows) == want and rejects.count() == len(ODD_LINES) - len(want)
    flagged = {r["display_message"] for r in rows if "timestamp_unparsed" in r["provenance_json"]}
    assert flagged == {"never", "late"} and all(r["event_time"] is None for r in rows)
    assert next(r["attributes_json"] for r in rows if r["display_message"] == "long") == '{"v":{"t":"str","v":"' + "9" * 5_000 + '"}}'


@pytest.mark.parametrize(("unit", "text", "want"), [("ms", "99999999999999999", None), ("s", "9" * 28, None), ("s", "9223372036.854775807", 9223372036854775807), ("s", "9223372037", None), ("ns", "-1", -1), ("s", "1e400", None)])
def test_epochs_beyond_64_bits(spark, unit, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(N.epoch_nanos(F.col("t"), unit)).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("9999-12-31 23:59:59", None), ("2262-04-11 23:47:16", 9223372036000000000), ("2262-04-11 23:47:17", None), ("0001-01-01 00:00:00", None), (None, None), ("x", None)])
def test_local_times_beyond_64_bits(text, want):
    assert N.local_instant(text, "%Y-%m-%d %H:%M:%S", "UTC") == want
    assert N.local_instant(text, "%Y-%m-%d %H:%M:%S", "-14:00") == (None if want is None else (want + 14 * 3_600_000_000_000 if want + 14 * 3_600_000_000_000 < 2**63 else None))


def test_long_cells_of_csv(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_LINE_BYTES", 300_000)
    raw = "message,b\nfine,1\n" + "x" * 140_000 + ",2\n" + '"' + "y\n" * 200_000 + '",3\nlast,4\n'
    rows = files.placed_csv(spark, put(tmp_path / "long.csv", raw.encode()))
    logs, rejects = ingest.normalise(rows, CSV, "d", "s", strings_only=True)
    assert sorted((r["record_number"], len(r["display_message"])) for r in logs.collect()) == [(1, 4), (2, 140_000), (4, 4)]
    assert [(r["record_number"], r["reason"]) for r in rejects.collect()] == [(3, "parse/record-too-large")]


@pytest.mark.parametrize(("header", "most"), [(True, 1 << 20), (False, 40)])
def test_csv_by_splits(spark, tmp_path, monkeypatch, header, most):
    """Records that span splits, quotes that nothing ends and odd line breaks: the rows of a reader of whole files, by tasks that read little."""
    rng, want = random.Random(3), set()
    monkeypatch.setattr(files, "_PIECE", 5)
    monkeypatch.setattr(files, "MOST_LINE_BYTES", most)
    monkeypatch.setattr(files, "EXCERPT", 12)
    for i in range(16):
        few = ["a", "b", ",", "\n", "\n", "é", "\x1f", "\ufffd"] + ['"'] * rng.choice([0, 1, 1, 3]) + ["\r", "\r\n"] * rng.choice([0, 0, 1])
        body = ("\ufeff" if i % 9 == 0 else "") + "".join(rng.choice(few) for _ in range(rng.choice([0, 3, 30, 150])))
        body = body.encode() + (b"\xe9\n" if i % 5 == 0 else b"")
        (tmp_path / f"f {i}+%41.csv").write_bytes(body)
        rows, names, number, line = csv.reader(io.TextIOWrapper(io.BytesIO(body), "utf-8-sig", "replace", newline="")), None, 0, 1
        for cells in rows:
            begin, line = line, rows.line_num + 1
            if header and names is None:
                names = cells
            elif cells:
                number += 1
                named, joined = {(names[j] if names and j < len(names) else f"column_{j}"): c for j, c in enumerate(cells)}, "\x1f".join(cells)
                large = len(joined.encode()) > most
                want.add((i, number, begin, joined[:12] if large else json.dumps(named, ensure_ascii=False), joined[:12] if large else joined, large))
    conf = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in zip(conf, ("24", "1")):
            spark.conf.set(c, v)
        rows = files.placed_csv(spark, f"file://{tmp_path}", header=header)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    got = [(int(r[0].split("/f ")[1].removesuffix("+%41.csv")), *r[1:]) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
