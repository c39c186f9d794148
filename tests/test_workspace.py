"""From files to a bundle through the one object."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from emberlens.case import evidence, report
from emberlens.functions import predicates as P
from emberlens.operators import explore, metrics, traces
from emberlens.plans import runs
from emberlens.sources import files, ingest
from emberlens.workspace import Workspace


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    rows = [{"ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "level": "ERROR" if i % 4 == 0 else "INFO", "message": f"job {i} took {i}ms", "n": i} for i in range(120)]
    (root / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "{bad}\n")
    (root / "b.csv").write_text("timestamp,level,message\n2024-01-01T01:00:00Z,WARN,from csv\n")
    span = {"traceId": "a" * 32, "spanId": "b" * 16, "name": "n", "startTimeUnixNano": "10", "endTimeUnixNano": "20"}
    point = {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "7", "asInt": "3"}]}}
    (root / "o.jsonl").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}) + "\n" + json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [point]}]}]}) + "\n")
    w = Workspace(spark, f"file://{root}/w")
    assert w.import_json_lines(f"file://{root}/a.jsonl", "a") == {"accepted": 120, "undated": 0, "rejected": 1, "duplicates": 0}
    assert w.import_csv(f"file://{root}/b.csv", "b")["accepted"] == 1
    assert w.import_otlp(f"file://{root}/o.jsonl", "o", "spans")["accepted"] == 1 and w.import_otlp(f"file://{root}/o.jsonl", "o", "metrics")["accepted"] == 1
    w.root = root
    return w


def test_exploring(ws):
    where = P.severity(">=", "WARN")
    n = ws.counts(where).first()["matching"]
    assert n == 31 == ws.facets({"s": explore.severity_value()}, where).agg(F.sum("n")).first()[0] == ws.histogram(where).agg(F.sum("n")).first()[0]
    assert ws.page(where, limit=5).count() == 6 and ws.page().first()["display_message"] == "from csv"
    assert ws.fields().where("path = 'n'").first()["types"] == "int"
    assert Workspace(ws.spark, ws.warehouse, ["b"]).counts().first()["matching"] == 1
    with pytest.raises(ValueError):
        Workspace(ws.spark, ws.warehouse, ["none"]).logs()
    assert traces.nodes(ws.spans()).count() == 1 and metrics.rollup(ws.metric_points(), "g", 10).first()["total"] == 3.0


def test_runs(ws):
    rows, stale = ws.result(ws.patterns())
    assert rows.where("template = 'job <num> took <dur>'").first()["n"] == 120 and not stale
    start = 1704067200 * explore.SECOND
    rows, _ = ws.result(ws.compare("severity", (start, start + 60 * explore.SECOND), (start + 60 * explore.SECOND, start + 120 * explore.SECOND)))
    assert rows.count() == 2
    with pytest.raises(Exception):
        runs.run("bad", ws.logs(), {}, lambda x: x.select(F.raise_error(F.lit("no"))), ws.warehouse)
    assert {r["state"] for r in runs.states(ws.spark, ws.warehouse).collect()} == {"completed", "failed"}
    assert runs.config_id({"a": 1, "b": 2}) == runs.config_id({"b": 2, "a": 1}) != runs.config_id({"a": 2, "b": 1})
    other = ws.logs().limit(3)
    assert runs.frozen(ws.logs()) == runs.frozen(ws.logs().repartition(5)) != runs.frozen(other)


def test_export_and_files(ws):
    path = f"file://{ws.root}/out"
    assert ws.export_json_lines(path, most_rows=10)
    lines = [json.loads(r["value"]) for r in ws.spark.read.text(path).collect()]
    assert len(lines) == 10 and lines[0]["message"] == "from csv" and lines[0]["timestamp"] == "2024-01-01T01:00:00Z" and len(lines[0]) == 15
    with pytest.raises(Exception):
        ws.export_json_lines(path)
    row = files.placed_lines(ws.spark, f"file://{ws.root}/a.jsonl").where("record_number = 3").first()
    assert ingest.raw_excerpt(ws.spark, f"file://{ws.root}/a.jsonl", row["byte_start"], row["byte_end"]).decode() == row["raw"]
    assert ingest.raw_excerpt(ws.spark, f"file://{ws.root}/b.csv", 0, 10**6) is None
    packed = ws.root / "p.jsonl.gz"
    packed.write_bytes(gzip.compress((ws.root / "a.jsonl").read_bytes()))
    place = (f"file://{packed}", row["byte_start"], row["byte_end"])
    assert ingest.raw_excerpt(ws.spark, *place).decode() == row["raw"]
    digest = ingest.fingerprints(ws.spark, f"file://{packed}").first()["digest"]
    assert [ingest.excerpt(ws.spark, *p, d)[0] for p, d in ((place, digest), (place, "other"), ((place[0] + "x", 0, 1), None), ((place[0], None, None), None), ((place[0], 0, 10**6), None))] == ["available", "changed", "missing", "unsupported", "changed"]
    assert ingest.fingerprints(ws.spark, f"file://{ws.root}/b.csv").first()["length"] == (ws.root / "b.csv").stat().st_size
    assert ingest.orphans(ws.spark, ws.warehouse).count() == 0
    ws.logs().limit(1).write.parquet(f"{ws.warehouse}/logs/x/{'0' * 32}")
    assert [r["path"][-32:] for r in ingest.orphans(ws.spark, ws.warehouse).collect()] == ["0" * 32]


def test_case(ws):
    logs = ws.logs()
    ids = [r["record_id"] for r in logs.orderBy("record_id").limit(3).collect()]
    start = 1704067200 * explore.SECOND
    group, share = evidence.pin_group(logs, "e2", "severity_text", "ERROR", None, explore.Window())
    pins = evidence.pin_selection(logs, "e1", ids).unionByName(group).unionByName(evidence.pin_interval(logs, "e3", None, start, start + 30 * explore.SECOND))
    assert share == 30 * 10_000 // 121
    assert {r["state"] for r in ws.verify(evidence.with_revisions(pins, logs)).collect()} == {"verified"}
    assert "reports/report.md" in report.open_bundle(ws.bundle("case", pins))
    files_now = logs.select("origin_id").distinct()
    state = lambda pins, sources: {r["evidence_id"]: r["state"] for r in evidence.verify(pins, logs, sources=sources).collect()}
    first = evidence.pin_selection(logs, "e1", ids)
    assert state(first, files_now) == {"e1": "verified"} and state(first, files_now.limit(0)) == {"e1": "canonical_available_source_unavailable"}
    nothing = first.withColumn("record_ids", F.array(F.lit("none")))
    assert state(nothing, files_now) == {"e1": "broken"} and state(nothing, files_now.limit(0)) == {"e1": "source_missing"}
    assert state(first.withColumn("kind", F.lit("hologram")), None) == {"e1": "unsupported_reference_version"}
    small = report.open_bundle(report.bundle("case", pins, evidence.timeline(pins, logs), ws.verify(pins), report.subset(pins, logs), {"hypotheses": ["h"]}, most=2))
    rows = json.loads(small["manifest.json"])["rows"]
    assert rows["evidence"] == {"rows": 2, "cut": 1} and rows["data"]["rows"] == 2 and rows["data"]["cut"] > 0 and "investigation/hypotheses.json" in small
    assert report.write_subset(first, logs, f"file://{ws.root}/subset") == 3


def test_budget(spark):
    assert runs.within(spark, 60, lambda: spark.range(10).count()) == 10
    with pytest.raises(Exception):
        runs.within(spark, 1, lambda: spark.range(0, 1 << 40, 1, 8).selectExpr("sum(hash(id, id % 7))").collect())
