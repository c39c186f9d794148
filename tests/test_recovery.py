"""Revisions without a scan, results with a digest, and what is left of runs that broke off."""

import time

import pytest
from pyspark.sql import functions as F

from emberlens.case import evidence
from emberlens.operators import explore
from emberlens.plans import alive, runs
from emberlens.sources import ingest
from emberlens.workspace import Workspace


@pytest.fixture
def ws(spark, tmp_path):
    lines = [f'{{"ts":"2024-01-01T00:00:{i % 60:02d}Z","level":"INFO","message":"job {i}"}}' for i in range(90)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + '\n{"message":"undated"}\n')
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:40]) + "\n")
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.import_json_lines(f"file://{tmp_path}/a.jsonl", "a")
    w.import_json_lines(f"file://{tmp_path}/b.jsonl", "b")
    w.root = tmp_path
    return w


def test_revisions(ws):
    known = ingest.revisions(ws.spark, ws.warehouse)
    assert {r["dataset_id"]: r["revision"] for r in known.collect()} == {r["dataset_id"]: r["revision"] for r in evidence.revision(ws.logs()).collect()} and ws.revisions() == runs.frozen(ws.logs())
    assert all("/zones/" in f or "/manifest/" in f for f in known.inputFiles())
    pins = evidence.pin_selection(ws.logs().where("dataset_id = 'a'"), "e", [r["record_id"] for r in ws.logs().where("dataset_id = 'a'").limit(3).collect()])
    assert ws.verify(pins).collect() == evidence.verify(pins, ws.logs()).collect()
    before = ws.revisions()
    ws.import_json_lines(f"file://{ws.root}/b.jsonl", "c")
    assert ws.revisions() != before == Workspace(ws.spark, ws.warehouse, ["a", "b"]).revisions()
    assert Workspace(ws.spark, ws.warehouse, ["b"]).revisions() != before


def test_results_have_order_and_digest(ws):
    start = 1704067200 * explore.SECOND
    one = ws.patterns(window=explore.absolute(start, start + 30 * explore.SECOND))
    rows, stale = ws.result(one)
    assert rows.count() == 1 and not stale and runs.whole(ws.spark, ws.warehouse, one)
    some = ws.logs().select("record_id", "event_time", "display_message")
    assert runs.digest(some.repartition(1)) == runs.digest(some.repartition(8)) != runs.digest(some.limit(90))
    assert runs.digest(some.withColumn("event_time", F.lit(None).cast("long"))) != runs.digest(some) and runs.digest(some.limit(0))[0] == 0
    ws.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    name = runs.run("rows", ws.logs(), {}, lambda x: x.select("record_id", "event_time"), ws.warehouse, ["record_id"], ws.revisions())
    ws.spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    path = runs.states(ws.spark, ws.warehouse).where(F.col("run_id") == name).first()["path"]
    spans = ws.spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).orderBy("a").collect()
    assert len(spans) > 1 and all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]))
    ws.import_json_lines(f"file://{ws.root}/a.jsonl", "d")
    assert ws.result(one)[1]
    ws.spark.read.parquet(path).limit(1).write.mode("append").parquet(path)
    assert not runs.whole(ws.spark, ws.warehouse, name)


def test_recovery(ws):
    logs, run = ws.logs(), "0" * 32
    n = logs.count()
    logs.limit(2).write.parquet(f"{ws.warehouse}/_staging/{'1' * 32}")  # broke off while it staged
    logs.limit(2).write.parquet(f"{ws.warehouse}/logs/x/{run}")  # broke off before its manifest row
    logs.limit(2).write.parquet(f"{ws.warehouse}/rejects/x/{run}")
    logs.limit(2).write.parquet(f"{ws.warehouse}/zones/{run}")
    logs.limit(2).write.parquet(f"{ws.warehouse}/derived/n/run-dead")
    runs._note(ws.spark, ws.warehouse, "run-dead", "n", "c", "{}", "running", time.time(), f"{ws.warehouse}/derived/n/run-dead", None, None, None)
    runs._note(ws.spark, ws.warehouse, "run-lives", "n", "c", "{}", "running", time.time(), None, None, None, None)
    alive.touch(ws.spark, f"{ws.warehouse}/_alive/run-dead")
    done = ws.compare("severity", (0, 1), (1, 2))
    with alive.alive(ws.spark, ws.warehouse, "run-lives", 0.2):
        assert ws.recover() == {"imports": [], "analyses": []}  # all of it is young
        time.sleep(4)
        assert ws.recover(lease=3) == {"imports": [run, "1" * 32], "analyses": ["run-dead"]}
        assert ws.recover(lease=3) == {"imports": [], "analyses": []}
    state = {r["run_id"]: (r["state"], r["error"]) for r in runs.states(ws.spark, ws.warehouse).collect()}
    assert state == {"run-dead": ("failed", "broke off"), "run-lives": ("running", None), done: ("completed", None)}
    for gone in (f"_staging/{'1' * 32}", f"logs/x/{run}", f"rejects/x/{run}", f"zones/{run}", "derived/n/run-dead", "_alive/run-dead", "_alive/run-lives"):
        assert not (ws.root / "w" / gone).exists()
    assert ws.logs().count() == n and ingest.orphans(ws.spark, ws.warehouse).count() == 0 and ws.result(done)[0].count() >= 0


def test_recovery_of_an_empty_warehouse(spark, tmp_path):
    assert Workspace(spark, f"file://{tmp_path}/none").recover() == {"imports": [], "analyses": []}
