"""Published files by time, the token index and joins of many anchors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberlens.case import evidence
from emberlens.functions import predicates as P
from emberlens.operators import catalog, correlate, explore, tokenindex
from emberlens.plans.adapters import documents_as_logs, events_as_logs
from emberlens.schema import LOGS
from emberlens.sources import ingest, segments
from emberlens.workspace import Workspace

SF = "/root/testdata/sf0.001"
SECOND = explore.SECOND


def logs_of(spark, rows):
    have = [f.name for f in LOGS.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in have) for r in rows], LOGS)


def put(spark, warehouse, dataset, rows, files=6):
    """Published as an import does, in several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(files))
    try:
        rejects = spark.createDataFrame([], "origin_id string, reason string")
        return ingest.publish(logs_of(spark, rows), rejects, warehouse, dataset)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    w = Workspace(spark, f"file://{tmp_path_factory.mktemp('segments')}/w")
    rng = random.Random(4)
    for dataset, begin in (("a", 0), ("b", 2_000), ("c", 10_000)):
        rows = [
            {"record_id": f"{dataset}{i:05d}", "dataset_id": dataset, "event_time": None if i % 10 == 9 else (begin + i // 2) * SECOND, "display_message": rng.choice(["disk full", "Disk is FULL", "fulldisk", "ok"]), "severity_number": i % 24 + 1}
            for i in range(2_000)
        ]
        assert put(spark, w.warehouse, dataset, rows) == {"accepted": 2_000, "undated": 200, "rejected": 0, "duplicates": 0}
    return w


def test_windows_open_the_files_that_can_hold_them(spark, ws):
    everything = ws.logs()
    window = explore.absolute(2_100 * SECOND, 2_150 * SECOND)
    some = ingest.published(spark, ws.warehouse, window=window)
    want = everything.where(window.holds())
    assert sorted(map(str, some.collect())) == sorted(map(str, want.collect())) and some.count() == 90
    assert 1 <= len(some.inputFiles()) <= 3 < len(everything.inputFiles())
    assert ingest.published(spark, ws.warehouse, window=explore.absolute(0, 0)).count() == 0
    assert ingest.published(spark, ws.warehouse, ["c"], window=explore.absolute(0, 99)).count() == 0
    with pytest.raises(ValueError):
        ingest.published(spark, ws.warehouse, ["none"], window=window)


def test_undated_rows_are_many_files_work(spark, ws):
    found = segments.zones(spark, ingest.manifest(spark, ws.warehouse), ws.warehouse).where("dataset_id = 'a'").collect()
    assert sum(r["rows"] for r in found) == 2_000 and sum(r["undated"] for r in found) == 200 and len(found) >= 4
    dated = sorted((r["least"], r["largest"]) for r in found if r["least"] is not None)
    assert all(a[1] <= b[0] for a, b in zip(dated, dated[1:]))


@pytest.mark.parametrize(("where", "window", "limit"), [
    (None, explore.Window(), 5), (None, explore.absolute(0, 500 * SECOND), 20), (lambda: P.severity(">=", "ERROR"), explore.Window(), 300), (lambda: P.phrase("disk full"), explore.Window(), 1_000),
    (lambda: P.term("nowhere"), explore.Window(), 5), (lambda: F.col("dataset_id") == "a", explore.Window(), 50), (lambda: F.col("event_time").isNull(), explore.Window(), 50),
])
def test_pages_from_the_newest_files(spark, ws, where, window, limit):
    where = where and where()
    rows, files = segments.newest_page(spark, segments.zones(spark, ingest.manifest(spark, ws.warehouse), ws.warehouse), where, window, limit)
    assert rows.collect() == explore.page(ws.logs(), where, window, limit).collect()
    assert ws.page(where, window, limit=limit).collect() == rows.collect()
    if where is None:
        assert files <= segments.FIRST_FILES < len(ws.logs().inputFiles())


def test_index_of_published_runs(spark, ws):
    assert ws.find("DISK full").count() == ws.logs().where(P.phrase("disk full")).count() > 0  # all by a scan
    assert ws.index() == 3 and ws.index() == 0  # nothing is written twice
    for text in ("disk full", "FULL", "fulldisk", "none", "", "full disk", "is full"):
        assert sorted(r["record_id"] for r in ws.find(text).collect()) == sorted(r["record_id"] for r in ws.logs().where(P.phrase(text)).collect())
    put(spark, ws.warehouse, "d", [{"record_id": "d1", "dataset_id": "d", "display_message": "disk full"}, {"record_id": "d2", "dataset_id": "d"}])
    n = ws.find("disk full").count()
    assert ws.index() == 1 and ws.find("disk full").count() == n == ws.logs().where(P.phrase("disk full")).count()


def test_index_reads_one_folder(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    tokenindex.write(documents_as_logs(spark, SF), path, F.col("body"))
    index = tokenindex.read(spark, path)
    found = tokenindex.candidates(index, "The")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(token,the)" in plan
    used = {r["f"] for r in index.where(tokenindex.bucket(F.col("token")) == tokenindex.bucket(F.lit("the"))).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert 0 < len(used) <= tokenindex.SHARES < len(index.inputFiles())


def test_words_in_any_case(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    texts = ["Straße", "STRASSE", "ẞ", "ß", "İstanbul", "istanbul", "ISTANBUL", "ſet", "SET", "Σίσυφος", "ΣΊΣΥΦΟΣ", "K", "k", "éa", "ÉA", "naïve x", None, "", "a_b", "日本 語"]
    logs = logs_of(spark, [{"record_id": f"r{i}", "dataset_id": "d", "display_message": t} for i, t in enumerate(texts)])
    tokenindex.write(logs, path)
    for t in [t for t in texts if t] + ["naïve", "a b", "b"]:
        want = {r["record_id"] for r in logs.where(P.phrase(t)).collect()}
        assert {r["record_id"] for r in tokenindex.search(logs, tokenindex.read(spark, path), t).collect()} == want, t


@pytest.mark.parametrize("hot", [10**6, 5])
def test_neighbourhoods_of_many_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(correlate, "HOT_BUCKET", hot)
    rng = random.Random(hot)
    rows = [{"record_id": f"r{i}", "dataset_id": "d" if i % 3 else "e", "event_time": rng.choice([None, *range(-60, 60)]), "resource_id": rng.choice(["x", "y", None]), "operation": rng.choice("ab")} for i in range(300)]
    rows += [r | {"dataset_id": "other"} for r in rows[:30]]  # the same file in another dataset
    logs = logs_of(spark, rows)
    near = lambda a, b: a["event_time"] is not None and b["event_time"] is not None and abs(a["event_time"] - b["event_time"]) <= 7 and a["resource_id"] == b["resource_id"] and a is not b
    want = sorted((a["dataset_id"], a["record_id"], b["dataset_id"], b["record_id"], b["event_time"] - a["event_time"]) for a in rows for b in rows if a["operation"] == "a" and near(a, b))
    found = correlate.neighbourhoods(logs.where("operation = 'a'"), logs, 7, ["resource_id"])
    assert sorted(tuple(r)[:5] for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    few = correlate.neighbourhoods(logs.where("operation = 'a'"), logs, 7, ["resource_id"], most=2).collect()
    assert len(few) == sum(min(2, len([w for w in want if w[:2] == k])) for k in {w[:2] for w in want})
    assert {(r["anchor_dataset"], r["anchor_id"]): r["cut"] for r in few} == {k: max(0, len([w for w in want if w[:2] == k]) - 2) for k in {w[:2] for w in want}}
    one = correlate.neighbourhood(logs, 5, "r1", 7, {"resource_id": "x"})
    assert one.count() == sum(r["event_time"] is not None and abs(r["event_time"] - 5) <= 7 and r["resource_id"] == "x" and r["record_id"] != "r1" for r in rows)


def test_ids_belong_to_their_dataset(spark):
    logs = logs_of(spark, [{"record_id": "r", "dataset_id": d, "event_time": t} for d, t in (("a", 1), ("b", 2))])
    ids = logs.where("dataset_id = 'a'").select("dataset_id", "record_id")
    assert [r["dataset_id"] for r in explore.by_ids(logs, ids).collect()] == ["a"] and [r["dataset_id"] for r in explore.by_ids(logs, ids, keep=False).collect()] == ["b"]
    assert explore.by_ids(logs, ids.select("record_id")).count() == 2
    pins = spark.createDataFrame([("e", "event", "b", None, ["r"], 1, None, None, "")], evidence.PINS)
    assert evidence.timeline(pins, logs).first()["at"] == 2


def test_catalog_scans_once(spark):
    cell = lambda v: {"t": "map", "v": v} if isinstance(v, dict) else {"t": "str", "v": v}
    deep = {"a": cell({"b": cell({"c": cell({"d": cell("1")})}), "e": cell("2")}), "it's": cell("3"), "none": cell({})}
    logs = logs_of(spark, [{"record_id": "r", "dataset_id": "d", "attributes_json": json.dumps(deep)}, {"record_id": "s", "dataset_id": "d", "attributes_json": "{}"}, {"record_id": "t", "dataset_id": "d"}])
    got = {r["path"]: (r["steps"], r["queryable"]) for r in catalog.field_catalog(logs).collect()}
    assert got == {"a.b.c.d": (["a", "b", "c", "d"], True), "a.e": (["a", "e"], True), "it's": (["it's"], False)}
    rows = catalog.attribute_rows(events_as_logs(spark, SF))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_query_pins_are_counted_in_one_scan(spark, ws):
    queries = {f"q{i}": (F.col("severity_number") >= i, explore.absolute(0, 3_000 * SECOND)) for i in range(30)} | {"all": (None, explore.Window()), "null": (F.lit(None).cast("boolean"), explore.Window())}
    now = evidence.recount(ws.logs(), queries)
    assert {r["evidence_id"]: r["n"] for r in now.collect()} == {k: explore.counts(ws.logs(), w, x).first()["matching"] for k, (w, x) in list(queries.items())[::6]} | {r["evidence_id"]: r["n"] for r in now.collect() if r["evidence_id"] not in list(queries)[::6]}
    assert evidence.recount(ws.logs(), queries)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert evidence.recount(ws.logs(), {}).count() == 0
