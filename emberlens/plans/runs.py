"""Analysis runs: a frozen scope, a derived table, and a manifest that says how it went."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlens.case.evidence import revision
from emberlens.plans import alive

STATES = "run_id string, name string, config_id string, revisions string, state string, at double, path string, rows long, error string, digest string"


def config_id(config: dict) -> str:
    """An id of the settings alone, whatever the order of their names."""
    return "acfg-" + hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def _note(spark: SparkSession, warehouse: str, *row) -> None:
    spark.createDataFrame([row], STATES).coalesce(1).write.mode("append").parquet(f"{warehouse}/runs")


def frozen(logs: DataFrame) -> str:
    """The revisions of the datasets in ``logs``: a row a dataset."""
    return json.dumps({r["dataset_id"]: r["revision"] for r in revision(logs).orderBy("dataset_id").collect()})


def digest(rows: DataFrame) -> tuple[int, str]:
    """The number of rows and a digest of them that depends on neither their order nor their files."""
    h = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    one = rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.bit_xor("h").alias("b")).first()
    return one["n"], "dsdig-" + hashlib.sha256(f"{rows.columns}|{one['n']}|{one['a']}|{one['b']}".encode()).hexdigest()[:32]


def run(name: str, logs: DataFrame, config: dict, analysis: Callable[[DataFrame], DataFrame], warehouse: str, order: Sequence[str] = (), revisions: str | None = None) -> str:
    """Runs ``analysis`` over ``logs`` and writes its rows, in ranges of ``order`` if there is one, with their digest. The state goes from
    pending to running to completed, or to failed with the error, which is raised again; a run that failed leaves no
    rows that count as its result. ``revisions`` are those of the datasets, if they are known; else ``frozen`` hashes all of ``logs``."""
    spark, run_id, of = logs.sparkSession, f"run-{uuid.uuid4().hex}", config_id(config)
    scope, path = revisions or frozen(logs), f"{warehouse}/derived/{name}/{run_id}"
    with alive.alive(spark, warehouse, run_id):
        for state in ("pending", "running"):
            _note(spark, warehouse, run_id, name, of, scope, state, time.time(), path, None, None, None)
        try:
            rows = analysis(logs)
            if order:
                rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
            rows.write.option("compression", "zstd").parquet(path)
            n, of_rows = digest(spark.read.schema(rows.schema).parquet(path))
        except Exception as e:
            _note(spark, warehouse, run_id, name, of, scope, "failed", time.time(), None, None, str(e)[:1000], None)
            raise
        _note(spark, warehouse, run_id, name, of, scope, "completed", time.time(), path, n, None, of_rows)
    return run_id


def sweep(spark: SparkSession, warehouse: str, living: alive.Living) -> list[str]:
    """Ends runs that broke off as failed, and deletes what they wrote; those that still live go on. Returns their ids."""
    if not alive.listed(spark, f"{warehouse}/runs"):
        return []
    ended = []
    for r in states(spark, warehouse).where("state in ('pending', 'running')").collect():  # those under way or broken off
        if not living.has(r["run_id"]):
            if r["path"]:
                alive.delete(spark, r["path"])
            _note(spark, warehouse, r["run_id"], r["name"], r["config_id"], r["revisions"], "failed", time.time(), None, None, "broke off", None)
            ended.append(r["run_id"])
    return sorted(ended)


def states(spark: SparkSession, warehouse: str) -> DataFrame:
    """The latest state of each run."""
    latest = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("at")))
    return spark.read.schema(STATES).parquet(f"{warehouse}/runs").withColumn("latest", latest).where("latest = 1").drop("latest")


def result(spark: SparkSession, warehouse: str, run_id: str, logs: DataFrame | None = None, revisions: str | None = None) -> tuple[DataFrame, bool]:
    """A completed run's rows, and whether they are stale: made of other revisions than ``revisions``, or than ``logs`` has, which
    hashes all of it. Of the run itself, its notes alone are read."""
    row = states(spark, warehouse).where(F.col("run_id") == run_id).first()
    if row is None or row["state"] != "completed":
        raise ValueError(f"{run_id} has no result")
    now = revisions or (frozen(logs) if logs is not None else None)
    return spark.read.parquet(row["path"]), now is not None and now != row["revisions"]


def whole(spark: SparkSession, warehouse: str, run_id: str) -> bool:
    """Whether a completed run's rows are those that were written."""
    row = states(spark, warehouse).where(F.col("run_id") == run_id).first()
    return digest(result(spark, warehouse, run_id)[0]) == (row["rows"], row["digest"])


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """What ``action`` returns; its Spark jobs are cancelled once it takes longer than ``seconds``."""
    group = f"budget-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "an action with a budget", interruptOnCancel=True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
