"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from emberlens import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return list(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = q.queries()[name](spark, SF)
    cur = duck.execute(q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    assert got == sorted(str([plain(v) for v in r]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, name):
    q.queries()[name](spark, SF).collect()


def test_envelopes_are_work_of_all_cores(spark):
    """However few row groups the table has."""
    assert q.queries()["otlp_metrics"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
