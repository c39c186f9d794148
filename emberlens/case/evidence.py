"""Pins of records, queries and intervals, verified in one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlens.functions import predicates as P
from emberlens.operators import explore
from emberlens.sources.segments import revision_of, row_hash

#: Bounds of what a pin keeps: ids, sample rows and characters of a field.
MOST_IDS, MOST_SAMPLES, FIELD_CHARS = 500, 50, 4096
PINS = "evidence_id string, kind string, dataset_id string, revision string, record_ids array<string>, expected long, start long, end long, note string"


def revision(logs: DataFrame) -> DataFrame:
    """``(dataset_id, revision)`` of the rows there are: a digest that doesn't depend on their order or files."""
    h = row_hash(logs.columns, "event_time")
    parts = logs.groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.bit_xor(h).alias("b"))
    return parts.select("dataset_id", revision_of("n", "a", "b").alias("revision"))


def pin_selection(logs: DataFrame, evidence_id: str, ids: list[str], note: str = "") -> DataFrame:
    """A pin of some records; more than ``MOST_IDS`` are refused."""
    if not ids or len(ids) > MOST_IDS:
        raise ValueError(f"a selection has 1 to {MOST_IDS} records")
    rows = logs.where(F.col("record_id").isin(ids)).agg(F.min("dataset_id").alias("d"), F.count_distinct("record_id").alias("n")).first()
    values = [(evidence_id, "selection" if len(ids) > 1 else "event", rows["d"], None, list(ids), rows["n"], None, None, note)]
    return logs.sparkSession.createDataFrame(values, PINS)


def pin_query(logs: DataFrame, evidence_id: str, where: Column | None, window: explore.Window, note: str = "") -> DataFrame:
    """A pin of a filter over a window that is fixed by now: the count it has, and sample ids."""
    rows = explore.scoped(logs, where, window)
    n = rows.agg(F.min("dataset_id").alias("d"), F.count("*").alias("n")).first()
    sample = [r["record_id"] for r in rows.orderBy(*explore.canonical_order()).limit(MOST_SAMPLES).select("record_id").collect()]
    values = [(evidence_id, "query", n["d"], None, sample, n["n"], window.start, window.end, note)]
    return logs.sparkSession.createDataFrame(values, PINS)


def pin_group(logs: DataFrame, evidence_id: str, column: str, value: str, where: Column | None, window: explore.Window) -> tuple[DataFrame, int]:
    """A pin of one facet value's rows, and their share of all rows in basis points."""
    rows = explore.scoped(logs, where, window)
    same = F.coalesce(F.col(column).cast("string") == value, F.lit(False))
    n = rows.agg(F.count("*").alias("all"), F.count_if(same).alias("own")).first()
    pin = pin_query(logs, evidence_id, same if where is None else where & same, window, f"{column} = {value}")
    return pin.withColumn("kind", F.lit("group")), n["own"] * 10_000 // n["all"] if n["all"] else 0


def pin_interval(logs: DataFrame, evidence_id: str, where: Column | None, start: int, end: int, note: str = "") -> DataFrame:
    """A pin of one histogram bin."""
    return pin_query(logs, evidence_id, where, explore.absolute(start, end), note).withColumn("kind", F.lit("interval"))


def with_revisions(pins: DataFrame, logs: DataFrame) -> DataFrame:
    """Pins with the revision that their dataset has now."""
    return pins.drop("revision").join(revision(logs), "dataset_id", "left").select(*[c.split()[0] for c in PINS.split(", ")])


#: Kinds of pins that this version understands.
KINDS = ("event", "selection", "query", "group", "interval")


def verify(pins: DataFrame, logs: DataFrame, current: DataFrame | None = None, sources: DataFrame | None = None, revisions: DataFrame | None = None) -> DataFrame:
    """``(evidence_id, state, resolved, expected)`` of all pins in one join of their ids
    with the rows. ``current`` has the counts that query pins have now, ``(evidence_id, n)``; ``sources`` the source
    files that are there now, ``(origin_id)``: records that are found but whose file is gone are
    ``canonical_available_source_unavailable``, pins of which nothing is found while a file is gone ``source_missing``.
    ``revisions`` are those of the datasets if they are known, as ``ingest.revisions`` has them; else all rows are hashed.
    A pin of an unknown kind is ``unsupported_reference_version``."""
    ids = pins.select("evidence_id", "dataset_id", F.explode_outer("record_ids").alias("record_id"))
    wanted = ids.where("record_id is not null").select("dataset_id", "record_id").distinct()
    origin = F.col("origin_id") if sources is not None else F.lit(None).cast("string").alias("origin_id")
    there = logs.select("dataset_id", "record_id", origin).join(wanted, ["dataset_id", "record_id"], "left_semi").groupBy("dataset_id", "record_id").agg(F.lit(1).alias("there"), F.min("origin_id").alias("origin_id"))
    gone = F.lit(None).cast("int")
    if sources is not None:
        there = there.join(sources.select("origin_id", F.lit(1).alias("kept")).distinct(), "origin_id", "left")
        gone = F.when(F.col("there").isNotNull() & F.col("kept").isNull(), 1)
    found = ids.join(there, ["dataset_id", "record_id"], "left").groupBy("evidence_id").agg(F.count("there").alias("resolved"), F.count("record_id").alias("asked"), F.count(gone).alias("gone"))
    lost = logs.select("dataset_id", "origin_id").distinct().join(sources.select("origin_id").distinct(), "origin_id", "left_anti").select("dataset_id", F.lit(True).alias("lost")).distinct() if sources is not None else None
    now = (revision(logs) if revisions is None else revisions).withColumnRenamed("revision", "now")
    counts = current if current is not None else pins.sparkSession.createDataFrame([], "evidence_id string, n long")
    missing = F.coalesce("lost", F.lit(False)) if lost is not None else F.lit(False)
    state = (
        F.when(~F.col("kind").isin(*KINDS), "unsupported_reference_version")
        .when(F.col("now").isNull(), "dataset_revision_unavailable")
        .when(F.col("kind").isin("query", "group", "interval") & F.col("n").isNotNull() & (F.col("n") != F.col("expected")), "query_drift")
        .when((F.col("resolved") == F.col("asked")) & (F.col("gone") > 0), "canonical_available_source_unavailable")
        .when(F.col("resolved") == F.col("asked"), F.when(F.col("revision").isNotNull() & (F.col("revision") != F.col("now")), "source_changed").otherwise("verified"))
        .when(F.col("resolved") == 0, F.when(missing, "source_missing").otherwise("broken"))
        .otherwise("partially_resolved")
    )
    joined = pins.join(found, "evidence_id", "left").join(now, "dataset_id", "left").join(counts, "evidence_id", "left")
    joined = joined if lost is None else joined.join(lost, "dataset_id", "left")
    return joined.select("evidence_id", state.alias("state"), F.coalesce("resolved", F.lit(0)).alias("resolved"), "expected")


def recount(logs: DataFrame, queries: dict[str, tuple[Column | None, explore.Window]]) -> DataFrame:
    """``(evidence_id, n)``: how many rows each query pin's filter and window keep now, for ``verify``'s ``current``. All are
    conditional counts of one scan of ``logs``, whatever their number."""
    one = lambda where, window: P.two_valued((F.lit(True) if where is None else where) & window.holds())
    names = list(queries)
    if not names:
        return logs.sparkSession.createDataFrame([], "evidence_id string, n long")
    counted = logs.agg(F.array(*[F.count_if(one(*queries[name])) for name in names]).alias("n"))
    return counted.select(F.inline(F.arrays_zip(F.array(*map(F.lit, names)).alias("evidence_id"), "n")))


def timeline(pins: DataFrame, logs: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """``(place, id, kind, at, until, undated_reason, title)``: markers and pins by their
    time, instants before intervals, then by id; undated ones last, with the reason. A
    case has some hundreds of entries, which are ranked together."""
    ids = pins.where("kind in ('event', 'selection')").select("evidence_id", "kind", "note", "dataset_id", F.explode("record_ids").alias("record_id"))
    times = ids.join(logs.select("dataset_id", "record_id", "event_time"), ["dataset_id", "record_id"], "left").groupBy("evidence_id", "kind", "note").agg(F.min("event_time").alias("at"), F.max("event_time").alias("b"))
    until = F.when((F.col("kind") == "selection") & (F.col("b") > F.col("at")), F.col("b"))
    rows = times.select(F.col("evidence_id").alias("id"), "kind", "at", until.alias("until"), F.when(F.col("at").isNull(), "none of its records is dated").alias("undated_reason"), F.col("note").alias("title"))
    queries = pins.where("kind not in ('event', 'selection')")
    rows = rows.unionByName(queries.select(F.col("evidence_id").alias("id"), "kind", F.col("start").alias("at"), F.col("end").alias("until"), F.when(F.col("start").isNull(), "the query has no window").alias("undated_reason"), F.col("note").alias("title")))
    if markers is not None:
        rows = rows.unionByName(markers.select("id", F.lit("marker").alias("kind"), "at", "until", F.when(F.col("at").isNull(), "the marker has no time").alias("undated_reason"), "title"))
    order = [F.asc_nulls_last("at"), F.col("until").isNotNull(), F.asc("until"), F.asc("id")]
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order))).select("place", "id", "kind", "at", "until", "undated_reason", "title")
