"""Explorer operators over one filter and one window: pages, counts, histograms, facets, summaries, context, look-ups."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlens.functions import predicates as P
from emberlens.functions.normalise import rfc3339

SECOND = 1_000_000_000
#: Widths of histogram bins in milliseconds, tried in this order, and limits of pages, bins and facets.
NICE_WIDTHS = (
    1, 5, 25, 100, 250, 1_000, 5_000, 15_000, 30_000, 60_000, 300_000, 900_000, 1_800_000, 3_600_000, 10_800_000, 21_600_000, 43_200_000, 86_400_000,
    604_800_000, 2_592_000_000,
)
MOST_ROWS, BINS, MOST_FACETS, MOST_VALUES, MOST_CONTEXT = 1000, (10, 500), 8, 50, 100


@dataclass(frozen=True)
class Window:
    """``[start, end)`` in nanoseconds; no bounds: all rows, the undated among them."""

    start: int | None = None
    end: int | None = None
    empty_anchor: bool = False

    @property
    def bounded(self) -> bool:
        return self.start is not None

    def holds(self) -> Column:
        t = F.col("event_time")
        return (t >= self.start) & (t < self.end) if self.bounded else F.lit(True)


def absolute(start: int, end: int) -> Window:
    return Window(start, end)


def relative_to_latest(logs: DataFrame, duration: int) -> Window:
    """The last ``duration`` before the latest row of the datasets, filtered or not."""
    latest = logs.agg(F.max("event_time")).first()[0]
    return Window(0, 0, True) if latest is None else Window(latest - duration, latest + 1)


def datasets(logs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The rows of the named datasets, of all without names; a name that no row has is an error."""
    if not names:
        return logs
    some = logs.where(F.col("dataset_id").isin(names))
    if missing := set(names) - {r["dataset_id"] for r in some.select("dataset_id").distinct().collect()}:  # as many as names
        raise ValueError(f"no dataset {sorted(missing)}")
    return some


def scoped(logs: DataFrame, where: Column | None = None, window: Window = Window()) -> DataFrame:
    """What every operator here works on."""
    rows = logs if where is None else logs.where(where)
    return rows.where(window.holds()) if window.bounded else rows


def canonical_order() -> list[Column]:
    return [F.desc_nulls_last("event_time"), F.desc("record_id"), F.desc("dataset_id")]


def cursor_of(row) -> str:
    key = {"v": 1, "t": row["event_time"], "r": row["record_id"], "d": row["dataset_id"]}
    return base64.urlsafe_b64encode(json.dumps(key).encode()).decode()


def page(logs: DataFrame, where: Column | None = None, window: Window = Window(), limit: int = 200, cursor: str | None = None, backward: bool = False) -> DataFrame:
    """Up to ``limit`` rows after (or before) the cursor in the canonical order, and one
    more if there are more; a backward page comes in the reverse order. Each page is
    one scan with a bounded sort, however deep it lies."""
    limit = max(1, min(MOST_ROWS, limit))
    rows = scoped(logs, where, window)
    if cursor:
        key = json.loads(base64.urlsafe_b64decode(cursor))
        t, pair = F.col("event_time"), (F.col("record_id"), F.col("dataset_id"))
        r, d = F.lit(key["r"]), F.lit(key["d"])
        if backward:
            later = (pair[0] > r) | ((pair[0] == r) & (pair[1] > d))
            rows = rows.where(t.isNotNull() | later) if key["t"] is None else rows.where((t > key["t"]) | ((t == key["t"]) & later))
        else:
            later = (pair[0] < r) | ((pair[0] == r) & (pair[1] < d))
            rows = rows.where(t.isNull() & later) if key["t"] is None else rows.where((t < key["t"]) | t.isNull() | ((t == key["t"]) & later))
    order = [F.asc_nulls_first("event_time"), F.asc("record_id"), F.asc("dataset_id")] if backward else canonical_order()
    return rows.orderBy(*order).limit(limit + 1)


def offset_page(logs: DataFrame, where: Column | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """The older, ascending listing."""
    return scoped(logs, where).orderBy(F.asc_nulls_last("event_time"), "record_id").offset(offset).limit(limit)


def counts(logs: DataFrame, where: Column | None = None, window: Window = Window()) -> DataFrame:
    """``(matching, omitted_untimestamped)`` in one pass."""
    omitted = F.count_if(F.col("event_time").isNull()) if window.bounded else F.lit(0).cast("long")
    return scoped(logs, where).agg(F.count_if(P.two_valued(window.holds())).alias("matching"), omitted.alias("omitted_untimestamped"))


def bin_width(span: int, most: int) -> int:
    """The first nice width that needs fewer than ``most`` bins."""
    most = max(BINS[0], min(BINS[1], most))
    for width in (ms * SECOND // 1000 for ms in NICE_WIDTHS):
        if span // width < most:
            return width
    return span // most + 1


def histogram(logs: DataFrame, where: Column | None = None, window: Window = Window(), bins: int = 60) -> DataFrame:
    """``(bin_start, n)`` for every bin of the window, or of the filtered rows' own span; empty bins have 0."""
    rows = scoped(logs, where, window).where(F.col("event_time").isNotNull())
    if window.bounded:
        start, end = window.start, window.end
    else:
        first = rows.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b")).first()
        if first["a"] is None:
            return rows.sparkSession.createDataFrame([], "bin_start long, n long")
        start, end = first["a"], first["b"] + 1
    width = bin_width(end - start, bins)
    start = start // width * width
    every = rows.sparkSession.range(start, end, width).select(F.col("id").alias("bin_start"))
    found = rows.groupBy(_bin(start, width)).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(found), "bin_start", "left").select("bin_start", F.coalesce("n", F.lit(0)).alias("n"))


def _bin(start: int, width: int) -> Column:
    """Whole numbers all the way: nanoseconds don't fit a double."""
    t = F.col("event_time") - start
    return (F.col("event_time") - F.pmod(t, F.lit(width))).alias("bin_start")


def severity_value() -> Column:
    """The level's name, or the upper-case text."""
    out = F.upper("severity_text")
    for name, (low, high) in P.BANDS.items():
        out = F.when(F.col("severity_number").between(low, high), F.lit(name)).otherwise(out)
    return out


def facets(logs: DataFrame, fields: dict[str, Column], where: Column | None = None, window: Window = Window(), most: int = 10) -> DataFrame:
    """``(facet, value, n, missing, truncated)``: the ``most`` commonest values of up to eight fields,
    in one scan. Rows shrink to counts of values before they are shuffled, and each task
    passes on only its ``most`` + 1 largest counts of a facet to be ranked."""
    if len(fields) > MOST_FACETS:
        raise ValueError(f"at most {MOST_FACETS} facets")
    most = max(1, min(MOST_VALUES, most))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("value")) for n, c in fields.items()])).alias("p")
    n = scoped(logs, where, window).select(pairs).select("p.*").groupBy("facet", "value").agg(F.count("*").alias("n"))
    missing = n.groupBy("facet").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    of = W.partitionBy("facet")
    ranked = n.where("value is not null").withColumn("rank", F.row_number().over(of.orderBy(F.desc("n"), "value"))).where(F.col("rank") <= most + 1)
    ranked = ranked.withColumn("truncated", F.max("rank").over(of) > most).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(missing), "facet").select("facet", "value", "n", "missing", "truncated")  # a row a facet: eight at most


def summary(logs: DataFrame, column: Column, where: Column | None = None, window: Window = Window(), numeric: bool = False, exact_to: int = 10_000) -> DataFrame:
    """``(present, missing, distinct, exact, least, largest)`` of one field. A first scan, which runs at once, computes all of
    it with a sketch of the values, of which each task passes on one. If that says there are at most ``exact_to`` values, they
    are counted exactly by a second scan of this one column; more are never shuffled."""
    rows = scoped(logs, where, window).select(column.alias("v"))
    number = F.col("v").try_cast("double") if numeric else F.lit(None).cast("double")
    stats = rows.agg(
        F.count("v").alias("present"), F.count_if(F.col("v").isNull()).alias("missing"), F.approx_count_distinct("v").alias("distinct"), F.min(number).alias("least"), F.max(number).alias("largest")
    )
    found = stats.first()
    exact = found["distinct"] <= exact_to
    known = {c: F.lit(found[c]).cast(stats.schema[c].dataType).alias(c) for c in stats.columns}
    one = rows.agg(F.count_distinct("v").alias("counted")) if exact else logs.sparkSession.range(1).select(F.lit(found["distinct"]).alias("counted"))
    return one.select(known["present"], known["missing"], F.col("counted").cast("long").alias("distinct"), F.lit(exact).alias("exact"), known["least"], known["largest"])


def top_values(logs: DataFrame, column: Column, where: Column | None = None, window: Window = Window(), most: int = 10) -> DataFrame:
    rows = scoped(logs, where, window).select(column.cast("string").alias("value")).where("value is not null")
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def source_context(logs: DataFrame, dataset: str, source: str, number: int, before: int = 10, after: int = 10) -> DataFrame:
    """Rows of one source around a record number, in its order."""
    before, after = min(before, MOST_CONTEXT), min(after, MOST_CONTEXT)
    near = F.col("record_number").between(number - before, number + after)
    return logs.where((F.col("dataset_id") == dataset) & (F.col("source_id") == source) & near).orderBy("record_number", "record_id")


def record(logs: DataFrame, dataset: str, record_id: str) -> DataFrame:
    return logs.where((F.col("dataset_id") == dataset) & (F.col("record_id") == record_id)).limit(1)


def by_ids(logs: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows that ``ids`` names, or doesn't: by dataset and record id, since datasets may hold the same file; by record id alone where ``ids``
    has no dataset. Spark picks the join by the size of ``ids``."""
    key = ["dataset_id", "record_id"] if "dataset_id" in ids.columns else ["record_id"]
    return logs.join(ids.select(*key).distinct(), key, "left_semi" if keep else "left_anti")


def with_dimension(logs: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``dimension``, a row an id, as a struct named by ``key`` without ``_id``; null where it lacks
    the id. Spark picks the join by the dimension's size."""
    others = F.struct(*[F.col(c) for c in dimension.columns if c != key])
    return logs.join(dimension.select(key, others.alias(key.removesuffix("_id"))), key, "left")


#: The columns of an export unless others are asked for.
CSV_COLUMNS = ("timestamp", "severity", "severity.number", "message", "trace_id", "span_id", "dataset", "record_id", "attributes")


def _exported(rows: DataFrame) -> dict[str, Column]:
    have = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    return {
        "timestamp": rfc3339(F.col("event_time")), "timestamp.nanos": F.col("event_time").cast("string"), "severity": severity_value(), "severity.text": have("severity_text"),
        "severity.number": F.col("severity_number").cast("string"), "message": F.col("display_message"), "trace_id": have("trace_id"), "span_id": have("span_id"),
        "dataset": F.col("dataset_id"), "source": have("source_id"), "record_id": F.col("record_id"), "record_number": have("record_number").cast("string"),
        "line": have("line_start").cast("string"), "attributes": have("attributes_json"),
    }


def csv_rows(rows: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """Export columns as text, null as empty; names that aren't canonical are attributes,
    flat ones before nested ones. What a spreadsheet would take for a formula gets an
    apostrophe where the text is the log's own."""
    known = _exported(rows)
    own = {"severity.text", "message", "attributes"}
    guard = lambda c: F.when(c.rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
    out = []
    for name in columns:
        value = known[name] if name in known else F.coalesce(P.attribute(name), P.attribute(*name.split(".")))
        out.append(F.coalesce(guard(value) if name in own or name not in known else value, F.lit("")).alias(name))
    return rows.select(*out)


def jsonl_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """``(record_id, line)`` and the columns to ``keep``: a JSON object a row with all of its members, null ones too; attributes keep their types."""
    known = _exported(rows)
    have = lambda name, kind="string": F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    members = F.struct(
        "record_id", known["timestamp"].alias("timestamp"), F.col("event_time").alias("timestamp_nanos"), known["severity"].alias("severity"), have("severity_text").alias("severity_text"),
        "severity_number", F.col("display_message").alias("message"), known["trace_id"].alias("trace_id"), known["span_id"].alias("span_id"), "dataset_id",
        have("source_id").alias("source_id"), have("record_number", "long").alias("record_number"), have("line_start", "long").alias("line_start"),
    )
    text = F.to_json(members, {"ignoreNullFields": "false"})
    tail = [F.concat(F.lit(f',"{n}":'), F.coalesce(have(f"{n}_json"), F.lit("null"))) for n in ("attributes", "provenance")]
    return rows.select("record_id", *keep, F.concat(F.substr(text, F.lit(1), F.length(text) - 1), *tail, F.lit("}")).alias("line"))


def export(rows: DataFrame, order: list[Column], most_rows: int = 1_000_000, most_bytes: int = 1 << 30, line: str = "line") -> tuple[DataFrame, bool]:
    """Whole records up to both bounds with their ``place``, and whether that cuts any off. Keys and lengths alone are
    ranked and summed, at most ``most_rows`` + 1 of them in one task; the lines of those that fit are joined to them.
    Rows are told apart by record, dataset and line; of equal ones one is kept."""
    keys = [c for c in rows.columns if c != line]
    marked = rows.withColumn("tie_", F.xxhash64(line))
    first = marked.select(*keys, "tie_", (F.octet_length(line) + 1).alias("size_")).orderBy(*order).limit(most_rows + 1).distinct()
    in_order = W.orderBy(*order, "tie_")
    placed = first.withColumn("place", F.row_number().over(in_order)).withColumn("so_far", F.sum("size_").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    fits = (F.col("place") <= most_rows) & (F.col("so_far") <= most_bytes)
    n = placed.agg(F.count("*").alias("all"), F.count_if(fits).alias("kept")).first()
    same = ["record_id", "dataset_id", "tie_"] if "dataset_id" in keys else ["record_id", "tie_"]
    kept = marked.select(*same, line).distinct().join(placed.where(fits).drop("size_", "so_far"), same)
    return kept.select(*rows.columns, "place"), n["all"] > n["kept"]
