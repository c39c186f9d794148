"""Correlation by a shared key: groups, edges, behavioural signals and neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlens.functions import predicates as P
from emberlens.functions.normalise import content_id

#: Limits of groups and edges, thresholds of signals, and outcomes that are failures.
MOST_IN_GROUP, MOST_GROUPS, MOST_EDGES_A_GROUP = 256, 10_000, 32
GAP, SKEW = 300 * 1_000_000_000, 1_000_000
#: Rows beyond which a key is many tasks' work, and time, and records of a source, that one of these looks at together; see ``_pairs``.
HOT_KEY, SLICE, RECORDS = 1_000_000, 3_600 * 1_000_000_000, 100_000
FAILURES = ("failure", "failed", "error", "timeout", "rejected")
PLAIN_KEYS = ("request_id", "transaction_id", "message_id", "entity_id")


def normalise(key: Column, trim: bool = False, prefix: str | None = None, fold: bool = False) -> tuple[Column, Column]:
    """The key after trim, prefix and case steps, in this order, and which of them changed it."""
    steps, value = [], key
    for name, on, of in (
        ("trim", trim, F.trim),
        ("strip_prefix", prefix is not None, lambda c: F.when(c.startswith(prefix or ""), F.substr(c, F.lit(len(prefix or "") + 1), F.length(c))).otherwise(c)),
        ("case_fold", fold, F.lower),
    ):
        if on:
            new = of(value)
            steps.append(F.when(new != value, F.lit(name)))
            value = new
    return value, F.concat_ws(",", *steps) if steps else F.lit("")


def with_key(logs: DataFrame, key: str | tuple[str, ...] = "request_id", **normal) -> DataFrame:
    """Rows with ``key`` and ``rejection``, one of which is null. A tuple is the path of an attribute."""
    hexes = lambda c, n: (F.length(c) == n) & c.rlike("^[0-9a-f]+$") & ~c.rlike("^0+$")
    if key in ("trace_id", "trace_span"):
        trace, span = F.col("trace_id"), F.col("span_id")
        if key == "trace_id":
            bad = F.when(trace.isNull(), "missing_field").when(~hexes(trace, 32), "not_canonical")
            return logs.withColumn("rejection", bad).withColumn("key", F.when(bad.isNull(), trace)).withColumn("confidence", F.lit("exact"))
        bad = F.when(trace.isNull() & span.isNull(), "missing_field").when(trace.isNull() | span.isNull(), "incomplete_pair").when(~hexes(trace, 32) | ~hexes(span, 16), "not_canonical")
        return logs.withColumn("rejection", bad).withColumn("key", F.when(bad.isNull(), F.concat_ws("/", trace, span))).withColumn("confidence", F.lit("exact"))
    if key == "span_id":
        raise ValueError("a span id alone correlates nothing; use trace_span")
    if isinstance(key, str) and key not in PLAIN_KEYS:
        raise ValueError(f"no key {key!r}; attributes are given by their path")
    own = F.col(key) if isinstance(key, str) else P.attribute(*key)
    value, steps = normalise(own, **normal)
    bad = F.when(own.isNull(), "missing_field").when(value == "", "empty_value")
    return logs.withColumn("rejection", bad).withColumn("key", F.when(bad.isNull(), value)).withColumn("key_steps", steps)


def rejections(keyed: DataFrame) -> DataFrame:
    return keyed.where("rejection is not null").groupBy("rejection").agg(F.count("*").alias("n"))


def groups(keyed: DataFrame, most: int | None = None, most_in_group: int | None = None) -> DataFrame:
    """A row a key of at least two rows: sizes, times, resources and how sure the link is.
    Sizes count all rows; ``kept`` dated ones are read by edges and signals, all of them or the newest ``most_in_group``.
    All groups are returned in no order, or the largest ``most``; ``dropped`` counts what bounds leave out.
    Keys of traces link exactly, all others are merely correlated."""
    dated = F.col("event_time").isNotNull()
    sure = keyed if "confidence" in keyed.columns else keyed.withColumn("confidence", F.lit("correlated"))
    found = (
        sure.where("key is not null")
        .groupBy("key")
        .agg(
            F.count("*").alias("size"), F.count_if(~dated).alias("undated"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
            F.count_distinct("resource_id").alias("resources"), F.min("confidence").alias("confidence"),
        )
        .where("size >= 2")
    )
    kept = F.least(F.col("size") - F.col("undated"), F.lit(most_in_group))  # a null bound is none
    rows = found.withColumn("kept", kept).withColumn("truncated", F.col("size") - F.col("undated") - kept)
    return rows if most is None else rows.orderBy(F.desc("size"), "key").limit(most)


def members(keyed: DataFrame, most_in_group: int | None = None) -> DataFrame:
    """Dated rows of keys: all, or the newest ``most_in_group`` of each, to which Spark cuts a key's rows before it shuffles them."""
    dated = keyed.where("key is not null and event_time is not null")
    if most_in_group is None:
        return dated
    newest = W.partitionBy("key").orderBy(F.desc("event_time"), F.desc("record_id"), F.desc("dataset_id"))
    ranked = dated.withColumn("rank", F.row_number().over(newest))
    return ranked.where(F.col("rank") <= most_in_group).drop("rank")


def _pairs(rows: DataFrame, by: list[str], order: list[str], take: list[str], width: int = SLICE) -> DataFrame:
    """Each row with its predecessor's columns, as ``p_...``. Rows are shuffled once, a key to one task, for which their
    keys' hashes are counted first. A key that more than ``HOT_KEY`` rows share is cut into slices of ``width`` along the
    first column of the order, so that it is many tasks' work; a slice's first row gets the last row of the slice before it,
    of which there is one a slice."""
    hashed = rows.withColumn("hash_", F.xxhash64(*by))
    hot = F.broadcast(hashed.groupBy("hash_").agg(F.count("*").alias("n_")).where(F.col("n_") > HOT_KEY).select("hash_"))
    ordered = W.partitionBy(*by).orderBy(*order)
    own = {"p_": F.lag(F.lit(True)).over(ordered), **{f"p_{c}": F.lag(c).over(ordered) for c in take}}  # no struct, which would be shuffled beside its columns
    whole = hashed.join(hot, "hash_", "left_anti").drop("hash_").withColumns(own).where("p_").drop("p_")
    sliced = hashed.join(hot, "hash_", "left_semi").drop("hash_").withColumn("slice_", F.expr(f"{order[0]} - pmod({order[0]}, {width}L)"))
    inside = W.partitionBy(*by, "slice_").orderBy(*order)
    within = sliced.withColumn("p", F.lag(F.struct(*take)).over(inside))
    last = sliced.groupBy(*by, "slice_").agg(F.max_by(F.struct(*take), F.struct(*order)).alias("last_"))
    carried = last.withColumn("before_", F.lag("last_").over(W.partitionBy(*by).orderBy("slice_"))).drop("last_")
    names = [*by, "slice_"]
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    joined = within.alias("a").join(carried.alias("b"), on, "left").select("a.*", "b.before_")
    pairs = joined.withColumn("p", F.coalesce("p", "before_")).where("p is not null").drop("before_", "slice_")
    return whole.unionByName(pairs.select("*", *[F.col(f"p.{c}").alias(f"p_{c}") for c in take]).drop("p"))


def edges(rows: DataFrame, most_a_group: int | None = None) -> DataFrame:
    """``(key, from_id, to_id, delta)`` of consecutive members: all, or the earliest ``most_a_group`` of a key."""
    pairs = _pairs(rows, ["key"], ["event_time", "record_id"], ["record_id", "event_time"])
    if most_a_group is not None:
        place = F.row_number().over(W.partitionBy("key").orderBy("event_time", "record_id"))
        pairs = pairs.withColumn("place", place).where(F.col("place") <= most_a_group)
    return pairs.select("key", F.col("p_record_id").alias("from_id"), F.col("record_id").alias("to_id"), (F.col("event_time") - F.col("p_event_time")).alias("delta"))


def dropped(keyed: DataFrame, most: int | None = MOST_GROUPS, most_in_group: int | None = MOST_IN_GROUP, most_a_group: int | None = MOST_EDGES_A_GROUP) -> DataFrame:
    """``(groups, members, edges)``: how many of each these bounds leave out of ``groups``, ``members`` and ``edges``."""
    of = groups(keyed, None, most_in_group)
    pairs = F.greatest(F.col("size") - F.col("undated") - 1, F.lit(0))
    taken = F.least(F.greatest(F.col("kept") - 1, F.lit(0)), F.lit(most_a_group))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    beyond = F.lit(0).cast("long") if most is None else F.greatest(F.count("*") - most, F.lit(0))
    return of.agg(beyond.alias("groups"), total("truncated").alias("members"), total(pairs - taken).alias("edges"))


#: The columns that all signals have; ``EVIDENCE`` says what they rest on.
SIGNAL = ("key", "kind", "strength", "from_id", "to_id", "delta")
EVIDENCE = ("signal_id", "rule", "lead", "from_time", "to_time", "tolerance", "matched", "missing", "reason")


def time_quality(logs: DataFrame) -> Column:
    """``missing``, ``inferred`` where ingestion had to assume a zone or couldn't read a time, else ``observed``."""
    flags = F.from_json(F.get_json_object("provenance_json", "$.flags"), "array<string>")
    assumed = F.coalesce(F.arrays_overlap(flags, F.array(F.lit("timezone_assumed"), F.lit("timestamp_unparsed"))), F.lit(False))
    return F.when(F.col("event_time").isNull(), "missing").when(assumed if "provenance_json" in logs.columns else F.lit(False), "inferred").otherwise("observed")


def inferred(logs: DataFrame) -> Column:
    return time_quality(logs) == "inferred"


def _signal(rows: DataFrame, kind: str, strength: Column, matched: dict[str, Column], missing: dict[str, Column], tolerance: int | None = None) -> DataFrame:
    """``SIGNAL`` and ``EVIDENCE``. Whatever the source doesn't state itself is a lead."""
    names = lambda of: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in of.items()]), lambda x: x.isNotNull())
    found = rows.withColumn("strength", strength).where("strength is not null").select(
        "key", F.lit(kind).alias("kind"), "strength", F.col("p_record_id").alias("from_id"), F.col("record_id").alias("to_id"), (F.col("event_time") - F.col("p_event_time")).alias("delta"),
        content_id("sig", F.lit(kind), F.col("key"), F.col("p_record_id"), F.col("record_id")).alias("signal_id"), F.lit(f"{kind}/1").alias("rule"),
        (F.col("strength") != "documented").alias("lead"), F.col("p_event_time").alias("from_time"), F.col("event_time").alias("to_time"), F.lit(tolerance).cast("long").alias("tolerance"),
        names(matched).alias("matched"), names(missing).alias("missing"),
    )
    listed = lambda c, none: F.when(F.size(c) == 0, F.lit(none)).otherwise(F.array_join(c, ", "))
    reason = F.concat("kind", F.lit(" is "), "strength", F.lit("; agrees: "), listed("matched", "nothing"), F.lit("; not known: "), listed("missing", "nothing"), F.when(F.col("lead"), "; a lead to follow, no proof").otherwise(""))
    return found.withColumn("reason", reason)


def retries(rows: DataFrame, attempt: Column | None = None) -> DataFrame:
    """Consecutive members that retry: a counter that advances documents it; counters that
    don't, and different operations, speak against it; the same operation indicates it, and
    after a failure corroborates it."""
    rows = rows.withColumn("attempt", F.lit(None).cast("long") if attempt is None else attempt)
    pairs = _pairs(rows, ["key"], ["event_time", "record_id"], ["record_id", "event_time", "operation", "outcome", "attempt"])
    a, b = F.col("p_attempt"), F.col("attempt")
    counted = F.coalesce(F.when(a.isNotNull(), b > a).otherwise(b >= 1), F.lit(False))
    same = F.coalesce(F.col("operation") == F.col("p_operation"), F.lit(False))
    against = (a.isNotNull() & b.isNotNull() & ~counted) | F.coalesce(F.col("operation") != F.col("p_operation"), F.lit(False))
    failed = F.coalesce(F.col("p_outcome").isin(*FAILURES), F.lit(False))
    strength = F.when(against, F.lit(None)).when(counted, "documented").when(same & failed, "corroborated").when(same, "indicative")
    return _signal(pairs, "retry", strength, {"attempt": counted, "operation": same, "outcome": failed}, {"attempt": ~counted, "operation": ~same, "outcome": F.col("p_outcome").isNull()})


def _observed() -> tuple[dict[str, Column], dict[str, Column]]:
    sides = {"earlier_timestamp_observed": F.col("p_inferred"), "later_timestamp_observed": F.col("inferred")}
    return {n: ~c for n, c in sides.items()}, sides


def gaps(rows: DataFrame, threshold: int = GAP, inferred: Column | None = None) -> DataFrame:
    """Consecutive members further apart than the threshold; times that were inferred only indicate it."""
    rows = rows.withColumn("inferred", F.lit(False) if inferred is None else inferred)
    pairs = _pairs(rows, ["key"], ["event_time", "record_id"], ["record_id", "event_time", "inferred"])
    strength = F.when(F.col("inferred") | F.col("p_inferred"), "indicative").otherwise("corroborated")
    seen, assumed = _observed()
    return _signal(pairs, "gap", F.when(F.col("event_time") - F.col("p_event_time") > threshold, strength), {"event_time": F.lit(True), **seen}, assumed, threshold)


def clock_skews(rows: DataFrame, tolerance: int = SKEW, inferred: Column | None = None) -> DataFrame:
    """Rows of a source that come later in it but are dated earlier."""
    rows = rows.where("record_number is not null").withColumn("inferred", F.lit(False) if inferred is None else inferred)
    pairs = _pairs(rows, ["key", "dataset_id", "source_id"], ["record_number", "record_id"], ["record_id", "event_time", "record_number", "inferred"], RECORDS)
    back = (F.col("record_number") > F.col("p_record_number")) & (F.col("p_event_time") - F.col("event_time") > tolerance)
    seen, assumed = _observed()
    strength = F.when(back, F.when(F.col("inferred") | F.col("p_inferred"), "indicative").otherwise("corroborated"))
    return _signal(pairs, "clock_skew", strength, {"event_time": F.lit(True), "record_number": F.lit(True), **seen}, assumed, tolerance)


def duplicates(rows: DataFrame, flagged: Column | None = None) -> DataFrame:
    """Consecutive members of one message that aren't one source line read twice. Rows that ingestion flagged are left out."""
    rows = (rows if flagged is None else rows.where(~flagged)).withColumn("digest", F.sha2("display_message", 256))
    take = ["record_id", "event_time", "dataset_id", "source_id", "record_number", "message_id", "operation"]
    pairs = _pairs(rows, ["key", "digest"], ["event_time", "record_id"], take)
    same = lambda c: F.coalesce(F.col(c) == F.col(f"p_{c}"), F.lit(False))
    differ = lambda c: F.coalesce(F.col(c) != F.col(f"p_{c}"), F.lit(False))
    one_line = same("dataset_id") & F.col("source_id").eqNullSafe(F.col("p_source_id")) & F.col("record_number").eqNullSafe(F.col("p_record_number"))
    strength = F.when(same("message_id"), "documented").when(same("operation"), "corroborated").otherwise("indicative")
    agree = {"message": F.lit(True), "message_id": same("message_id"), "operation": same("operation")}
    return _signal(pairs, "operational_duplicate", F.when(~one_line & ~differ("message_id") & ~differ("operation"), strength), agree, {n: ~c for n, c in agree.items() if n != "message"})


def signals(rows: DataFrame, attempt: Column | None = None) -> DataFrame:
    """Signals of all kinds; times that ingestion had to infer count as such."""
    guess = inferred(rows) if "provenance_json" in rows.columns else None
    return retries(rows, attempt).unionByName(gaps(rows, inferred=guess)).unionByName(clock_skews(rows, inferred=guess)).unionByName(duplicates(rows))


def neighbourhood(logs: DataFrame, anchor_time: int, anchor_id: str, tolerance: int, equal: dict[str, object], most: int | None = None) -> DataFrame:
    """Rows within ``tolerance`` of the anchor, both ends included, that share the named
    fields; the nearest first, all unless ``most`` are asked for. They are probable neighbours, never more."""
    near = F.col("event_time").between(anchor_time - tolerance, anchor_time + tolerance) & (F.col("record_id") != anchor_id)
    for name, value in equal.items():
        near &= F.col(name).eqNullSafe(F.lit(value))
    rows = logs.where(near).withColumn("delta", F.col("event_time") - anchor_time).withColumn("confidence", F.lit("probable"))
    ordered = rows.orderBy(F.abs("delta"), "event_time", "record_id")
    return ordered if most is None else ordered.limit(most)


#: Rows of one time bucket and fields beyond which they are dealt out by several keys.
HOT_BUCKET = 1_000_000


def neighbourhoods(anchors: DataFrame, logs: DataFrame, tolerance: int, equal: Sequence[str], most: int | None = None) -> DataFrame:
    """``(anchor_dataset, anchor_id, dataset_id, record_id, delta, confidence[, cut])``: what ``neighbourhood`` finds, for many anchors at once.

    Time is cut into buckets of twice the tolerance, so that an anchor's interval meets two at most: anchors are copied into both,
    other rows stay in their own, and the two meet by bucket and ``equal`` fields, nulls being equal. A bucket with more than
    ``HOT_BUCKET`` rows is split by record, its anchors copied to each part. Undated rows have no neighbours. With ``most`` each anchor
    keeps its nearest, and ``cut`` is the number of the others.
    """
    width = 2 * tolerance + 1
    at = lambda t: F.expr(f"({t}) div {width}") - F.when(F.expr(f"({t}) % {width} < 0"), 1).otherwise(0)
    fields = [F.col(c).alias(f"of_{i}") for i, c in enumerate(equal)]
    of = [f"of_{i}" for i in range(len(equal))]
    near = logs.where("event_time is not null").select("dataset_id", "record_id", "event_time", at("event_time").alias("bucket"), *fields)
    asked = anchors.where("event_time is not null").select(
        F.col("dataset_id").alias("anchor_dataset"), F.col("record_id").alias("anchor_id"), F.col("event_time").alias("anchor_time"),
        F.explode(F.sequence(at(f"event_time - {tolerance}"), at(f"event_time + {tolerance}"))).alias("bucket"), *fields,
    )
    key = F.xxhash64("bucket", *of)
    hot = near.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKET).select("key", F.ceil(F.col("n") / HOT_BUCKET).alias("parts"))
    near = near.withColumn("key", key).join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("record_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    asked = asked.withColumn("key", key).join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    a, b = asked.alias("a"), near.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.bucket") == F.col("b.bucket"))
    for c in of:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    delta = F.col("b.event_time") - F.col("a.anchor_time")
    itself = (F.col("a.anchor_id") == F.col("b.record_id")) & (F.col("a.anchor_dataset") == F.col("b.dataset_id"))
    found = a.join(b, same & delta.between(-tolerance, tolerance) & ~itself).select("anchor_dataset", "anchor_id", "dataset_id", "record_id", delta.alias("delta"), F.lit("probable").alias("confidence"))
    if most is None:
        return found
    own = W.partitionBy("anchor_dataset", "anchor_id")
    place = F.row_number().over(own.orderBy(F.abs("delta"), "delta", "record_id", "dataset_id"))
    return found.withColumns({"place": place, "cut": F.greatest(F.count("*").over(own) - most, F.lit(0))}).where(F.col("place") <= most).drop("place")
