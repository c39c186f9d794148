"""Comparison of a baseline window with a suspect window, key by key, in one pass."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.functions import predicates as P
from emberlens.functions.templates import template
from emberlens.operators.stacks import stack

#: Least count of a key, relative change in basis points and absolute change that count.
LEAST, RELATIVE_BP, ABSOLUTE, TOP = 5, 5000, 10, 100


def key_of(dimension: str, *attribute: str) -> Column:
    """A built-in dimension's key, or a text attribute's value; null where the row lacks it."""
    if dimension == "message_pattern":
        return template(F.col("display_message"))
    if dimension == "stack_fingerprint":
        return F.when(F.col("display_message").isNotNull(), stack(F.col("display_message"))["fingerprint"])
    if dimension == "severity":
        return F.coalesce("severity_text", F.lit("(none)"))
    if dimension in ("operation", "outcome", "event_name"):
        return F.col(dimension)
    if dimension == "resource":
        return F.col("resource_id")
    if dimension == "attribute":
        return F.when(P.attribute_type(*attribute) == "str", P.attribute(*attribute))
    raise ValueError(f"unknown dimension {dimension!r}")


def key_counts(logs: DataFrame, key: Column, baseline: tuple[int, int], suspect: tuple[int, int]) -> DataFrame:
    """``(key, baseline, suspect, ceiling)`` of dated rows in either half-open window."""
    t = F.col("event_time")
    inside = [(t >= a) & (t < b) for a, b in (baseline, suspect)]
    rows = logs.where(inside[0] | inside[1]).withColumn("key", key).where("key is not null")
    ceiling = F.max("severity_number") if "severity_number" in logs.columns else F.lit(None).cast("int")
    return rows.groupBy("key").agg(F.count_if(inside[0]).alias("baseline"), F.count_if(inside[1]).alias("suspect"), ceiling.alias("ceiling"))


def left_out(logs: DataFrame, key: Column, baseline: tuple[int, int], suspect: tuple[int, int]) -> DataFrame:
    """``(accepted_baseline, accepted_suspect, missing, undated)``."""
    t = F.col("event_time")
    inside = [F.coalesce((t >= a) & (t < b), F.lit(False)) for a, b in (baseline, suspect)]
    return logs.withColumn("key", key).agg(
        F.count_if(inside[0] & F.col("key").isNotNull()).alias("accepted_baseline"), F.count_if(inside[1] & F.col("key").isNotNull()).alias("accepted_suspect"),
        F.count_if((inside[0] | inside[1]) & F.col("key").isNull()).alias("missing"), F.count_if(t.isNull()).alias("undated"),
    )


def classify(counts: DataFrame, baseline: tuple[int, int], suspect: tuple[int, int]) -> DataFrame:
    """With ``classification`` and ``rate_change_bp``. Rates are compared crosswise in whole numbers, the durations without their common divisor."""
    durations = baseline[1] - baseline[0], suspect[1] - suspect[0]
    db, ds = (F.lit(d // gcd(*durations)).cast("decimal(38,0)") for d in durations)
    b, s = F.col("baseline").cast("decimal(18,0)"), F.col("suspect").cast("decimal(18,0)")
    sd, bd = (s * db).cast("decimal(33,0)"), (b * ds).cast("decimal(33,0)")
    change = (sd - bd).cast("decimal(33,0)")
    hit = (F.abs(change) * 10_000 >= bd * RELATIVE_BP) | (F.abs(F.col("suspect") - F.col("baseline")) >= ABSOLUTE)
    sign = F.when(change > 0, "increased").when(change < 0, "decreased").otherwise("unchanged")
    kind = (
        F.when((F.col("baseline") == 0) & (F.col("suspect") == 0), "insufficient")
        .when(F.col("baseline") == 0, F.when(F.col("suspect") >= LEAST, "new").otherwise("insufficient"))
        .when(F.col("suspect") == 0, F.when(F.col("baseline") >= LEAST, "disappeared").otherwise("insufficient"))
        .when(F.greatest("baseline", "suspect") < LEAST, "insufficient")
        .when(hit, sign)
        .otherwise("unchanged")
    )
    rate = F.when(bd == 0, "undefined").otherwise(F.expr("CAST(CAST(change_ * 10000 AS DECIMAL(38,0)) div base_ AS STRING)"))
    with_parts = counts.withColumn("change_", change).withColumn("base_", F.when(bd != 0, bd))
    return with_parts.withColumn("classification", kind).withColumn("rate_change_bp", rate).drop("change_", "base_")


def compare(logs: DataFrame, key: Column, baseline: tuple[int, int], suspect: tuple[int, int], most_keys: int | None = None) -> DataFrame:
    """Every key's row, in no order; of more than ``most_keys``, if given, those of the largest combined counts in order."""
    rows = classify(key_counts(logs, key, baseline, suspect), baseline, suspect)
    rows = rows.withColumn("combined", F.col("baseline") + F.col("suspect"))
    return rows if most_keys is None else top(rows, most_keys)


def top(rows: DataFrame, most: int = TOP) -> DataFrame:
    """The ``most`` keys of the largest combined counts."""
    return rows.orderBy(F.desc("combined"), "key").limit(most)


def remainder(rows: DataFrame, most: int = TOP) -> DataFrame:
    """``(keys, remainder_keys, remainder_baseline, remainder_suspect)`` beyond the top: all sums less the top's."""
    sums = lambda of, p: of.agg(F.count("*").alias(f"{p}keys"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{p}{c}") for c in ("baseline", "suspect")])
    both = sums(rows, "").crossJoin(F.broadcast(sums(top(rows, most), "top_")))
    return both.select("keys", *[(F.col(c) - F.col(f"top_{c}")).alias(f"remainder_{c}") for c in ("keys", "baseline", "suspect")])
