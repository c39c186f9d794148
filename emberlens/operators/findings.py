"""Findings: rules over comparisons and signals, with a severity from a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the rules, bands of magnitude, and the table of severities.
NEW_LEAST, INCREASED_LEAST, DISAPPEARED_LEAST, SIGNALS_LEAST = 5, 10, 5, 3
CONCENTRATED_KEYS, CONCENTRATED_BP = 3, 8000
BP_BANDS, SHARE_BANDS, COUNT_BANDS = (5000, 20_000), (9000, 9500), (3, 10)
TABLE = {"fatal": ("medium", "high", "high"), "error": ("low", "medium", "high"), "warn": ("low", "low", "medium")}
OTHERWISE = ("informational", "informational", "low")


def ceiling(number: Column) -> Column:
    out = F.lit("unknown")
    for name, low in (("trace", 1), ("debug", 5), ("info", 9), ("warn", 13), ("error", 17), ("fatal", 21)):
        out = F.when(number.between(low, low + 3), F.lit(name)).otherwise(out)
    return out


def _band(value: Column, bands: tuple[int, int]) -> Column:
    return F.when(value >= bands[1], 2).when(value >= bands[0], 1).otherwise(0)


def severity(of: Column, magnitude: Column) -> Column:
    pick = lambda row: F.get(F.array(*map(F.lit, row)), magnitude)
    out = pick(OTHERWISE)
    for name, row in TABLE.items():
        out = F.when(of == name, pick(row)).otherwise(out)
    return out


def _rows(df: DataFrame, rule: str, subject: Column, confidence: Column | str, of: Column, magnitude: Column, value: Column) -> DataFrame:
    sure = F.lit(confidence) if isinstance(confidence, str) else confidence
    return df.select(
        F.lit(rule).alias("rule"), subject.alias("subject"), severity(of, magnitude).alias("severity"), sure.alias("confidence"), of.alias("ceiling"),
        F.get(F.array(*map(F.lit, ("small", "moderate", "large"))), magnitude).alias("magnitude"), value.cast("long").alias("measured"),
    )


def from_comparison(rows: DataFrame) -> DataFrame:
    """``new-high-severity-pattern``, ``increased-error-pattern``, ``disappeared-pattern`` of a comparison's rows."""
    of, key = ceiling(F.col("ceiling")), F.col("key")
    count = lambda c, least: _band(c, tuple(least * x for x in COUNT_BANDS))
    bp = F.when(F.col("rate_change_bp") != "undefined", F.col("rate_change_bp")).cast("decimal(38,0)")
    new = rows.where((F.col("classification") == "new") & (F.col("suspect") >= NEW_LEAST) & (F.col("ceiling") >= 13))
    more = rows.where((F.col("classification") == "increased") & (F.col("suspect") >= INCREASED_LEAST) & (F.col("ceiling") >= 17))
    gone = rows.where((F.col("classification") == "disappeared") & (F.col("baseline") >= DISAPPEARED_LEAST))
    return (
        _rows(new, "new-high-severity-pattern", key, "measured", of, count(F.col("suspect"), NEW_LEAST), F.col("suspect"))
        .unionByName(_rows(more, "increased-error-pattern", key, "measured", of, _band(bp, BP_BANDS), F.col("suspect")))
        .unionByName(_rows(gone, "disappeared-pattern", key, "measured", of, count(F.col("baseline"), DISAPPEARED_LEAST), F.col("baseline")))
    )


#: A finding's confidence by its strongest evidence, from indicative to documented.
STRENGTHS, CONFIDENCE = ("indicative", "corroborated", "documented"), ("indicative", "corroborated", "measured")


def _rank(strength: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STRENGTHS)), strength).cast("int") - 1


def ordered(found: DataFrame) -> DataFrame:
    """Findings by severity, confidence, rule and subject, the gravest first."""
    grave = F.array_position(F.array(*map(F.lit, ("informational", "low", "medium", "high"))), F.col("severity"))
    sure = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    return found.orderBy(grave.desc(), sure.desc(), "rule", "subject")


def from_signals(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``repeated-retry-signal``, ``operational-duplicate``, ``clock-skew-warning`` of keys with enough signals of a kind."""
    names = {"retry": "repeated-retry-signal", "operational_duplicate": "operational-duplicate", "clock_skew": "clock-skew-warning"}
    n = found.where(F.col("kind").isin(*names)).groupBy("key", "kind").agg(F.count("*").alias("n"), F.max(_rank(F.col("strength"))).alias("sure"))
    of_key = rows.groupBy("key").agg(F.max("severity_number").alias("ceiling"))
    hits = n.where(F.col("n") >= SIGNALS_LEAST).join(of_key, "key", "left")
    out = None
    for kind, rule in names.items():
        part = _rows(
            hits.where(F.col("kind") == kind), rule, F.col("key"), F.get(F.array(*map(F.lit, CONFIDENCE)), F.col("sure")), ceiling(F.col("ceiling")),
            _band(F.col("n"), tuple(SIGNALS_LEAST * x for x in COUNT_BANDS)), F.col("n"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def shares(rows: DataFrame) -> DataFrame:
    """``(keys, share, ceiling)``: what part of all change the three keys of the largest change
    make, in basis points; of comparisons with more than three keys and any change."""
    changed = rows.select("key", F.abs(F.col("suspect") - F.col("baseline")).alias("change"), "ceiling")
    leading = changed.orderBy(F.desc("change"), "key").limit(CONCENTRATED_KEYS).agg(F.sum("change").alias("part"), F.max("ceiling").alias("ceiling"))
    total = changed.agg(F.count("*").alias("keys"), F.sum("change").alias("whole")).crossJoin(leading)  # a row each
    return total.where((F.col("keys") > CONCENTRATED_KEYS) & (F.col("whole") > 0)).select("keys", F.expr("part * 10000 div whole").alias("share"), "ceiling")


def concentrated(rows: DataFrame, dimension: str) -> DataFrame:
    """Whether those three keys make most of all change."""
    hit = shares(rows).where(F.col("share") >= CONCENTRATED_BP)
    return _rows(hit, "concentrated-dimension-change", F.lit(dimension), "measured", ceiling(F.col("ceiling")), _band(F.col("share"), SHARE_BANDS), F.col("share"))
