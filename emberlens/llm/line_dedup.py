"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text are hashed; a hash that occurs again, in
whatever document, marks its lines there; marked windows that touch are merged and
their lines removed. Lines of texts are hashed in place: what is shuffled is two
longs and a position a window, and the texts once, to meet their removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.llm.common import materialise, whole_text

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, pos, h1, h2)`` of ``docs(row, text_)``: 128 bits of hash for each run of
    ``window`` lines, two of 64 bits from the lines on, but not of blank ones only. A line counts without the
    spaces around it."""
    both = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))
    clean = F.transform(_lines(F.col("text_")), lambda x: both(F.trim(x)))
    blank = F.xxhash64(F.lit(""))
    starts = F.when(F.size("hashes") >= window, F.sequence(F.lit(0), F.size("hashes") - window)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.slice("hashes", i + 1, window).alias("run")))
    return (
        docs.select("row", clean.alias("hashes"))
        .select("row", F.inline(F.filter(runs, lambda r: F.exists(r["run"], lambda h: h["a"] != blank))))
        .select("row", "pos", F.xxhash64("run.a").alias("h1"), F.xxhash64("run.b").alias("h2"))
    )


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, removed)``: for rows with lines to remove, the merged runs of
    positions, as structs of begin and end (past the last), in order."""
    found = materialise(windows(docs, window), "line-windows")
    first = (
        found.groupBy("h1", "h2")
        .agg(F.min(F.struct("row", "pos")).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("h1", "h2", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"))
    )
    overlaps_first = F.col("row").eqNullSafe(F.col("first_row")) & (F.col("pos") < F.col("first_pos") + window)
    later = found.join(first, ["h1", "h2"]).where(~overlaps_first).select("row", "pos")
    in_row = Window.partitionBy("row").orderBy("pos")
    apart = F.coalesce((F.col("pos") - F.lag("pos").over(in_row) > window).cast("int"), F.lit(1))
    return (
        later.withColumn("apart", apart)
        .withColumn("run", F.sum("apart").over(in_row))
        .groupBy("row", "run")
        .agg(F.min("pos").alias("begin"), (F.max("pos") + window).alias("end"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("removed"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, n_lines, n_removed, text)`` for each row of ``docs``.

    The first occurrence of a window is the one of the smallest (id, hash of the
    text, position), null ids first; occurrences that overlap the first in its own
    row belong to it. Texts of fewer lines than a window lose none; null texts stay
    null with no lines. Rows of one id and text count as one and get the same result
    each. A window of very many occurrences is one row of the table of firsts, and
    joins its occurrences in partitions that Spark may split.
    """
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    named = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), row.alias("row"))
    runs = repeated_runs(named.where(F.col("text_").isNotNull()).select("row", whole_text("text_").alias("text_")), window)
    keyed = named.select("id_", "text_", F.col("row.id").alias("k1"), F.col("row.hash").alias("k2"))
    runs = runs.select(F.col("row.id").alias("r1"), F.col("row.hash").alias("r2"), "removed")
    lines, removed = _lines(F.col("text_")), F.coalesce("removed", F.array().cast("array<struct<begin:int,end:int>>"))
    begins = F.concat(F.array(F.lit(0)), F.col("removed.end"))
    ends = F.concat(F.col("removed.begin"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice("lines", b + 1, e - b)))
    return (
        keyed.join(runs, F.col("k1").eqNullSafe(F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
        .select("id_", "text_", F.when(F.col("text_").isNotNull(), lines).alias("lines"), removed.alias("removed"))
        .select(
            F.col("id_").alias(id_col),
            F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.aggregate("removed", F.lit(0), lambda n, r: n + r["end"] - r["begin"]).cast("long").alias("n_removed"),
            F.when(F.size("removed") == 0, F.col("text_")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        )
    )
