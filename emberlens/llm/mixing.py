"""Mixing sources to target weights.

Tokens are summed for each source, targets follow from weights, and each document
is emitted floor(rate) times plus once more with the rate's fraction as the
probability, where rate is its source's target by its source's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.llm.common import materialise, small

#: Fixed pattern of a word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose targets are broadcast: about 10 MB.
BROADCAST_SOURCES = 100_000
#: Equal rows that are dealt out to a task at a time.
TURNS = 1_000


def word_count(text_col: str = "text") -> Column:
    """Words of the text, null as none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``, one row a source.

    Sources in the order of their code points, null last, weigh as ``weights`` says,
    repeating. Targets share ``share`` of all sizes by weight; those above ``most``
    times their source's size stop there and their excess is shared again, until
    none is above. In the order of ``most * size / weight`` the stopped sources come
    first: a source stops if its bound is at most what the unstopped ones would get
    per unit of weight. Past the last stopped source that level only falls, so the
    largest level of an unstopped one holds for all. The windows run over one row a
    source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    named = totals.withColumn("weight", F.get(cycle, (F.row_number().over(in_order) - 1) % len(weights)))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.lit(share) * F.sum("source_size").over(everything)
        - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    stopped = F.lit(most) * F.col("source_size") <= F.col("weight") * F.col("level")
    return (
        named.withColumn("level", level)
        .withColumn("common", F.max(F.when(~stopped, F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            F.when(stopped, F.lit(most) * F.col("source_size")).otherwise(F.col("weight") * F.col("common")).alias("target"),
        )
    )


def draw_key(doc_id: Column, text: Column) -> Column:
    """What tells a row apart: its id and its text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc, size, source_size, target, copies)``: each row of ``docs`` as a struct, and
    how often the mix takes it; reruns agree.

    Null texts have size 0; the null source is a source of its own; a source with no
    words has target 0 and copies of 0. Rows draw by their id and text; rows that have both alike draw each for itself by
    their number among them. An empty table stays empty. Only sizes by source are shuffled. The table of targets has one row
    a source; it is broadcast if it has at most ``BROADCAST_SOURCES`` rows, else it
    joins by a shuffle whose large partitions Spark may split.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(whole.alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    targets = materialise(source_targets(sized.select("source", "size"), weights, share, most), "mix-targets").withColumnRenamed("source", "of_source")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = draw_key(F.col("id"), F.col(f"doc.`{text_col}`"))
    numbered = _numbered(sized.withColumn("key", key))
    copies = F.floor("rate") + (unit_draw(F.col("key"), seed) < F.col("rate") - F.floor("rate")).cast("int")
    return (
        numbered.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", rate)
        .select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))
    )


def _numbered(keyed: DataFrame) -> DataFrame:
    """``keyed``, in which keys that several rows have are followed by the hash of the whole row and its number among its equals, so that each
    draws for itself, however the table is split. What a small table of hashes finds once stays where it is; equal rows become one with
    their number, are summed before they are shuffled, and dealt out again ``TURNS`` at a time."""
    hashed = keyed.withColumn("hash_", F.xxhash64("key"))
    many = materialise(hashed.groupBy("hash_").agg(F.count("*").alias("n_")).where("n_ > 1").select("hash_"), "mix-repeated")
    if many.isEmpty():
        return keyed
    again = hashed.join(small(many), "hash_", "left_semi").groupBy(*keyed.columns).agg(F.count("*").alias("n_"))
    parts = again.withColumn("from_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1, F.lit(TURNS).cast("long")))).repartition("key", "from_")
    turns = parts.withColumn("turn_", F.explode(F.sequence(F.col("from_"), F.least(F.col("from_") + TURNS, F.col("n_")) - 1)))
    own = F.concat_ws(":", "key", F.xxhash64("doc").cast("string"), F.col("turn_").cast("string"))
    return hashed.join(small(many), "hash_", "left_anti").select(*keyed.columns).unionByName(turns.withColumn("key", own).select(*keyed.columns))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix``'s input, each as often as it is taken; null and empty texts, which weigh nothing, go with the others of
    their source. An empty table stays empty."""
    return mixed.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")
