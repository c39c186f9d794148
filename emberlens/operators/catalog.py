"""The field catalog: which attributes there are, of which types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Steps into nested maps, and examples kept with their length.
DEPTH, EXAMPLES, EXAMPLE_CHARS = 6, 3, 64
#: Fields of a dataset that ``bounded`` keeps, and distinct values up to which those of an interactive catalog are exact.
MOST_FIELDS, EXACT = 2_000, 1_024
#: Fixed pattern: what a queryable name must not have.
UNQUERYABLE = "[\\s()'\":=<>!*?\\\\/$\\[\\],]|[\\p{Cc}&&[^\x1f]]"


def attribute_rows(logs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(dataset_id, path, kind, value)``: each attribute of each row, nested ones with
    their steps. A row's maps are opened level by level within the row, by JSON functions, and all levels are
    exploded at once: the logs are scanned once."""
    cells = lambda json, above: F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: _cell(e, above))
    rows, levels = logs.select("dataset_id", cells(F.col("attributes_json"), None).alias("level_0")), ["level_0"]
    for n in range(1, depth):
        maps = F.filter(levels[-1], lambda c: c["kind"] == "map")
        opened = F.flatten(F.transform(maps, lambda c: F.coalesce(cells(c["value"], c["path"]), F.array().cast(_CELLS))))
        rows = rows.withColumn(f"level_{n}", opened)
        levels.append(f"level_{n}")
    return rows.select("dataset_id", F.inline(F.concat(*[F.coalesce(F.col(c), F.array().cast(_CELLS)) for c in levels])))


_CELLS = "array<struct<path:string,kind:string,value:string>>"


def _cell(entry: Column, above: Column | None) -> Column:
    path = entry["key"] if above is None else F.concat(above, F.lit("\x1f"), entry["key"])
    return F.struct(path.alias("path"), F.get_json_object(entry["value"], "$.t").alias("kind"), F.get_json_object(entry["value"], "$.v").alias("value"))


def field_catalog(logs: DataFrame, depth: int = DEPTH, exact_to: int | None = None) -> DataFrame:
    """``(dataset_id, path, steps, types, present, distinct, exact, example, examples, queryable)``: a field is
    queryable if its name has no white space, control character or sign of a query.

    Distinct values are counted exactly. With ``exact_to`` those of fields with more of them are estimated, and
    values of such fields aren't shuffled; their examples are the smallest and the largest."""
    rows = attribute_rows(logs, depth).where("kind <> 'map'")
    short, by = F.substring(F.col("value"), 1, EXAMPLE_CHARS), ["dataset_id", "path"]
    kinds = F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("types")
    three = lambda c: F.slice(F.sort_array(F.array_distinct(c)), 1, EXAMPLES)
    if exact_to is None:
        values = rows.groupBy(*by, "kind", "value").agg(F.count("*").alias("n"))
        ranked = values.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.asc_nulls_last("value"), "kind"))).where(F.col("rank") <= 2 * EXAMPLES)
        some = ranked.groupBy(*by).agg(three(F.collect_set(short)).alias("examples"))
        stats = values.groupBy(*by).agg(
            kinds, F.sum(F.when(F.col("kind") != "empty", F.col("n")).otherwise(0)).alias("present"), F.count_distinct("value").alias("distinct"), F.lit(True).alias("exact"), F.min(short).alias("example")
        ).join(some, by)
    else:
        rough = rows.groupBy(*by).agg(
            kinds, F.count_if(F.col("kind") != "empty").alias("present"), F.approx_count_distinct("value").alias("rough"), F.min(short).alias("example"), F.max(short).alias("last"),
        )
        few = rough.where(F.col("rough") <= exact_to).select(*by)  # a row a field
        counted = rows.join(few, by, "left_semi").groupBy(*by, "value").agg(F.lit(1)).groupBy(*by).agg(F.count("value").alias("counted"), three(F.collect_set(short)).alias("listed"))
        joined = rough.join(counted, by, "left")
        stats = joined.select(
            *by, "types", "present", F.coalesce("counted", "rough").alias("distinct"), F.col("counted").isNotNull().alias("exact"), "example",
            F.coalesce("listed", F.array_distinct(F.array("example", "last"))).alias("examples"),
        )
    return stats.select(
        "dataset_id", F.regexp_replace("path", "\x1f", ".").alias("path"), F.split("path", "\x1f").alias("steps"), "types", "present", "distinct", "exact", "example", "examples",
        (F.col("path").rlike("^[^\x1f]+(?:\x1f[^\x1f]+)*$") & ~F.col("path").rlike(UNQUERYABLE)).alias("queryable"),
    )


def bounded(catalog: DataFrame, most: int = MOST_FIELDS) -> DataFrame:
    """At most ``most`` fields of a dataset, those that most rows have, with ``cut``, how many it has beyond."""
    of = W.partitionBy("dataset_id")
    ranked = catalog.withColumn("rank", F.row_number().over(of.orderBy(F.desc("present"), "path"))).withColumn("cut", F.greatest(F.count("*").over(of) - most, F.lit(0)))
    return ranked.where(F.col("rank") <= most).drop("rank")


def merged(catalog: DataFrame) -> DataFrame:
    """Over datasets: types together, present summed, the largest distinct, exact and queryable if everywhere so.
    A name is ambiguous if it stands for different steps; one that no dataset has is simply not there."""
    kinds = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("types", ","))))), ",")
    examples = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("examples")))), 1, EXAMPLES)
    return catalog.groupBy("path").agg(
        kinds.alias("types"), F.sum("present").alias("present"), F.max("distinct").alias("distinct"), F.bool_and("exact").alias("exact"), examples.alias("examples"),
        F.bool_and("queryable").alias("queryable"), F.count_distinct("dataset_id").alias("datasets"), (F.count_distinct("steps") > 1).alias("ambiguous"),
    )
