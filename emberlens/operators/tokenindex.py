"""An index of words: which records have which, so that terms and phrases open a few rows instead of all.

Postings are ``(token, dataset_id, record_id)``, in folders by the hash of the token and sorted by it within files, so that a look-up reads one
folder's row groups. What it finds are candidates; the filter itself has the last word, and rows without an index are scanned.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.functions import predicates as P
from emberlens.sources import ingest

#: Folders of an index, and shares that a folder's postings are written by.
BUCKETS, SHARES = 64, 8
#: Fixed pattern: a word is a maximal run of letters and digits.
WORD = r"[\p{L}\p{N}]+"
POSTINGS = "token string, dataset_id string, record_id string, bucket int"
BUILT = "run string, path string, postings long"


def folded(word: Column) -> Column:
    """Alike for all words that a filter in any case takes for one. What stands between the changes of case keeps the optimiser from taking
    them for one."""
    plain = lambda x: F.replace(x, F.lit("\u0307"), F.lit(""))
    return F.lower(plain(F.upper(plain(F.lower(word)))))


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, text: Column) -> DataFrame:
    """``(token, dataset_id, record_id)``, one for each distinct word of a row; null texts have none."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), folded))
    return rows.select(F.explode(words).alias("token"), "dataset_id", "record_id")


def write(rows: DataFrame, path: str, text: Column | None = None) -> None:
    """Writes the postings of ``rows``. A folder is several tasks' work, so that a word of a third of all rows is no single one's."""
    found = postings(rows, F.col("display_message") if text is None else text).withColumn("bucket", bucket(F.col("token")))
    dealt = found.repartition("bucket", F.pmod(F.xxhash64("record_id"), F.lit(SHARES))).sortWithinPartitions("bucket", "token")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    parts = [spark.read.schema(POSTINGS).parquet(p) for p in paths]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], POSTINGS)


def candidates(index: DataFrame, text: str) -> DataFrame:
    """``(dataset_id, record_id)`` of the rows that have all words of ``text``, in any order; none without words. Folder and token are
    constants of the plan: other folders aren't listed, other row groups not read."""
    words = list(dict.fromkeys(P.tokens(text)))
    if not words:
        return index.select("dataset_id", "record_id").limit(0)
    tokens = [folded(F.lit(w)) for w in words]
    own = index.where(reduce(or_, [(F.col("bucket") == bucket(t)) & (F.col("token") == t) for t in tokens]))
    if len(words) == 1:
        return own.select("dataset_id", "record_id").distinct()
    n = F.size(F.array_distinct(F.array(*tokens)))
    return own.groupBy("dataset_id", "record_id").agg(F.count_distinct("token").alias("n")).where(F.col("n") == n).select("dataset_id", "record_id")


def search(logs: DataFrame, index: DataFrame, text: str, column: Column | None = None) -> DataFrame:
    """The rows of ``logs``, all of them in the index, that ``P.phrase`` keeps: the candidates alone are matched."""
    return logs.join(candidates(index, text), ["dataset_id", "record_id"], "left_semi").where(P.phrase(text, column))


# of published runs


def built(spark: SparkSession, warehouse: str) -> DataFrame:
    """``(run, path, postings)`` of the runs that have an index."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{warehouse}/index_manifest")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], BUILT)
    return spark.read.schema(BUILT).option("recursiveFileLookup", "true").parquet(f"{warehouse}/index_manifest")


def update(spark: SparkSession, warehouse: str) -> int:
    """Builds the index of the published runs that lack one, and says how many these were. A run's index counts from
    its manifest row on, so one that broke off is built again."""
    lacking = ingest.manifest(spark, warehouse).where("signal = 'logs'").join(built(spark, warehouse).select("run"), "run", "left_anti").select("run", "path").collect()
    for r in lacking:
        path = f"{warehouse}/index/{r['run']}"
        write(spark.read.schema(ingest.SCHEMAS["logs"]).parquet(r["path"]), path)
        spark.createDataFrame([(r["run"], path, read(spark, path).count())], BUILT).coalesce(1).write.mode("overwrite").parquet(f"{warehouse}/index_manifest/{r['run']}")
    return len(lacking)


def find(spark: SparkSession, warehouse: str, text: str, names: list[str] | None = None) -> DataFrame:
    """Published logs with the words of ``text`` one after the other, of indexed runs by their index, of others by a scan."""
    runs = ingest.manifest(spark, warehouse).where("signal = 'logs'")
    runs = runs.where(F.col("dataset_id").isin(names)) if names else runs
    rows = runs.join(built(spark, warehouse).select("run", F.col("path").alias("index")), "run", "left").select("path", "index").collect()  # a row a run
    of = lambda some: spark.read.schema(ingest.SCHEMAS["logs"]).parquet(*[r["path"] for r in some]) if some else spark.createDataFrame([], ingest.SCHEMAS["logs"])
    have, lack = [r for r in rows if r["index"]], [r for r in rows if not r["index"]]
    by_index = search(of(have), read(spark, *[r["index"] for r in have]), text)
    return by_index.select(*ingest.SCHEMAS["logs"].fieldNames()).unionByName(of(lack).where(P.phrase(text)))
