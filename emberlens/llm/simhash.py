"""SimHash near-duplicates of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlens.llm import gray_index
from emberlens.llm.common import materialise, small, whole_text
from emberlens.llm.components import connected_components

SHINGLE, SEED, BITS = 4, 42, 4
#: Shingles whose bits are added up at a time.
_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is 1 in over half of the shingles' hashes; 0 without words."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        bits = np.unpackbits(hashes[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(id, code)``: the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            codes = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], [id_col, "code"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("text_")).mapInArrow(run, f"`{id_col}` {kind}, code long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row: texts whose fingerprints
    differ in at most ``bits`` bits are linked, and a component is named by its
    smallest id.

    Null and empty texts, and those of white space, have fingerprint zero and link
    like any other. Texts of any length are read whole; other columns, of any name, are left out. Null ids take the name of their component, null if it has no
    other id. Rows of one id each give a row. An empty table gives no rows.
    Fingerprints are computed once and written; equal ones are one from there on, so
    a group of copies weighs as much as one text, and joins back as one row.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    codes = materialise(prints.groupBy("code").agg(F.min(id_col).alias("least_id")), "simhash-codes")
    named = connected_components(gray_index.link(codes, bits)).select(F.col("node").alias("code"), "root")
    rooted = codes.join(named, "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_code = rooted.join(least, "root").select("code", "component_id")
    return prints.join(of_code, "code").select(id_col, F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but one of each component of
    ``near_duplicates``: the one of the smallest id, null ids last, then of the smallest hash of its text, however the table is
    split. Null, empty and very long texts and empty tables are as there.

    Rows are written once beside their fingerprints and stay where they are: what meets them is the table of
    the rows that go, numbers alone, which is broadcast if it is small.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            codes = np.array([fingerprint(t or "", shingle, seed) for t in batch.column(0).field(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc", "code"])

    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField("code", T.LongType())])
    coded = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).mapInArrow(run, schema)
    stored = materialise(coded.withColumn("row", F.monotonically_increasing_id()), "simhash-rows")
    codes = materialise(stored.select("code").distinct(), "simhash-codes")
    named = connected_components(gray_index.link(codes, bits)).select(F.col("node").alias("code"), "root")
    place = F.struct(F.col(f"doc.`{id_col}`").isNull().alias("no_id"), F.col(f"doc.`{id_col}`").alias("id"), F.xxhash64(F.col(f"doc.`{text_col}`")).alias("text"), "row")
    of_code = stored.groupBy("code").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(named, "code", "left").withColumn("root", F.coalesce("root", "code"))
    kept = of_code.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("root", F.col("first.row").alias("kept"))
    many = of_code.join(kept, "root").select("code", "kept")  # a row a fingerprint of components of several rows
    gone = materialise(stored.select("code", "row").join(many, "code").where(F.col("row") != F.col("kept")).select("row"), "simhash-gone")
    return stored.join(small(gone), "row", "left_anti").select("doc.*")
