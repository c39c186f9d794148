"""Token ids of documents in one long array, cut by Elias-Fano boundaries.

A token table is a folder of Parquet files, one for each range of document ids. A
row is a block of documents in ascending order: ``ids`` are their ids end to end,
of 2 or 4 bytes as the vocabulary needs, ``ends`` the Elias-Fano code of where each
document ends within them, ``doc_ids`` the documents' ids. ``part`` and ``part_at``
place a block in the whole array: all ids of lower parts come first, then
``part_at`` ids of its own part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlens.llm import pretoken
from emberlens.llm.common import whole_text
from emberlens.llm.elias_fano import EliasFano, encode

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
SCHEMA = "part int, block int, part_at long, n_docs long, n_ids long, id_bytes int, doc_ids array<long>, ends binary, ids binary"
_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("part_at", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
        ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("ids", pa.binary()),
    ]
)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the token table ``path``.

    Documents are ordered by id, null first, rows of one id by their text's hash and
    text. Ids are whole numbers; text ids are an error. A null text counts as empty and gives the end id alone;
    repeated rows stay; texts of any length are encoded whole; other columns, of any name, are left out; an empty table gives an
    empty token table. Texts are dealt out by ranges of ids before they are encoded, so each is encoded once, in its place.
    """

    def blocks(batches):
        coder = pretoken.worker(tokenizer)
        width = 2 if max(coder.vocab_size - 1, end_id) < 1 << 16 else 4
        kind, end = f"<u{width}", np.array([end_id], "<u4").tobytes()
        part, block, at = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, ends, n = [], [], [], 0

        def row():
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "part": part, "block": block, "part_at": at, "n_docs": len(doc_ids), "n_ids": n, "id_bytes": width,
                        "doc_ids": doc_ids, "ends": encode(np.array(ends)), "ids": b"".join(ids),
                    }
                ],
                _ARROW,
            )

        for batch in batches:
            with pretoken.uncollected():
                codes = list(coder.encode(batch.column(1)))
            for doc_id, code in zip(batch.column(0).to_pylist(), codes):
                own = np.frombuffer(code + end, "<u4")
                n += len(own)
                doc_ids.append(doc_id)
                ids.append(own.astype(kind).tobytes())
                ends.append(n)
                if n >= BLOCK_IDS:
                    yield row()
                    block, at = block + 1, at + n
                    doc_ids, ids, ends, n = [], [], [], 0
        if doc_ids:
            yield row()

    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError("a token table is ordered by whole numbers; text ids need a number first")
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id_"), whole_text(text_col).alias("text_"))
        .withColumn("hash_", F.xxhash64("text_"))  # the bounds of ranges are sampled from the keys, which therefore are small
        .repartitionByRange(F.asc_nulls_first("doc_id_"), F.asc("hash_"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id_"), "hash_", "text_")
        .mapInArrow(blocks, SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def part_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each part: a row a part, of which there are as many as files."""
    starts, at = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        starts[r["part"]] = at
        at += r["n"]
    return starts


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The documents of a token table: ``(id, start, n_tokens, ids_crc32[, ids])``.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the unsigned
    crc32 of the document's ids, the end id included, as little-endian unsigned
    32-bit integers. An empty table gives no rows.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    starts = part_starts(blocks)
    kind = pa.list_(pa.int32())

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                code = EliasFano(r["ends"])
                ends = np.fromiter(map(code.select, range(len(r["doc_ids"]))), np.int64, len(r["doc_ids"]))
                begins = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + (starts[r["part"]] + r["part_at"])), pa.array(ends - begins), pa.array(crc, pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate([begins[:1], ends]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype("<i4"))).cast(kind))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select("part", "part_at", "id_bytes", "doc_ids", "ends", "ids").mapInArrow(documents, schema)


def lookup(block, i: int) -> np.ndarray:
    """Document ``i``'s ids in one block's row, found by two selects."""
    ends = EliasFano(bytes(block["ends"]))
    begin, end = (ends.select(i - 1) if i else 0), ends.select(i)
    return np.frombuffer(block["ids"], f"<u{block['id_bytes']}", end - begin, begin * block["id_bytes"])
