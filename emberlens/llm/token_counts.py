"""Token counts by a map-side two-tier lookup.

Tier one is a table of the most frequent pre-tokens' lengths, broadcast to all
tasks and looked up first; tier two is each worker's cache of what it has encoded itself. Texts and their
pre-tokens are never shuffled. The table alone takes one small shuffle: each task sums up all it has read in at
most ``SUMMARY`` entries, and these are added up.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm import pretoken
from emberlens.llm.common import whole_text

#: Pre-tokens in the broadcast table.
FREQUENT = 16_384
#: Pre-tokens that one task reports, and counters it holds meanwhile.
SUMMARY, COUNTERS = 2_048, 100_000


def frequent_pretokens(docs: DataFrame, tokenizer: str, text_col: str = "text", size: int = FREQUENT) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their numbers of ids: at most
    ``size`` rows reach the driver. Each task counts all of its texts; pre-tokens
    that a batch of texts has once, and a task's rarest beyond ``COUNTERS`` counters,
    are not counted on, which costs speed, never a result."""

    def summarise(batches):
        coder, counts = pretoken.worker(tokenizer), Counter()
        with pretoken.uncollected():
            for batch in batches:
                for data, ends in coder.shared(batch.column(0)):
                    distinct, numbers, _ = coder.pieces(data, ends)
                    n = np.bincount(numbers, minlength=len(distinct))
                    for i in np.flatnonzero(n > 1).tolist():
                        counts[distinct[i]] += int(n[i])
                if len(counts) > COUNTERS:
                    counts = Counter(dict(counts.most_common(COUNTERS // 2)))
        top = counts.most_common(SUMMARY)
        n_ids = coder.values([w for w, _ in top], {}, pretoken.n_ids, sum)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64()), pa.array(n_ids, pa.int64())],
            ["pretoken", "n", "n_ids"],
        )

    rows = (
        docs.select(whole_text(text_col).alias("text"))
        .mapInArrow(summarise, "pretoken string, n long, n_ids long")
        .groupBy("pretoken", "n_ids")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pretoken")
        .limit(size)
        .collect()
    )
    return {r["pretoken"]: r["n_ids"] for r in rows}


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    frequent: dict[str, int] | None = None,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``, in place.

    A null text counts as empty: no bytes, no tokens. Null ids, repeated rows and
    other columns of any name are allowed; each row gives a row. An empty table
    gives an empty result. Texts of any length are counted whole.
    """
    if frequent is None:
        frequent = frequent_pretokens(docs, tokenizer, text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(batches):
        coder = pretoken.worker(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            with pretoken.uncollected():
                n = list(coder.count(texts, table.value))
            n_bytes = pa.compute.cast(pa.compute.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("text_")).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
