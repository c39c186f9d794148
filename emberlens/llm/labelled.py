"""Folds of labelled documents, and bounded samples to fit models on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.llm.common import whole_text

#: Labelled documents and their characters that a model is fitted on, at most.
TRAIN_DOCS, TRAIN_CHARS = 6_000, 20_000_000
#: Share of the characters beyond which a text only gets what the others leave.
SHARE = 0.01


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; null ids fall in none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
    most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS, metadata_cols: Sequence[str] = (),
) -> list[tuple]:
    """``(whole text, label, *metadata)`` of labelled documents, of the first ``most_docs`` by a hash
    of their ids. One that doesn't fit in what is left of ``most_chars`` is passed over and the next is
    tried; those longer than ``SHARE`` of it come after all others, so that they take no other's place.

    Null labels and ids are left out; an id with several labels has the largest. Equal rows count once.
    Lengths come first, so only texts that are taken are moved.
    """
    some = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id_"))
        .agg(F.max(label_col).cast("int").alias("label_"))
        .orderBy(F.xxhash64("id_"), "id_")
        .limit(most_docs)
    )
    extra = [F.col(c).cast("double").alias(f"meta_{i}") for i, c in enumerate(metadata_cols)]
    names = [f"meta_{i}" for i in range(len(metadata_cols))]
    texts = docs.select(F.col(id_col).alias("id_"), whole_text(text_col).alias("text_"), *extra).join(F.broadcast(some), "id_")
    key = [F.xxhash64("id_").alias("by_"), F.length("text_").alias("size_"), F.xxhash64("text_", *names).alias("row_")]
    sizes = texts.select("id_", *key).distinct().orderBy("by_", "id_", "size_", "row_").limit(most_docs).drop("id_")
    taken, left = {}, most_chars
    for n, r in sorted(enumerate(sizes.collect()), key=lambda x: x[1]["size_"] > most_chars * SHARE):
        if r["size_"] <= left:
            taken[tuple(r)] = n
            left -= r["size_"]
    if not taken:
        return []
    chosen = docs.sparkSession.createDataFrame([(*k, n) for k, n in taken.items()], "by_ long, size_ int, row_ long, n_ int")
    rows = texts.select("text_", "label_", *names, *key).join(F.broadcast(chosen), ["by_", "size_", "row_"]).dropDuplicates(["n_"])
    return [tuple(r)[1:] for r in sorted(rows.select("n_", "text_", "label_", *names).collect(), key=lambda r: r["n_"])]
