"""Audit of how sources differ in their words, by tiles of group blocks.

A group is a source in a language. Its smoothed word shares are compared with those of each other source of the language
and with the language's own. For the pairs, each group's counts are packed into a vector for each chunk of the vocabulary, and groups
are put in blocks. A vector is replicated to each tile of two blocks that its block is in; a tile's task works through successive chunks
and holds the counts of one chunk and the sums of its own pairs, whatever the vocabulary. All numbers are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.llm.byte_words import chunks, cut
from emberlens.llm.common import materialise, whole_text

#: Groups of a block, terms of a chunk, and chunks that one tile's task works through.
BLOCK, CHUNK, SPAN = 16, 4_096, 256
#: Shares are in parts of UNIT; SMOOTH is added to each count.
UNIT, SMOOTH = 1_000_000_000, 5
#: Groups whose totals are broadcast, and entries that a counting task holds.
BROADCAST_GROUPS, ENTRIES = 100_000, 1_000_000
#: Of a byte: small letters and bytes of other scripts stay, A-Z as a-z, others 0.
_LOWER = np.array([b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint8)
_COUNTS = "lang string, source string, term string, n long, docs long"
_SUMS = [("n", "sum"), ("docs", "sum")]
_KEYS = ["lang", "source", "term"]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: how often a term occurs in a group's texts and in how many of them, in parts that are to be
    summed. Each task sums what it has read before anything is shuffled."""

    most = ENTRIES

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for first, data, ends in chunks(batch.column(2)):
                low = _LOWER[data]
                words, doc = cut(low, ends, low != 0)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                size = len(coded.dictionary)
                each, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
                pair, place = np.unique(group[first + each // size] * size + each % size, return_inverse=True)
                g, term = pair // size, pa.array(pair % size)
                columns = [langs.dictionary.take(pa.array(g // len(sources.dictionary))), sources.dictionary.take(pa.array(g % len(sources.dictionary))), coded.dictionary.take(term).cast(pa.string())]
                sums = [np.bincount(place, n).astype(np.int64), np.bincount(place)]
                held.append(pa.table([*columns, *map(pa.array, sums)], [*_KEYS, "n", "docs"]))
                rows += len(pair)
                if rows > most:
                    held = [_summed(held)]
                    rows = len(held[0])
                    if rows > most // 2:
                        yield from held.pop().to_batches()
                        rows = 0
        if held:
            yield from _summed(held).to_batches()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)]
    return docs.select(named[0].alias("lang"), named[1].alias("source"), whole_text(text_col).alias("text")).mapInArrow(count, _COUNTS)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate(_SUMS).rename_columns([*_KEYS, "n", "docs"])


def kept_terms(counts: DataFrame, least_docs: int = 30) -> DataFrame:
    """``(lang, source, term, n, lang_n, first)`` of the terms that at least ``least_docs`` of their language's documents have; ``first`` is 1 in one
    row of each term of a language, else 0. Everything follows from one shuffle by language and term."""
    of_term = Window.partitionBy("lang", "term")
    return (
        counts.repartition("lang", "term")
        .groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns({"docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": (F.row_number().over(of_term.orderBy("source")) == 1).cast("int")})
        .where(F.col("docs") >= least_docs).drop("docs")
    )


def group_totals(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, place, total, lang_total, v)`` of each of ``groups(lang, source)``: its number within its language, its and its
    language's occurrences of kept terms, and how many terms are kept."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    lang = Window.partitionBy("lang")
    return (
        groups.distinct().join(totals, ["lang", "source"], "left")
        .select("lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("place"), F.coalesce("total", F.lit(0)).alias("total"),
                F.coalesce(F.sum("total").over(lang), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("firsts").over(lang), F.lit(0)).alias("v"))
    )


def share(n: Column, total: Column, v: Column) -> Column:
    """``1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * v))`` in whole numbers."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(n + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + SMOOTH * v)) + 1


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """``share`` of each count, by long division in three steps of 1,000, which stay within 64 bits."""
    rest, out = n.astype(np.int64) + SMOOTH, np.zeros(len(n), np.int64)
    for _ in range(3):
        rest *= 1_000
        out = out * 1_000 + rest // whole
        rest %= whole
    return out + 1


def pair_sums(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each two sources of a language, either way round: the sum of the differences of their
    shares over all kept terms, those that neither has included."""
    chunk_of = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / CHUNK))
    placed = kept.join(small_groups(totals.select("lang", "source", "place", "v")), ["lang", "source"]).withColumn("chunk", chunk_of)
    vectors = (
        placed.withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
        .groupBy("lang", "chunk", "place").agg(F.collect_list(F.struct("at", "n")).alias("packed"))
        .select("lang", "place", "chunk", F.col("packed.at").alias("at"), F.col("packed.n").alias("n"))
    )
    blocks = totals.groupBy("lang").agg(F.floor(F.max("place") / BLOCK).cast("int").alias("last_block"), F.max("v").alias("v"))
    spans = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.ceil(F.col("v") / CHUNK) / SPAN) - 1, F.lit(0)))
    heads = totals.join(blocks.drop("v"), "lang").withColumn("span", F.explode(spans)).select(
        "lang", "place", "last_block", "span", F.lit(-1).cast("long").alias("chunk"), F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("n"), "source", "total", "v"
    )
    bodies = vectors.join(F.broadcast(blocks.drop("v")) if _few(totals) else blocks.drop("v"), "lang").select(
        "lang", "place", "last_block", F.floor(F.col("chunk") / SPAN).alias("span"), "chunk", "at", "n", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("v")
    )
    own = F.floor(F.col("place") / BLOCK).cast("int")
    tiles = (
        heads.unionByName(bodies).withColumn("other", F.explode(F.sequence(F.lit(0), "last_block")))
        .select("lang", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), "span", "chunk", "place", "at", "n", own.alias("own"), "source", "total", "v")
    )
    order = ["lang", "a", "b", "span"]
    sums = tiles.repartition(*order).sortWithinPartitions(*order, "chunk", "place").mapInArrow(_tiles, "lang string, source string, item string, value long, columns long, v long, apart long")
    whole = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("columns").alias("columns"), F.first("v").alias("v"), F.first("apart").alias("apart"))
    value = (F.col("value") + (F.col("v") - F.col("columns")) * F.col("apart")).alias("value")
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return whole.select("lang", value, F.explode(both).alias("pair")).select("lang", "pair.source", "pair.item", "value")


def _tiles(batches):
    """The pairs' sums of each tile and span in a partition, in which a tile's groups come first and then their vectors, by chunk.
    ``columns`` counts the terms that were compared, ``apart`` is what each other term adds."""
    tile = None
    for batch in batches:
        rows = [batch.column(i).to_pylist() for i in range(6)] + [batch.column(i) for i in (6, 7)] + [batch.column(i).to_pylist() for i in range(8, 12)]
        for i in range(batch.num_rows):
            lang, a, b, span, chunk, place, at, n, own, source, total, v = (c[i] for c in rows)
            if tile is None or tile.key != (lang, a, b, span):
                if tile is not None:
                    yield tile.sums()
                tile = _Tile((lang, a, b, span), v)
            if chunk < 0:
                tile.group(place, own, source, total)
            else:
                tile.vector(chunk, place, at.values.to_numpy(), n.values.to_numpy())
    if tile is not None:
        yield tile.sums()


class _Tile:
    """Sums of the differences between the groups of two blocks, or within one."""

    def __init__(self, key: tuple, v: int):
        self.key, self.v, self.columns, self.chunk = key, v, 0, -1
        self.names, self.places, self.wholes, self.left = [], {}, [], []
        self.vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.total = None

    def group(self, place: int, block: int, source: str, total: int) -> None:
        self.places[place] = len(self.names)
        self.names.append(source)
        self.left.append(self.key[1] == block)
        self.wholes.append(total + SMOOTH * self.v)

    def vector(self, chunk: int, place: int, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self._close()
            self.chunk = chunk
        self.vectors[self.places[place]] = at, n

    def _sides(self) -> tuple[np.ndarray, np.ndarray]:
        left = np.array(self.left)
        rows = np.flatnonzero(left)
        return rows, rows if self.key[1] == self.key[2] else np.flatnonzero(~left)

    def _absent(self) -> np.ndarray:
        return np.array([shares(np.zeros(1, np.int64), w)[0] if w else 0 for w in self.wholes])

    def _close(self) -> None:
        if self.total is None:
            self.absent = self._absent()
            self.rows, self.cols = self._sides()
            self.total = np.zeros((len(self.rows), len(self.cols)), np.int64)
        if not self.vectors:
            return
        width = 1 + max(int(at.max()) for at, _ in self.vectors.values())
        dense = np.repeat(self.absent[:, None], width, 1)
        for g, (at, n) in self.vectors.items():
            dense[g, at] = shares(n, self.wholes[g])
        others = dense[self.cols]
        for k, g in enumerate(self.rows):
            self.total[k] += np.abs(others - dense[g]).sum(1)
        self.columns += width
        self.vectors = {}

    def sums(self) -> pa.RecordBatch:
        self._close()
        i, j = np.nonzero(self.rows[:, None] < self.cols[None, :]) if self.key[1] == self.key[2] else np.nonzero(np.ones_like(self.total))
        a, b = self.rows[i], self.cols[j]
        names, n = pa.array(self.names, pa.string()), len(a)
        one = lambda x, kind: pa.array([x] * n, kind)
        apart = np.abs(self.absent[a] - self.absent[b]) if n else np.zeros(0, np.int64)
        columns = [one(self.key[0], pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(self.total[i, j]), one(self.columns, pa.int64()), one(self.v, pa.int64()), pa.array(apart)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value", "columns", "v", "apart"])


def _few(totals: DataFrame) -> bool:
    return totals.count() <= BROADCAST_GROUPS


def small_groups(totals: DataFrame) -> DataFrame:
    """A row a group, marked for broadcast if there are at most ``BROADCAST_GROUPS``; else Spark joins by a shuffle and splits hot groups."""
    return F.broadcast(totals) if _few(totals) else totals


def term_excess(kept: DataFrame, totals: DataFrame, most: int | None = 50) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms that a group uses more than its language does, by how much more; each task passes on
    its own ``most`` of a group. All of them where ``most`` is None."""
    known = kept.join(small_groups(totals), ["lang", "source"])
    more = known.select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).alias("value")).where("value > 0")
    ranked = more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int | None = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has each group's distance from each other source of its language, part ``term`` the
    terms it has in excess; both ranked by value, ties by item.

    Null texts, languages and sources are as empty ones. Groups whose texts have no terms, or whose language keeps none, are there: their shares are
    those of no occurrences, and all distances are 0 where no term is kept. Texts are read whole, a repeated row counts again, other
    columns, of any name, are left out, an empty table gives no rows. Counts, kept terms and totals are written once.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    kept = materialise(kept_terms(counts, least_docs), "divergence-terms")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    totals = materialise(group_totals(groups, kept), "divergence-groups")
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(kept, totals).withColumn("rank", F.row_number().over(by_rank))
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int")) for part, df in (("pair", pairs), ("term", term_excess(kept, totals, most_terms)))]
    return parts[0].unionByName(parts[1])
