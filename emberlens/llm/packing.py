"""Documents packed into sequences of a fixed number of tokens: best fit, then a local search by swaps.

Texts become pieces of at most ``capacity`` ids where they lie. Only the pieces' numbers and lengths are packed, in groups
that hash as many of them together as one task searches. A group's pieces are first placed by decreasing best fit. Then documents are moved, or
exchanged one for one or two for one, from each underfull bin to fuller ones wherever that makes the sum of squared fills larger, which
gathers the free room in few bins until they are empty. Bins that are still underfull meet those of other groups in the next round,
of which there are few, since most bins close in the first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm import word_pieces
from emberlens.llm.common import materialise, whole_text

#: Tokens of a sequence, and pieces that one task packs at a time.
CAPACITY, GROUP = 4_096, 8_192
#: A bin is closed when its free room is less than this share of it.
CLOSED = 1 / 512
#: Rounds go on while they empty this share of their bins.
WORTH = 1 / 1_000
#: Times that a search goes over all of a group's underfull bins.
PASSES = 4


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids], no)`` of each piece: the ids of its document before it, its own number of ids, and
    their unsigned crc32 as little-endian unsigned 32-bit integers; ``no`` tells it from all others. Written once.

    Each text is encoded whole and gets ``end_id``, a null or empty one has that alone; only what is longer than ``capacity`` is cut. Repeated rows and null ids are
    documents of their own.
    """
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches):
        coder, end = word_pieces.worker(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for row, ids in enumerate(coder.encode(batch.column(1))):
                ids = np.append(ids, end)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    for column, value in zip(rows, (row, k, at, len(own), zlib.crc32(own), own.astype("<i4"))):
                        column.append(value)
            kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(r, k) for r, k in zip(rows[1:], kinds[1:]))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = docs.select(F.col(id_col), whole_text(text_col).alias("text_")).mapInArrow(cut, schema)
    return materialise(found.withColumn("no", F.monotonically_increasing_id()), "packing-pieces")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length by decreasing best fit. Bins are kept by their free room, and the least one that suffices is the
    lowest bit of a number that has a bit for each room there is."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, rooms, bins = np.zeros(len(lengths), np.int64), 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        if not by_room[room - size]:
            rooms |= 1 << (room - size)
        by_room[room - size].append(b)
    return out


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int, passes: int = PASSES) -> np.ndarray:
    """``bins`` after moves and exchanges that each make the sum of squared fills larger, from the emptiest bin on, until none is left, no bin
    can be spared, or all bins were gone over ``passes`` times. One bin's gives are its documents and pairs of them, its takes nothing or one document of another's."""
    bins = np.unique(bins, return_inverse=True)[1].reshape(-1)
    fill = np.bincount(bins, lengths).astype(np.int64)
    spare = lambda: np.count_nonzero(fill) > -(-int(fill.sum()) // capacity)
    none = np.zeros(len(fill), np.int64)
    for _ in range(passes):
        moved = False
        for giver in np.argsort(fill, kind="stable").tolist():
            while spare() and 0 < fill[giver] < capacity:
                own = np.flatnonzero(bins == giver)
                size, which = np.unique(lengths[own], return_index=True)
                i, j = np.triu_indices(len(size), 1)
                twice = np.flatnonzero(np.bincount(np.searchsorted(size, lengths[own])) > 1)
                i, j = np.append(i, twice), np.append(j, twice)
                gives = np.concatenate([size, size[i] + size[j]])
                by_size = np.argsort(gives, kind="stable")
                sums = gives[by_size]
                # what a taker can give back: nothing, or one of its documents
                taker, back = np.concatenate([np.arange(len(fill)), bins]), np.concatenate([none, lengths])
                best = np.searchsorted(sums, capacity - fill[taker] + back, "right") - 1
                more = np.where(best >= 0, sums[best], 0) - back
                gain = more * (fill[taker] - fill[giver] + more)
                gain[(more <= 0) | (taker == giver) | (fill[taker] == 0)] = 0
                at = int(np.argmax(gain))
                if gain[at] <= 0:
                    break
                given = int(by_size[best[at]])
                if given < len(size):
                    goes = [own[which[given]]]
                else:
                    a, b = size[i[given - len(size)]], size[j[given - len(size)]]
                    goes = [own[which[i[given - len(size)]]], own[lengths[own] == b][-1 if a == b else 0]]
                bins[goes] = taker[at]
                if at >= len(fill):
                    bins[at - len(fill)] = giver
                fill[taker[at]] += more[at]
                fill[giver] -= more[at]
                moved = True
        if not (moved and spare()):
            break
    return bins


def pack(lengths: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``(no, sequence_id, offset)`` for each of ``(no, length)``, whose numbers differ and whose lengths are 1 to ``capacity``: its sequence, named by
    the least number in it, and its place there. Sequences have no gaps. An empty table gives no rows."""

    def search(table: pa.Table) -> pa.Table:
        no, size, named = (table[c].to_numpy() for c in ("no", "length", "sequence_id"))
        bins = np.unique(named, return_inverse=True)[1].reshape(-1)
        fresh = best_fit(size, capacity)
        bins = fresh if fresh.max() < bins.max() else bins
        fill = np.bincount(bins, size)
        under = fill[bins] < capacity
        if under.any():
            bins[under] = local_search(size[under], bins[under], capacity) + bins.max() + 1
        order = np.lexsort((no, bins))
        no, size, bins = no[order], size[order], bins[order]
        begins = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        n = np.diff(np.append(begins, len(bins)))
        before = np.cumsum(size) - size
        room = capacity - np.add.reduceat(size, begins)
        return pa.table(
            {"no": no, "length": size, "sequence_id": np.repeat(no[begins], n), "offset": before - np.repeat(before[begins], n), "open": np.repeat(room > capacity * CLOSED, n)}
        )

    left, done, n, bins, turn = lengths.select("no", "length", F.col("no").alias("sequence_id")), [], lengths.count(), None, 0
    while True:
        groups = max(1, -(-n // group))
        dealt = left.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)))
        placed = materialise(dealt.groupBy("group").applyInArrow(search, "no long, length long, sequence_id long, offset long, open boolean"), "packing-round")
        after = placed.agg(*(F.count_if(F.expr(x)).alias(k) for k, x in (("bins", "offset = 0"), ("n", "open"), ("open_bins", "open and offset = 0")))).first()
        worth = bins is None or bins - after["bins"] >= bins * WORTH
        if groups == 1 or not worth or not after["n"]:
            done.append(placed)
            break
        done.append(placed.where("not open"))
        left, n, bins, turn = placed.where("open"), after["n"], after["open_bins"], turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("no", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids], sequence_id, offset)`` for each piece of ``pieces``, packed into as few sequences as the search finds.

    Null, empty and long texts, null ids and repeated rows are as there; ties go by the pieces' numbers; other columns, of any name, are left
    out; an empty table gives no rows.
    """
    cut = pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids)
    return cut.join(pack(cut.select("no", "length"), capacity), "no").drop("no")


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(sequence_id, ids, documents)`` from ``pack_documents`` with ids: each sequence's ids end to end, and which piece of which document
    lies where. A sequence is at most ``capacity`` ids, so is what a task holds of one."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(id_col).alias("id"), "piece", "length", "ids"))).alias("parts")
    whole = packed.groupBy("sequence_id").agg(parts)
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["id"].alias(id_col), p["piece"], p["offset"], p["length"])).alias("documents"))
