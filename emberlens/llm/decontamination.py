"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item's windows are its runs of ``WINDOW`` consecutive words, or all its
words if it has fewer. A window is the sequence of its word shingles. Shingles are
ordered by how rare they are in all documents; since a window must be contained
whole, its rarest shingle is the prefix that suffices: a document that lacks it
lacks the window. Where a document has a window's prefix shingle, the shingle's
place in the window bounds where the window must begin and end, and the words there
are compared one by one.

Up to ``SLICE_ROWS`` windows are broadcast, so that texts stay in place. Of more windows
nothing is broadcast but a filter of fixed size over their shingles' hashes: tasks emit the
places that pass it, and these are joined with the windows by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlens.llm.common import materialise, small, whole_text

#: Words of a window, and of a shingle within it.
WINDOW, SHINGLE = 13, 4
#: (window, item) pairs that are broadcast at most; more are joined by a shuffle.
SLICE_ROWS = 200_000
#: Bits of the filter that is broadcast then (16 MB), a power of two, and the seed of ``xxhash64``.
FILTER_BITS, SEED = 1 << 27, 42
#: Candidates that a task holds before it passes them on.
HELD = 1 << 16
#: Bytes of a text whose words exist at a time.
PIECE_BYTES = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of words (digits, lower-case letters, all of non-ASCII characters), A-Z as a-z, all others as a space.
_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct ``(words, item)``, an item's id as a string, null as empty."""
    text = F.translate(whole_text(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (
        items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), found.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("words"))
        .distinct()
    )


class Windows:
    """The windows as numbers, where they are few enough to be broadcast."""

    def __init__(self, rows: list[tuple[list[str], str]], shingle: int = SHINGLE):
        self.vocabulary: dict[bytes, int] = {}
        self.item_of: dict[int, list[str]] = {}
        numbers: dict[tuple[int, ...], int] = {}
        for ws, item in rows:
            key = tuple(self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in ws)
            self.item_of.setdefault(numbers.setdefault(key, len(numbers)), []).append(item)
        self.length = np.array([len(k) for k in numbers], np.int64)
        self.ids = np.zeros((len(numbers), max(map(len, numbers), default=1)), np.int32)
        for k, i in numbers.items():
            self.ids[i, : len(k)] = k
        #: By shingle length: the distinct shingles' codes in order, and for each the windows and places that have it.
        self.shingles = {}
        for k in sorted(set(np.minimum(self.length, shingle).tolist())):
            own = np.flatnonzero(np.minimum(self.length, shingle) == k)
            code, win, place = [], [], []
            for at in range(int(self.length[own].max()) - k + 1):
                fits = own[self.length[own] >= at + k]
                code.append(codes(self.ids[fits, at : at + k]))
                win.append(fits)
                place.append(np.full(len(fits), at))
            code, win, place = map(np.concatenate, (code, win, place))
            distinct, which = np.unique(code, return_inverse=True)
            self.shingles[k] = (distinct, which, win, place)

    def number(self, text: str | None) -> np.ndarray:
        """The numbers of a whole text's words, 0 for those of no window. Words are made
        a piece at a time, so that a very long text takes four bytes a word."""
        data, at, parts = (text or "").encode().translate(_WORDS), 0, []
        while at < len(data):
            end = data.find(b" ", at + PIECE_BYTES)
            end = len(data) if end < 0 else end
            ws = data[at:end].split()
            parts.append(np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int32, len(ws)))
            at = end
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int32)

    def found(self, seq: np.ndarray, k: int, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``seq`` has a shingle of ``distinct``, and which."""
        known = seq > 0
        if len(seq) < k or not len(distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = known[: len(seq) - k + 1].copy()
        for j in range(1, k):
            whole &= known[j : len(seq) - k + 1 + j]
        at = np.flatnonzero(whole)
        code = codes(seq[at[:, None] + np.arange(k)])
        which = np.minimum(np.searchsorted(distinct, code), len(distinct) - 1)
        same = distinct[which] == code
        return at[same], which[same]

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle length: the prefix shingles' codes, and where each one's run of
        windows begins among windows and places. ``counts`` orders by rarity."""
        out = {}
        for k, (distinct, which, win, place) in self.shingles.items():
            n = np.array([counts.get((k, i), 0) for i in range(len(distinct))], np.int64)
            rank = np.empty(len(distinct), np.int64)
            rank[np.lexsort((distinct, n))] = np.arange(len(distinct))
            order = np.lexsort((place, rank[which], win))
            first = np.concatenate([[True], np.diff(win[order]) > 0])
            pick = order[first]
            pick = pick[np.argsort(which[pick], kind="stable")]
            used, begin = np.unique(which[pick], return_index=True)
            out[k] = (distinct[used], np.append(begin, len(pick)), win[pick], place[pick])
        return out


def codes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit code for each row; equal rows have equal codes, others are told
    apart by the comparison of words that follows."""
    out = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        out = (out ^ ids[:, j].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _joined(texts: list[str | None], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """All documents' word numbers with a 0 after each document, and the starts."""
    numbers, end = [windows.number(t) for t in texts], np.zeros(1, np.int32)
    starts = np.concatenate([[0], np.cumsum([len(n) + 1 for n in numbers], dtype=np.int64)])
    return np.concatenate([x for n in numbers for x in (n, end)]) if numbers else end[:0], starts


def shingle_counts(docs: DataFrame, windows, text_col: str = "text") -> dict[tuple[int, int], int]:
    """Occurrences of the windows' shingles in all whole texts. Each task sums its
    own; rows to the driver are as many as the windows have shingles."""

    def count(batches):
        w = windows.value
        sums = {k: np.zeros(len(d), np.int64) for k, (d, *_) in w.shingles.items()}
        for batch in batches:
            seq, _ = _joined(batch.column(0).to_pylist(), w)
            for k, (distinct, *_) in w.shingles.items():
                sums[k] += np.bincount(w.found(seq, k, distinct)[1], minlength=len(distinct))
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], ["k", "i", "n"])

    rows = docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n"))
    return {(r["k"], r["i"]): r["n"] for r in rows.collect()}


def _occurrences(seq: np.ndarray, starts: np.ndarray, w: Windows, prefixes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Begins and windows of all occurrences in the joined documents."""
    begins, wins = [], []
    for k, (distinct, run, win, place) in prefixes.items():
        at, which = w.found(seq, k, distinct)
        n = run[which + 1] - run[which]
        entry = np.repeat(run[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        begin, one = np.repeat(at, n) - place[entry], win[entry]
        # positional and length bounds: the window lies within the document that has the shingle
        doc = np.searchsorted(starts, np.repeat(at, n), "right") - 1
        fits = (begin >= starts[doc]) & (begin + w.length[one] < starts[doc + 1])
        begin, one = begin[fits], one[fits]
        for j in range(w.ids.shape[1]):
            on = w.length[one] > j
            same = ~on
            same[on] = seq[begin[on] + j] == w.ids[one[on], j]
            begin, one = begin[same], one[same]
        begins.append(begin)
        wins.append(one)
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(begins), np.concatenate(wins)


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row.

    Null and empty texts have no words and are never contaminated. Null item ids
    count as one item of the empty id. Rows of one id are judged each for itself.
    Other columns, of any name, are left out; tables may be empty, and texts of any
    length are read whole. Up to ``slice_rows`` windows are broadcast to the rows; more
    are joined with candidates, and what is found with the rows' ids, lengths and digests.
    """
    rows = docs.select(F.col(id_col).alias("id_"), whole_text(text_col).alias("text_"))
    pairs = item_windows(items, item_id_col, item_text_col, window)
    if pairs.count() <= slice_rows:
        kind = docs.schema[id_col].dataType.simpleString()
        schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
        return _broadcast(rows, pairs, _report(id_col), schema)
    none = F.sha2(F.lit(""), 256)
    of_row = rows.select(F.col("id_").alias(id_col), _digest().alias("digest_"), F.regexp_count("text_", F.lit(_WORD)).cast("long").alias("n_words"))
    found = contained(rows, pairs, window).select("digest_", "n_hit", "n_items", "items_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = of_row.join(found, "digest_", "left").select(id_col, "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"))
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``overlaps`` doesn't call contaminated."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), whole_text(text_col).alias("text_"))
    pairs = item_windows(items, item_id_col, item_text_col, window)
    if pairs.count() <= slice_rows:
        return _broadcast(rows, pairs, _filter, T.StructType([T.StructField("row_", docs.schema)])).select("row_.*")
    bad = materialise(contained(rows, pairs, window).where("20 * n_hit >= n_words").select("digest_"), "contaminated")
    return rows.select("row_", _digest().alias("digest_")).join(small(bad), "digest_", "left_anti").select("row_.*")


def _broadcast(rows: DataFrame, pairs: DataFrame, finish, schema) -> DataFrame:
    """``rows`` has something to keep and ``text_``; ``finish`` makes of a batch's hits what comes out."""
    sc = rows.sparkSession.sparkContext
    windows = sc.broadcast(Windows([(r["words"], r["item"]) for r in pairs.collect()]))
    prefixes = sc.broadcast(windows.value.prefixes(shingle_counts(rows, windows, "text_")))
    return rows.mapInArrow(_marker(windows, prefixes, finish), schema)


#: A word where letters are of either case.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _digest() -> Column:
    """What stands for a whole text in joins; equal texts have equal hits."""
    return F.md5("text_")


def contained(rows: DataFrame, pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(digest_, n_words, n_hit, n_items, items_sha256)`` of each distinct ``text_`` that has a window.

    Three passes over the texts at most, however many windows there are; texts aren't shuffled, but the places of
    their prefix shingles, each with the words around it.
    """
    own = materialise(pairs.withColumn("win", F.md5(F.concat_ws(" ", "words"))), "windows")
    # an item's windows differ, but items share windows: a row a window from here on
    wins = own.groupBy("win").agg(F.first("words").alias("words"))
    k = F.least(F.size("words"), F.lit(SHINGLE))
    places = F.sequence(F.lit(0), F.size("words") - k)
    hashed = F.transform(places, lambda i: F.struct(F.xxhash64(F.concat_ws(" ", F.slice("words", i + 1, k))).alias("hash"), i.alias("place")))
    shingles = wins.select("win", k.alias("k"), F.inline(hashed))
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())  # SHINGLE at most
    counts = rows.select("text_").mapInArrow(_counter(_bits(shingles), sizes), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    # a window with a shingle that no document has occurs nowhere; a filter that is too full only makes counts exact for more
    ranked = shingles.join(counts, "hash", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("prefix"))
    needed = ranked.where("prefix.n > 0").select("win", "prefix.hash", "prefix.place").join(wins, "win")
    prefixes = materialise(needed.withColumn("k", k), "window-prefixes")
    sizes = sorted(r[0] for r in prefixes.select("k").distinct().collect())
    near = rows.select("text_", _digest()).mapInArrow(_candidates(_bits(prefixes), sizes, window), "digest_ string, n_words long, at long, hash long, lead int, around array<string>")
    # positional and length bounds, then the words themselves
    first, n = F.col("lead") - F.col("place"), F.size("words")
    fits = near.join(prefixes, "hash").where((first >= 0) & (first + n <= F.size("around")))
    hits = fits.where(F.slice("around", first + 1, n) == F.col("words")).select("digest_", "n_words", "win", (F.col("at") - F.col("place")).alias("begin"), n.alias("n"))
    hits = materialise(hits.distinct(), "window-hits")
    spans = hits.groupBy("digest_", "n_words", "begin").agg((F.col("begin") + F.max("n")).alias("end"))
    before = F.max("end").over(W.partitionBy("digest_").orderBy("begin").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest("begin", F.coalesce("before", F.lit(0))), F.lit(0))
    covered = spans.withColumn("before", before).groupBy("digest_", "n_words").agg(F.sum(fresh).alias("n_hit"))
    names = hits.select("digest_", "win").distinct().join(own.select("win", "item"), "win").select("digest_", "item").distinct()
    listed = names.groupBy("digest_").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return covered.join(listed, "digest_")


def _bits(hashes: DataFrame):
    """A filter of ``hash``, broadcast: ``FILTER_BITS`` bits however many hashes there are."""
    at = hashes.select((F.pmod("hash", F.lit(FILTER_BITS)) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out, size = np.zeros(FILTER_BITS // 8, np.uint8), 4096  # bytes of one of Spark's bitmaps
    for r in parts.collect():
        out[(r["part"] - 1) * size :][:size] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes & (FILTER_BITS - 1)
    return np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def _runs(text: str, reach: int) -> Iterator[tuple[int, list[bytes], int, int]]:
    """``(base, words, low, high)``: a whole text's words a piece at a time, of which those from ``low`` to ``high``
    weren't in a piece before; ``reach`` words on both sides are there, too. ``base`` is the number of the first."""
    data, at, ws, base, low = text.encode().translate(_WORDS), 0, [], 0, 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        ws, at = ws + data[at:end].split(), end
        high = len(ws) if at == len(data) else max(low, len(ws) - reach)
        yield base, ws, low, high
        cut = max(0, high - reach)
        ws, base, low = ws[cut:], base + cut, high - cut


def _hashes(ws: list[bytes], low: int, high: int, k: int) -> np.ndarray:
    """Hashes of the shingles of ``k`` words that begin from ``low`` to ``high``, as ``xxhash64`` has them."""
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    begins, last = np.append(0, ends[:-1] + 1), max(low, min(high, len(ws) - k + 1))
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    spans = zip(begins[low:last].tolist(), ends[low + k - 1 : last + k - 1].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, last - low).view(np.int64)


def _counter(bits, sizes: list[int]):
    def count(batches):
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for text in batch.column(0).to_pylist():
                for _, ws, low, high in _runs(text, SHINGLE):
                    for k in sizes:
                        h = _hashes(ws, low, high, k)
                        found.append(h[_passing(h, bits.value)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["hash", "n"])

    return count


def _candidates(bits, sizes: list[int], window: int):
    names = ["digest_", "n_words", "at", "hash", "lead", "around"]

    def candidates(batches):
        out: list[tuple] = []
        for batch in batches:
            for text, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n_words = None
                for base, ws, low, high in _runs(text, window + SHINGLE):
                    for k in sizes:
                        h = _hashes(ws, low, high, k)
                        for i in _passing(h, bits.value).tolist():
                            n_words = _n_words(text) if n_words is None else n_words
                            at, start = low + i, max(0, low + i - window)
                            out.append((digest, n_words, base + at, int(h[i]), at - start, [w.decode() for w in ws[start : at + window]]))
                            if len(out) >= HELD:
                                yield _rows(out, names)
                                out = []
        yield _rows(out, names)

    return candidates


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _n_words(text: str) -> int:
    there = np.frombuffer(text.encode().translate(_WORDS), np.uint8) != 0x20
    return int(there[:1].sum() + (there[1:] & ~there[:-1]).sum())


def _contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _filter(batch: pa.RecordBatch, covers: list[np.ndarray], names: list[list[str]]) -> pa.RecordBatch:
    keep = pa.array([not _contaminated(int(c.sum()), len(c)) for c in covers], pa.bool_())
    return pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], ["row_"])


def _report(id_col: str):
    def report(batch: pa.RecordBatch, covers: list[np.ndarray], names: list[list[str]]) -> pa.RecordBatch:
        n_words, n_hit = [len(c) for c in covers], [int(c.sum()) for c in covers]
        columns = [
            batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
            pa.array(list(map(_contaminated, n_hit, n_words)), pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return report


def _marker(windows, prefixes, finish):
    """Finds a batch's hits and items, and hands them to ``finish``."""

    def mark(batches):
        w = windows.value
        for batch in batches:
            seq, starts = _joined(batch.column(1).to_pylist(), w)
            begin, one = _occurrences(seq, starts, w, prefixes.value)
            edge = np.bincount(begin, minlength=len(seq) + 1) - np.bincount(begin + w.length[one], minlength=len(seq) + 1)
            hit = np.cumsum(edge) > 0
            found: dict[int, set[str]] = {}
            doc = np.searchsorted(starts, begin, "right") - 1
            for d, i in set(zip(doc.tolist(), one.tolist())):
                found.setdefault(d, set()).update(w.item_of[i])
            covers = [hit[a : b - 1] for a, b in zip(starts[:-1], starts[1:])]
            names = [sorted(found.get(d, ())) for d in range(len(covers))]
            yield finish(batch, covers, names)

    return mark
