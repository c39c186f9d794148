"""Readers of line files and CSV with the place of each record, and of lines alone."""

from __future__ import annotations

import csv
import gzip
import io
import itertools
import json
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlens.plans.shared import shared_dir

#: Bytes beyond which a line is no record, and of a reject's excerpt.
MOST_LINE_BYTES, EXCERPT = 64 << 20, 4096
PLACED = "origin_id string, record_number long, line_start long, byte_start long, byte_end long, raw string, ended boolean, replaced long, large boolean"
_NAMES = [c.split()[0] for c in PLACED.split(", ")]
#: File names of packed files, and of all others.
_GZ, _PLAIN = "*.gz", "{*[^z],*[^g]z,*[^.]gz,z,gz}"
_BOM = b"\xef\xbb\xbf"
#: Records that a reader of whole files hands on at a time, and characters of CSV records; bytes of a split that readers of CSV take at a time.
_AT_ONCE, _TEXT_AT_ONCE, _PIECE = 10_000, 16 << 20, 4 << 20


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without their places."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.input_file_name().alias("origin_id"))


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with record number, line and byte range in the unpacked file. Blank lines
    have no number; a byte order mark belongs to no line; bytes that are no UTF-8 are
    replaced and counted; of a line beyond ``MOST_LINE_BYTES`` only its beginning is
    kept, and ``large`` says so.

    Files are read by splits. A first pass counts lines and bytes of each split; sums of
    these counts over a file's earlier splits place the lines of the others. A packed
    file can't be split: it is one task's, unpacked as it is read.
    """
    packed = spark.read.format("binaryFile").option("pathGlobFilter", _GZ).load(path)
    if packed.select("path").isEmpty():  # names alone are looked at
        return _plain(spark, path)
    return _plain(spark, path).unionByName(_packed(spark, path))


def _filled(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\r\n\x0b\x0c")) != ""


def _plain(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.schema("value string").option("lineSep", "\n").option("pathGlobFilter", _PLAIN).text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("origin_id"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value", _filled(F.col("value")).alias("filled")
    )
    length = F.octet_length("value").cast("long") + 1
    counts = rows.groupBy("origin_id", "block").agg(F.max("size").alias("size"), F.count("*").alias("lines"), F.count_if("filled").alias("records"), F.sum(length).alias("bytes"))
    before = W.partitionBy("origin_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("origin_id")
    left = F.col("size") - F.sum("bytes").over(whole)  # 0 or 3 (a mark) if the file ends its last line, 1 less if not
    offsets = counts.select(
        "origin_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "records", "bytes")],
        F.sum("lines").over(whole).alias("all_lines"), F.when(left >= 2, 3).otherwise(0).alias("mark"), left.isin(0, 3).alias("complete"),
    )
    own = rows.select("origin_id", "block", F.col("value").cast("binary").alias("value"), "filled").mapInArrow(_numberer(MOST_LINE_BYTES), _WITHIN).where("filled")
    line, start = F.col("line") + F.col("lines_before"), F.col("at") + F.col("bytes_before") + F.col("mark")
    return own.join(offsets, ["origin_id", "block"]).select(
        "origin_id", (F.col("record") + F.col("records_before")).alias("record_number"), line.alias("line_start"), start.alias("byte_start"), (start + F.col("length")).alias("byte_end"),
        "raw", (F.col("complete") | (line < F.col("all_lines"))).alias("ended"), "replaced", "large",
    )


_WITHIN = "origin_id string, block long, line long, record long, at long, length long, raw string, filled boolean, replaced long, large boolean"


def _numberer(most: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a task with their places within their split; a task reads its splits one after the other."""
        last, lines, records, at = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            origin, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            key = np.stack([origin.indices.to_numpy(zero_copy_only=False), block], 1)
            filled, length = batch.column(3).to_numpy(zero_copy_only=False), pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)
            new = np.append((origin.dictionary[int(key[0, 0])].as_py(), int(block[0])) != last, (key[1:] != key[:-1]).any(1))
            group = np.cumsum(new)
            carried = lambda x: np.where(group == 0, x, 0)

            def within(step: np.ndarray, before: int) -> np.ndarray:
                total = np.cumsum(step) - step
                first = total[np.flatnonzero(new)]
                return total - np.append(0, first)[group] + carried(before)

            line, record, begin = within(np.ones(len(new), np.int64), lines), within(filled.astype(np.int64), records), within(length + 1, at)
            last = (origin.dictionary[int(key[-1, 0])].as_py(), int(block[-1]))
            lines, records, at = int(line[-1]) + 1, int(record[-1]) + int(filled[-1]), int(begin[-1] + length[-1]) + 1
            raw, size, replaced, large = _texts(batch.column(2), length, most)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, (line + 1, record + 1, begin, size)), raw, batch.column(3), pa.array(replaced), pa.array(large)],
                [c.split()[0] for c in _WITHIN.split(", ")],
            )

    return number


def _texts(values: pa.Array, length: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines as texts without their carriage return: the text, its bytes, how many it had replaced, and whether it is too large."""
    large = length > most
    if not large.any():
        try:
            texts = values.cast(pa.string())
            ends = pc.ends_with(texts, "\r").to_numpy(zero_copy_only=False)
            return pc.replace_substring_regex(texts, "\r\\z", ""), length - ends, np.zeros(len(length), np.int64), large
        except pa.ArrowInvalid:
            pass
    texts, size, replaced = [], [], []
    for value, big in zip(values, large):
        text, n, bad = _text(value.as_py(), bool(big))
        texts.append(text)
        size.append(n)
        replaced.append(bad)
    return pa.array(texts, pa.string()), np.array(size), np.array(replaced), large


def _text(line: bytes, large: bool) -> tuple[str, int, int]:
    body = line.removesuffix(b"\r")
    kept = body[:EXCERPT] if large else body
    text = kept.decode("utf-8", "replace")
    return text, len(body), text.count("�") - kept.count("�".encode())


def _packed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    most = MOST_LINE_BYTES

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                at, number, out = 0, 0, []
                for line_number, line in enumerate(gzip.GzipFile(fileobj=io.BytesIO(row.content)), 1):
                    mark = 3 if line_number == 1 and line.startswith(_BOM) else 0
                    begin, at = at + mark, at + len(line)
                    ended, body = line.endswith(b"\n"), line[mark:].removesuffix(b"\n")
                    if body.strip():
                        number += 1
                        large = len(body) > most
                        text, n, bad = _text(body, large)
                        out.append((row.path, number, line_number, begin, begin + n, text, ended, bad, large))
                    if len(out) >= _AT_ONCE:
                        yield pd.DataFrame(out, columns=_NAMES)
                        out = []
                yield pd.DataFrame(out, columns=_NAMES)

    return spark.read.format("binaryFile").option("pathGlobFilter", _GZ).load(path).select("path", "content").mapInPandas(read, PLACED)


_CSV = "origin_id string, record_number long, line_start long, raw string, joined string, large boolean"
_PLACE = "head:long,head_lines:long,records:long,tail:long,tail_line:long,open:boolean"
_PIECES = f"origin_id string, block long, at long, size long, lines long, data binary, names array<string>, plain struct<{_PLACE}>, quoted struct<{_PLACE}>"
_KEY = ["origin_id", "block", "at"]


def placed_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """CSV records as JSON objects in ``raw``, rows of any length: cells past the header
    are named by their number; quoted cells may hold line breaks. ``joined`` keeps the
    cells with the unit separator between them. Cells may have any length; of a record beyond
    ``MOST_LINE_BYTES`` only its beginning is kept, and ``large`` says so.

    Files are read by splits, once, and written as pieces of some MB. A piece begins within quotes or not, so it is
    looked at both ways; a file's earlier pieces then tell which one holds. Tasks read the records that lie in a piece; those that
    span pieces are put together from their parts. A packed file is one task's, at most 2 GB as it is stored, and so is a
    file without line feeds.
    """
    packed = spark.read.format("binaryFile").option("pathGlobFilter", _GZ).load(path)
    plain = _split_csv(spark, path, delimiter, header)
    return plain if packed.select("path").isEmpty() else plain.unionByName(_packed_csv(packed, delimiter, header))


def _split_csv(spark: SparkSession, path: str, delimiter: str, header: bool) -> DataFrame:
    text = spark.read.schema("value string").option("lineSep", "\n").option("pathGlobFilter", _PLAIN).text(path)
    lines = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("origin_id"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    written = shared_dir(spark, "csv-pieces")
    lines.mapInArrow(_surveyor(delimiter, header), _PIECES).write.option("compression", "none").parquet(written)  # so that tasks read as much as of the text
    pieces = spark.read.schema(_PIECES).parquet(written)
    data, places = pieces.select(*_KEY, "data"), _placed(pieces, header)
    if header:  # a first record may span pieces, too
        names = _spanning(data, places, F.col("number") == 0).select("origin_id", "parts").mapInArrow(_namer(delimiter), "origin_id string, spanning_names array<string>")
        places = places.join(names, "origin_id", "left").withColumn("names", F.coalesce("names", "spanning_names")).drop("spanning_names")
    # a row a piece
    within = data.join(F.broadcast(places.select(*_KEY, "names", "named", "head", "tail", "number", "line")), _KEY).mapInArrow(_csv_reader(delimiter), _CSV)
    return within.unionByName(_spanning(data, places, F.col("number") > 0).mapInArrow(_part_reader(delimiter), _CSV))


def _pieces(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple]:
    """A task's lines as ``(origin_id, block, size, at, data)``: ``least`` or more of a split's bytes with their line breaks, ``at`` of them after its first line's beginning."""
    key, at, held, n = None, 0, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        origin, block = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        index = origin.indices.to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero((index[1:] != index[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], len(block)]):
            own = (unquote(origin.dictionary[int(index[a])].as_py()), int(block[a]), batch.column(3)[a].as_py())
            if own != key:
                if held:
                    yield (*key, at, b"".join(held))
                key, at, held, n = own, 0, [], 0
            lines = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
            held += [pc.binary_join(lines, b"\n")[0].as_py(), b"\n"]
            n += len(held[-2]) + 1
            if n >= least:
                yield (*key, at, b"".join(held))
                at, held, n = at + n, [], 0
    if held:
        yield (*key, at, b"".join(held))


def _walk(data: bytes, quoted: bool, delimiter: str) -> tuple[int | None, int, int | None, int]:
    """Of whole lines that begin within quotes or not: the line after the record that they begin within (None: they don't end it), the filled
    records that begin and end in them, the line at which one begins that doesn't end (None: no such), and their number. Lines without
    quotes are records of their own or lie within one; only the others go through the reader."""
    flat = data.replace(b"\r\n", b"\n") if b"\r" in data else data
    if b"\r" in flat:
        flat, at, gaps, n = data, None, None, None
    else:
        codes = np.frombuffer(flat, np.uint8)
        ends = np.flatnonzero(codes == 10)
        n, sizes = len(ends), np.diff(ends, prepend=-1)
        with_quotes = np.zeros(n, bool)
        with_quotes[np.searchsorted(ends, np.flatnonzero(codes == 34))] = True
        at = np.flatnonzero(with_quotes)
        filled = np.append(0, np.cumsum((sizes > 1) & ~with_quotes))
        gaps = np.diff(filled[np.append(at, n)], prepend=0).tolist()  # filled lines without quotes before each with some, and after the last
        flat, at = codes[np.repeat(with_quotes, sizes)].tobytes(), at.tolist()
    done = False

    def after() -> Iterator[str]:
        nonlocal done
        done = True
        yield "end"

    text = ('"' if quoted else "") + flat.decode("utf-8", "replace")
    if quoted and not flat:
        return None, 0, None, n
    reader = csv.reader(itertools.chain(io.StringIO(text, newline=""), after()), delimiter=delimiter)
    head, records, begin = None if quoted else 0, 0, 0
    for cells in reader:
        if head is not None and gaps:
            records += gaps[begin]
        if done:
            break
        begin = reader.line_num
        if head is None:
            head = begin if at is None else at[begin - 1] + 1
        else:
            records += bool(cells)
    read = reader.line_num - 1
    tail = begin if head is not None and begin < read else None
    return head, records, tail if at is None or tail is None else at[tail], read if n is None else n


def _byte_of(data: bytes, line: int) -> int:
    """Where a line begins, lines from 0."""
    if not line:
        return 0
    codes = np.frombuffer(data, np.uint8)
    ends, returns = codes == 10, codes == 13
    returns[:-1] &= ~ends[1:]
    return int(np.flatnonzero(ends | returns)[line - 1]) + 1


def _surveyor(delimiter: str, header: bool):
    least = _PIECE

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, and what each holds if it begins outside of quotes, and if within."""
        csv.field_size_limit(2**31 - 1)  # the reader's own limit would end the file
        place = pa.struct([(c, pa.int64()) for c in ("head", "head_lines", "records", "tail", "tail_line")] + [("open", pa.bool_())])
        types = [pa.string()] + [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.string()), place, place]
        for origin, block, size, at, data in _pieces(batches, least):
            ways = []
            for quoted in (False, True):
                head, records, tail, n = _walk(data, quoted, delimiter)
                ways.append({
                    "head": len(data) if head is None else _byte_of(data, head), "head_lines": n if head is None else head, "records": records,
                    "tail": len(data) if tail is None else _byte_of(data, tail), "tail_line": n if tail is None else tail, "open": head is None or tail is not None,
                })
            names = None
            if header and block == 0 and at == 0 and ways[0]["tail"] != 0:
                names = next(csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8", "replace", newline=""), delimiter=delimiter))
            row = (origin, block, at, size, n, data, names, *ways)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in _PIECES.split(", ")])

    return survey


def _placed(pieces: DataFrame, header: bool) -> DataFrame:
    """Pieces, without their data, with the way they begin. One that ends alike both ways settles it for the next; of others, each either keeps or turns it."""
    whole = W.partitionBy("origin_id")
    before = whole.orderBy("block", "at").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c, w=before: F.coalesce(F.sum(c).over(w), F.lit(0))
    plain, quoted = F.col("plain.open"), F.col("quoted.open")
    settled = F.when(plain == quoted, plain)
    rows = pieces.withColumn("bytes", F.octet_length("data").cast("long")).drop("data").withColumn("settled", F.coalesce(F.last(settled, True).over(before), F.lit(False))).withColumn("part", F.count(settled).over(before))
    turns = so_far((plain & ~quoted).cast("int"), W.partitionBy("origin_id", "part").orderBy("block", "at").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.col("settled") != (turns % 2 == 1)).withColumn("own", F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("plain")))
    begun = F.col("own.records") + (F.col("own.tail") < F.col("bytes")).cast("int")
    first = (F.col("block") == 0) & (F.col("at") == 0)
    skipped = F.max(F.when(first, (F.col("names").isNull() | (F.size("names") > 0)).cast("int"))).over(whole) if header else F.lit(0)
    ended = (F.col("size") - F.sum("bytes").over(whole)).isin(0, 3)  # as of lines
    cut = (~ended & (F.struct("block", "at") == F.max(F.struct("block", "at")).over(whole))).cast("int")
    return rows.select(
        *_KEY, F.max(F.when(first, F.col("names"))).over(whole).alias("names"), (first & F.col("names").isNotNull()).alias("named"), "inside", "bytes", (F.col("bytes") - cut).alias("end"),
        *[F.col(f"own.{c}").alias(c) for c in ("head", "tail", "records")], (so_far(begun) - skipped).alias("number"),
        (so_far("lines") + F.col("own.head_lines") + 1).alias("line"), (so_far("lines") + F.col("own.tail_line") + 1).alias("tail_line"),
    )


def _spanning(data: DataFrame, places: DataFrame, which: Column) -> DataFrame:
    """``(origin_id, number, line_start, large, names, parts)`` of records that span pieces, ``which`` of their numbers. ``large``: whatever the
    cells are, it is beyond ``MOST_LINE_BYTES``, since three bytes make one at least; then only its beginning is fetched."""
    none, sized = F.lit(None).cast("long"), lambda frm, to, n, line: F.struct(frm.alias("frm"), to.alias("upto"), n.alias("number"), line.alias("line_start"))
    begins = F.when(F.col("inside"), sized(F.lit(0).cast("long"), F.least("head", "end"), F.col("number"), none))
    ends = F.when(F.col("tail") < F.col("bytes"), sized(F.col("tail"), F.col("end"), F.col("number") + F.col("records") + 1, F.col("tail_line")))
    record = W.partitionBy("origin_id", "number")
    length, enough = F.col("upto") - F.col("frm"), 8 * EXCERPT
    parts = places.select(*_KEY, "names", F.inline(F.array_compact(F.array(begins, ends)))).where(which)
    parts = parts.select("*", (F.sum(length).over(record) > 3 * MOST_LINE_BYTES + 16).alias("large"), F.coalesce(F.sum(length).over(record.orderBy("block", "at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("passed"))
    parts = parts.withColumn("upto", F.when(F.col("large"), F.least("upto", F.col("frm") + enough - F.col("passed"))).otherwise(F.col("upto"))).drop("passed").where("frm < upto")
    # two rows a piece at most
    own = data.join(F.broadcast(parts), _KEY)
    cut = F.expr("substring(data, CAST(frm + 1 AS INT), CAST(upto - frm AS INT))")
    found = own.select("origin_id", "number", "line_start", "large", "names", F.struct("block", "at", cut.alias("data")).alias("part")).groupBy("origin_id", "number").agg(
        F.max("line_start").alias("line_start"), F.max("large").alias("large"), F.max("names").alias("names"), F.array_sort(F.collect_list("part")).alias("parts")
    )
    return found.withColumn("parts", F.col("parts.data"))


def _cells(parts: list[bytes], delimiter: str) -> list[str]:
    csv.field_size_limit(2**31 - 1)
    return next(csv.reader(io.StringIO(b"".join(parts).decode("utf-8", "replace"), newline=""), delimiter=delimiter))


def _namer(delimiter: str):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_cells(p, delimiter) for p in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["origin_id", "spanning_names"])

    return name


def _csv_row(path: str, number: int, line: int, names: list[str] | None, cells: list[str], most: tuple[int, int], large: bool = False) -> tuple:
    joined = "\x1f".join(cells)
    if large := large or len(joined) > most[0] or len(joined.encode()) > most[0]:
        joined = joined[: most[1]]
        return path, number, line, joined, joined, large
    named = {(names[i] if names and i < len(names) else f"column_{i}"): c for i, c in enumerate(cells)}
    return path, number, line, json.dumps(named, ensure_ascii=False), joined, large


def _csv_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CSV.split(", ")]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    out, text = [], 0
    for row in rows:
        out.append(row)
        text += len(row[3]) + len(row[4])
        if len(out) >= _AT_ONCE or text >= _TEXT_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out, text = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _records(lines: Iterator[str], path: str, delimiter: str, most: tuple[int, int], named: bool, names: list[str] | None = None, number: int = 0, line: int = 1) -> Iterator[tuple]:
    """Records of lines, of which the first gives the names if ``named``."""
    csv.field_size_limit(2**31 - 1)
    rows, before = csv.reader(lines, delimiter=delimiter), line
    for cells in rows:
        begin, line = line, rows.line_num + before
        if named:
            names, named = cells, False
            number += 1 if number < 0 else 0
        elif cells:
            number += 1
            yield _csv_row(path, number, begin, names, cells, most)


def _csv_reader(delimiter: str):
    most = MOST_LINE_BYTES, EXCERPT

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = batch.slice(i, 1).to_pylist()[0]
                own = io.TextIOWrapper(io.BytesIO(p["data"][p["head"] : p["tail"]]), "utf-8", "replace", newline="")
                yield from _records(own, p["origin_id"], delimiter, most, p["named"], p["names"], p["number"], p["line"])

    return lambda batches: _csv_batches(records(batches))


def _part_reader(delimiter: str):
    most = MOST_LINE_BYTES, EXCERPT

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                yield _csv_row(r["origin_id"], r["number"], r["line_start"], r["names"], _cells(r["parts"], delimiter), most, r["large"])

    return lambda batches: _csv_batches(records(batches))


def _packed_csv(packed: DataFrame, delimiter: str, header: bool) -> DataFrame:
    most = MOST_LINE_BYTES, EXCERPT

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                stream = io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), "utf-8-sig", "replace", newline="")
                yield from _records(stream, path, delimiter, most, header)

    return packed.select("path", "content").mapInArrow(lambda batches: _csv_batches(records(batches)), _CSV)
