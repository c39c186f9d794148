"""Words of many texts at once, as numpy sees their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are cut at a time; a longer text is cut alone.
CHUNK_BYTES = 4_000_000


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first, data, ends)`` of some texts after each other: the number of the first of them, their bytes end to end and where each ends.
    Texts have no nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def with_any(data: np.ndarray, ends: np.ndarray, marks: list[bytes]) -> set[int]:
    """The numbers of the texts that have any of ``marks``."""
    raw, found = data.tobytes(), set()
    for mark in marks:
        at = raw.find(mark)
        while at >= 0:
            found.add(int(np.searchsorted(ends, at, "right")))
            at = raw.find(mark, at + 1)
    return found


def cut(data: np.ndarray, ends: np.ndarray, kept: np.ndarray, begins: np.ndarray | None = None) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of the texts in ``data``, and for each the number of its text. Words are runs of bytes that are ``kept``; one begins
    anew at a text's first byte and where ``begins`` says."""
    fresh = np.empty(len(kept), bool)
    fresh[:1] = True
    np.logical_not(kept[:-1], out=fresh[1:])
    if begins is not None:
        fresh |= begins
    inner = ends[:-1]
    fresh[inner[inner < len(kept)]] = True
    starts = np.flatnonzero(fresh & kept)
    last = np.empty(len(kept), bool)  # the byte after it isn't kept or begins a word
    last[-1:] = True
    np.logical_or(fresh[1:], ~kept[1:], out=last[:-1])
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(last & kept) + 1 - starts, out=offsets[1:])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[kept].tobytes()))
    return found, np.searchsorted(ends, starts, "right")
