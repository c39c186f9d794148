"""Token ids of whole texts by pre-token, with the library asked once for each
distinct pre-token that a worker meets.

Where a byte-level BPE's pre-tokenizer leads words with their space, a space begins a pre-token
unless white space stands on both its sides, and the BPE never merges across those. So a text's ids are those of
its pieces between such spaces, in order; a piece,
called pre-token here, is cached with its ids. Texts with a special token's string go to the library whole, as do all texts
under tokenizers of other kinds.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from emberlens.llm.byte_words import chunks, cut, with_any

#: Pre-tokens that a worker remembers before it starts anew.
CACHE_ENTRIES = 400_000
#: Signs that are cut off a word's end without a look at the pattern.
MARKS = ".,;:!?"
#: Of a byte: printable ASCII, and the last bytes that white space beyond ASCII has.
_PRINTED = np.array([0x21 <= b <= 0x7E for b in range(256)])
_MAYBE_SPACE = np.array([0x80 <= b <= 0x8A or b in (0x9F, 0xA0, 0xA8, 0xA9, 0xAF) for b in range(256)])
#: Of a character's first byte: no white space begins so.
_NO_SPACE = _PRINTED | np.array([b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3) for b in range(256)])
#: Within these characters the standard library's classes agree with the tokenizer's \p{L}, \p{N} and \s.
PLAIN = re.compile("[\t\n\r -~¡-©«¬®-±´¶-¸»¿-ɏ‐-‧‰-⁞₠-₿]*")
#: Fixed pattern: the pre-tokens of PLAIN characters.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class PreTokens:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.splits = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", False)
            and not pre.get("add_prefix_space", True)
            and spec.get("normalizer") is None
            and spec.get("model", {}).get("type") == "BPE"
        )
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.characters = byte_characters()
        self.ids: dict[str, bytes] = {}
        self.lengths: dict[str, int] = {}

    def library(self, texts: Iterable[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def values(self, distinct: list[str], cache: dict, value, combine, first: dict | None = None) -> list:
        """``value`` of each pre-token's ids: from the table ``first``, if given; from ``cache``, else; and
        by the library, else. Pre-tokens of letters and signs are put together of their parts
        by ``combine``, and only parts are kept in ``cache``; those with other characters are kept whole."""
        if first:
            get = lambda w: x if (x := first.get(w)) is not None else cache.get(w)
        else:
            get = cache.get
        out = [get(w) for w in distinct]
        todo, odd = [], []
        for i, w in enumerate(distinct):
            if out[i] is None:
                sure = w.isascii() or PLAIN.fullmatch(w)
                word = sure and (w[0] == " " or w[0].isalpha())  # a text's first piece may begin with any sign
                if word and w[1:].isalpha():
                    todo.append((i, (w,)))
                elif word and w[-1] in MARKS and w[1:-1].isalpha():
                    todo.append((i, (w[:-1], w[-1])))
                elif sure and PLAIN.fullmatch(w):
                    todo.append((i, SPLIT.findall(w)))
                else:
                    odd.append(i)
        parts = {p for _, ps in todo for p in ps}
        cache.update((w, value(x)) for w, x in self._asked([p for p in parts if get(p) is None]))
        for i, ps in todo:
            out[i] = get(ps[0]) if len(ps) == 1 else combine(map(get, ps))
        for i, ids in zip(odd, self.library([distinct[i] for i in odd])):
            out[i] = cache[distinct[i]] = value(np.array(ids, "<u4").tobytes())
        return out

    def _asked(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The library's ids of single pre-tokens: its model alone sees them, as there is
        nothing in them to normalise or to cut."""
        merge, characters = self.tokenizer.model.tokenize, self.characters
        for w in words:
            parts = merge((w if w.isascii() else w.encode().decode("latin-1")).translate(characters))
            yield w, array("I", [p.id for p in parts]).tobytes()

    def pieces(self, data: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens of the texts in ``data``, each text's own as their numbers
        end to end, and where each text's end."""
        begins = np.zeros(len(data), bool)
        begins[_cuts(data, ends)] = True
        found, text = cut(data, ends, np.ones(len(data), bool), begins)
        coded = found.dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(text, np.arange(len(ends)), "right")

    def parts(self, texts: pa.Array | list[str]) -> Iterator[tuple[dict[int, list[int]], np.ndarray, np.ndarray]]:
        """Some texts after each other: the library's ids of those that it must see whole, by number, and the bytes and ends of all, those left empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        for first, data, ends in chunks(texts):
            own = with_any(data, ends, self.special) if self.splits else set(range(len(ends)))
            if own:
                keep, begins = np.ones(len(data), bool), np.concatenate([[0], ends[:-1]])
                for d in own:
                    keep[begins[d] : ends[d]] = False
                data, ends = data[keep], np.append(0, np.cumsum(keep))[ends]
            yield {d: self.library([texts[first + d].as_py()])[0] for d in sorted(own)}, data, ends

    def shared(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bytes and ends of texts, as ``pieces`` takes them; none where the library sees texts whole."""
        if self.splits:
            for _, data, ends in chunks(texts):
                yield data, ends

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for own, data, ends in self.parts(texts):
            ids, stops = self._ids(data, ends)
            for d, (a, b) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist())):
                yield np.array(own[d], "<u4").tobytes() if d in own else ids[a:b].tobytes()

    def _ids(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, numbers, stops = self.pieces(data, ends)
        code = self.values(distinct, _room(self.ids, {"": b""}), bytes, b"".join)
        size = np.fromiter(map(len, code), np.int32, len(code)) // 4
        flat, at = np.frombuffer(b"".join(code), "<u4"), np.cumsum(size, dtype=np.int32) - size
        n = size[numbers]
        reach = np.cumsum(n, dtype=np.int64)
        place = np.repeat((at[numbers] - (reach - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], np.append(0, reach)[stops]

    def count(self, texts: pa.Array | list[str], frequent: dict[str, int]) -> Iterator[int]:
        """The number of ids of each text. The table of ``frequent`` pre-tokens is looked up first, then this worker's cache;
        what both lack is encoded once and kept there."""
        for own, data, ends in self.parts(texts):
            distinct, numbers, stops = self.pieces(data, ends)
            n = np.array(self.values(distinct, _room(self.lengths, {"": 0}), n_ids, sum, frequent), np.int64)[numbers]
            sums = np.diff(np.append(0, np.cumsum(n))[np.append(0, stops)])
            yield from (len(own[d]) if d in own else k for d, k in enumerate(sums.tolist()))


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a space begins a pre-token: what is white space beside it, and in doubt what may be, is on one side at most."""
    at = np.flatnonzero(data == 0x20)
    before, two = data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    surely = _PRINTED[before] | (before >= 0x80) & ((two >= 0xC3) & (two <= 0xDF) | ~_MAYBE_SPACE[before])
    after = np.append(data, 0x20)[at + 1]
    last = np.zeros(len(data) + 1, bool)
    last[ends] = True
    return at[surely | _NO_SPACE[after] & ~last[at + 1]]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    ones of Latin-1 for themselves, the others by turns from 256 on."""
    itself = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    rest = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(256 + i) for i, b in enumerate(rest)}


def n_ids(code: bytes) -> int:
    return len(code) // 4


def _room(cache: dict, keep: dict) -> dict:
    """``cache``, which starts anew with ``keep`` when it is full."""
    if not cache or len(cache) > CACHE_ENTRIES:
        cache.clear()
        cache.update(keep)
    return cache


_here: dict[str, PreTokens] = {}


def worker(path: str) -> PreTokens:
    """This Python worker's own coder, kept over its tasks."""
    if path not in _here:
        _here[path] = PreTokens(path)
    return _here[path]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without collections of cycles, for the length of a task: coding makes none, and they would walk the caches again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
