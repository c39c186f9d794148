"""Token ids of whole texts under a BPE that drops white space, by pieces of which each is encoded once.

Where a tokenizer lower-cases, drops white space and splits the rest into contractions, letters, single digits and runs of signs, no
token spans white space, nor a place where a letter of Latin-1 meets an ASCII sign or digit other than the apostrophe.
Texts are cut there by their bytes, and a piece's ids are remembered. Texts with a special token's string, and all
texts under tokenizers of other kinds, go to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from emberlens.llm.byte_words import chunks, cut, with_any

#: Pieces that a worker remembers before it starts anew.
CACHE_ENTRIES = 700_000
#: Fixed pattern: what such a tokenizer splits text into.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = np.isin(np.arange(256), list(b"\t\n\f\r "))
_ALPHA = np.array([bytes([b]).isalpha() for b in range(256)])
_SIGN = np.array([0x21 <= b <= 0x7E and b != 0x27 for b in range(256)]) & ~_ALPHA
#: The first byte of Latin-1's upper half in UTF-8, and the second bytes of its two signs.
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)


class WordPieces:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split, *more = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.cuts = (
            steps == ["NFC", "Replace", "Lowercase"]
            and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert")
            and [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in more] == [("ByteLevel", False, False)]
        )
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            for t in texts:
                yield np.frombuffer(self.library([t.as_py()])[0], "<u4")
            return
        for first, data, ends in chunks(texts):
            own = with_any(data, ends, self.special)
            if own:
                data, begins = data.copy(), np.concatenate([[0], ends[:-1]])
                for d in own:
                    data[begins[d] : ends[d]] = 0x20
            ids, stops = self._ids(data, ends)
            for d, (a, b) in enumerate(zip(np.concatenate([[0], stops[:-1]]).tolist(), stops.tolist())):
                yield np.frombuffer(self.library([texts[first + d].as_py()])[0], "<u4") if d in own else ids[a:b]

    def _ids(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data``, and where each text's end."""
        letter, sign = _ALPHA[data], _SIGN[data]
        two = np.flatnonzero(data[:-1] == _LATIN)
        two = two[~np.isin(data[two + 1], _SIGNS)]
        letter[two] = letter[two + 1] = True
        begins = np.zeros(len(data), bool)
        begins[1:] = letter[1:] & sign[:-1] | sign[1:] & letter[:-1]
        words, doc = cut(data, ends, ~_SPACE[data], begins)
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        coded = words.dictionary_encode()
        numbers = coded.indices.to_numpy()
        code = self._codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, code), np.int64, len(code)) // 4
        flat, at = np.frombuffer(b"".join(code), "<u4"), np.cumsum(size) - size
        n = size[numbers]
        stops = np.cumsum(n)
        place = np.repeat(at[numbers] - (stops - n), n) + np.arange(stops[-1])
        return flat[place], np.append(0, stops)[np.searchsorted(doc, np.arange(len(ends)), "right")]

    def _codes(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known = self.known
        todo = [w for w in pieces if w not in known]
        merge = self.tokenizer.model.tokenize
        odd = []
        for w in todo:
            if w.isascii() and w.isalpha():  # the model alone sees a single run of letters: nothing is left to cut or to map
                known[w] = array("I", [t.id for t in merge(w.lower())]).tobytes()
            else:
                odd.append(w)
        known.update(zip(odd, self.library(odd)))
        return [known[w] for w in pieces]


_here: dict[str, WordPieces] = {}


def worker(path: str) -> WordPieces:
    """This Python worker's own coder, kept over its tasks."""
    if path not in _here:
        _here[path] = WordPieces(path)
    return _here[path]
