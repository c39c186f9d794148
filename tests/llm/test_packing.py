"""Packing: ids against the library, sequences without gaps, and how many there are."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberlens.llm import packing, queries
from emberlens.llm.word_pieces import WordPieces

PATH = public_tokenizers.path(queries.WORD_TOKENIZER)
BITS = [
    "a", "b", "'s", "'", "'t", "'ll", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x85", "\xa0", "é", "É", "×", "÷", "ß", "́", "̸", "<", "=", ".", ",", "1", "23", "½", "²", "µ", "ª", "İ",
    "Σ", "中", "文", "я", " ", "…", "“", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "_", "-", "word", "The", "don't", "\x00", "\x1c", "😀", "‍", "ﬁ", "Å", "가", "ㄱ",
]
ODD = [None, "", " \n\t", "word", "x" * 30_000, "é" * 3, "a b. " * 9_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_pieces_of_texts_as_the_library_has_them(library):
    coder, rng = WordPieces(PATH), random.Random(1)
    assert coder.cuts
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(20_000)]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(pa.array(texts))] == want
    part = pa.array(["skipped", *texts[:50]]).slice(1)
    assert [x.tolist() for x in coder.encode(part)] == want[:50]


def test_other_tokenizers_see_whole_texts():
    path = public_tokenizers.path(queries.TOKENIZER)
    coder, texts = WordPieces(path), ["It's  a text\n", ""]
    assert not coder.cuts and [x.tolist() for x in coder.encode(pa.array(texts))] == [Tokenizer.from_file(path).encode(t).ids for t in texts]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, piece string, no long").repartition(3)


def whole(rows, capacity=4096):
    """No gaps, no overlaps, nothing beyond the capacity."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(own[-1]) <= capacity
    return len(sequences)


def test_rows(spark, library):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i % 90, "Some words, and more. " * rng.choice([1, 9, 200, 500])) for i in range(120)] + [(None, "no id"), (None, "no id")]
    got = packing.pack_documents(docs_of(spark, rows), PATH).collect()
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        cuts = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        want += [(str(i), k, k * 4096, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cuts)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert whole(got) <= packing.best_fit(np.array([w[3] for w in want]), 4096).max() + 1
    assert packing.pack_documents(docs_of(spark, rows).limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark, library):
    rows = [(i, f"text number {i} " * (i % 30)) for i in range(200)]
    packed = packing.sequences(packing.pack_documents(docs_of(spark, rows), PATH, capacity=64, with_ids=True)).collect()
    parts = defaultdict(dict)
    for s in packed:
        assert len(s["ids"]) <= 64 and sum(d["length"] for d in s["documents"]) == len(s["ids"])
        for d in s["documents"]:
            parts[d["doc_id"]][d["piece"]] = s["ids"][d["offset"] : d["offset"] + d["length"]]
    for i, t in rows:
        assert sum((parts[i][k] for k in sorted(parts[i])), []) == [*library.encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("kind", ["uniform", "thirds", "halves", "alike", "small"])
def test_local_search_gains(kind):
    rng = np.random.default_rng(5)
    sizes = {"uniform": rng.integers(1, 4097, 1500), "thirds": rng.integers(900, 1700, 1500), "halves": rng.integers(1300, 2300, 1500), "alike": np.full(300, 2100), "small": rng.integers(1, 60, 1500)}[kind]
    before = packing.best_fit(sizes, 4096)
    after = packing.local_search(sizes, before, 4096)
    a, b = np.bincount(before, sizes), np.bincount(after, sizes)
    assert a.max() <= 4096 and b.max() <= 4096 and b.sum() == sizes.sum()
    assert (b**2).sum() >= (a**2).sum() and np.count_nonzero(b) <= np.count_nonzero(a)
    if kind == "thirds":
        assert np.count_nonzero(b) < np.count_nonzero(a)
    alone = packing.local_search(sizes[:200], np.arange(200), 4096, 20)
    assert np.count_nonzero(np.bincount(alone, sizes[:200])) <= packing.best_fit(sizes[:200], 4096).max() + 1 + 2


@pytest.mark.parametrize(("low", "high"), [(1, 4096), (1000, 1700), (2100, 2101), (1, 40)])
def test_groups_meet_in_rounds(spark, low, high):
    rng = random.Random(7)
    rows = [(1_000 * i, rng.randrange(low, high)) for i in range(3_000)]
    packed = packing.pack(spark.createDataFrame(rows, "no long, length long").repartition(4), group=300).collect()
    size = dict(rows)
    assert sorted(r["no"] for r in packed) == sorted(size)
    n = whole([r.asDict() | {"length": size[r["no"]]} for r in packed])
    alone = packing.best_fit(np.array([s for _, s in rows]), 4096).max() + 1
    assert n <= alone * 1.02 + 1
