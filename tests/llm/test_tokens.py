"""Token files and counts against the library, text by text."""

import gc
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlens.llm import pretoken, token_counts, token_files
from emberlens.llm.elias_fano import EliasFano, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "Hello, world's end.\n\n  Two  spaces", "<|endoftext|> inside <|endoftext|>", "Éèà ñandú 12² ½ x_y __", "a" * 70_000,
    "tab\tand\x1fcontrol \x85 next line", "日本語 テスト 😀", " ", "\n", "word " * 5000, "don't I'LL we're\r\n", "Hello, world's end.\n\n  Two  spaces",
]


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (5, "same id", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start long").repartition(3)


@settings(deadline=None, max_examples=600)
@given(st.one_of(st.text(max_size=60), st.text("ab .,'\n\ts1$é\r!ñ_", max_size=40), st.lists(st.sampled_from(["word", "Foo.", "x,", "it's", "7a", "$$", "\n", " ", "é!"]), max_size=20).map(" ".join)))
def test_pretokens_equal_the_library(text):
    coder = pretoken.worker(PATH)
    assert np.frombuffer(next(coder.encode([text])), "<u4").tolist() == library_().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rest", ["tead", "ngers", "word", "é", "a,", "tead!", "x more words"])
@pytest.mark.parametrize("first", ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "'S", "7", "(", "_", "\n", "\t", "!", "«"])
def test_first_words_equal_the_library(first, rest):
    coder, text = pretoken.worker(PATH), first + rest
    want = library_().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(coder.encode([text])), "<u4").tolist() == want
    assert list(coder.count([text], {})) == [len(want)]


def test_heads_of_words_of_the_vocabulary():
    """Texts that begin with an apostrophe and what the library cuts off after it, before a word of the vocabulary."""
    words = [w.removeprefix("Ġ") for w in library_().get_vocab() if w.removeprefix("Ġ").isascii() and w.removeprefix("Ġ").isalpha()]
    texts = ["'" + suffix + w for w in sorted(words)[::5] for suffix in ("", "s", "ll")]
    coder = pretoken.worker(PATH)
    want = [e.ids for e in library_().encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want and list(coder.count(texts, {})) == list(map(len, want))


def test_the_table_is_looked_up_before_the_cache():
    coder = pretoken.PreTokens(PATH)
    assert list(coder.count(["a word, a word"], {})) == [5] and " word" in coder.lengths
    assert list(coder.count(["a word, a word"], {" word": 100})) == [203]  # a table of other lengths shows
    assert " other" not in coder.lengths and list(coder.count(["an other"], {" other": 7})) == [8] and " other" not in coder.lengths


def test_collections_go_on_after_a_task():
    assert gc.isenabled()
    with pretoken.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()


def test_text_ids_are_refused(spark):
    with pytest.raises(ValueError):
        token_files.write(spark.createDataFrame([("a", "t")], "doc_id string, text string"), "unused", PATH)


_lib = []


def library_():
    if not _lib:
        _lib.append(library())
    return _lib[0]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 3000), max_size=700), st.integers(0, 40))
def test_elias_fano_round_trip(steps, shift):
    offsets = np.cumsum(np.array(steps, np.int64) << shift) if steps else np.array([], np.int64)
    code = EliasFano(encode(offsets))
    assert code.all().tolist() == offsets.tolist()
    for i in {0, len(steps) // 2, len(steps) - 1} if steps else ():
        assert code.select(i) == offsets[i]
    if steps:
        assert len(encode(offsets)) <= 17 + len(steps) * (4 + max(0, int(offsets[-1] // len(steps)).bit_length())) / 8 + 16


def test_counts(docs):
    lib = library()
    got = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, PATH).collect()}
    want = {}
    for r in docs.collect():
        n = len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        want[(r["doc_id"], len((r["text"] or "").encode()))] = (n, n > 1024)
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_counts_do_not_depend_on_the_frequent_table(docs):
    a = sorted(map(tuple, token_counts.count_tokens(docs, PATH, frequent={}).collect()), key=str)
    assert a == sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str)


def test_token_files_round_trip(spark, docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ids"
    token_files.write(docs, path, PATH)
    lib, at = library(), 0
    rows = sorted(docs.collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], signed_hash(r["text"] or "")))
    got = {(r["start"]): r for r in token_files.read(spark, path).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert got[at]["doc_id"] == r["doc_id"] and got[at]["n_tokens"] == len(ids) and got[at]["ids"] == ids
        assert got[at]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    block = spark.read.parquet(path).orderBy("part", "block").first()
    assert token_files.lookup(block, block["n_docs"] - 1).tolist()[-1] == 0
    empty = f"file://{tmp_path}/none"
    token_files.write(docs.limit(0), empty, PATH)
    assert token_files.read(spark, empty).count() == 0


SPACED = [
    "a", "b", "'s", "'", "'ll", " ", " ", " ", "  ", "    ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", " ", "　", "é", "É", "×", "́", ".", ",", "12", "½", "ª", "Σ", "中", "文", "я", "…",
    "<|endoftext|>", "<|", "_", "word", "don't", "\x00", "\x1c", "\x1f", "😀", "‍", "가", "à",
]


def test_white_space_of_all_kinds_is_cut_as_by_the_library():
    rng, coder = random.Random(11), pretoken.worker(PATH)
    texts = ["".join(rng.choices(SPACED, k=rng.randint(0, 14))) for _ in range(20_000)]
    want = [e.ids for e in library_().encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want and list(coder.count(texts, {})) == list(map(len, want))
    part = pa.array(["left out", *texts[:99]]).slice(1)
    assert list(coder.count(part, {})) == list(map(len, want[:99]))


def test_indented_texts_and_other_scripts_reach_the_cache():
    coder = pretoken.PreTokens(PATH)
    text = "def f():\n    return  слово + 中文 + 1\n\n        # конец\n"
    assert list(coder.count([text] * 3, {})) == [len(library_().encode(text).ids)] * 3
    assert {" слово", " 中文"} <= coder.lengths.keys()
    coder.library = lambda odd: [] if not odd else 1 / 0  # nothing is asked again
    assert len(set(coder.count([text, text], {}))) == 1
