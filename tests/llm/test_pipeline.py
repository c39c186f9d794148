"""The pipeline's rows against the stages' rules applied one after the other in plain Python."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from emberlens.llm import mixing, queries, toxicity
from tests.llm.test_filters import clean_and_toxic, plain_overlap, plain_targets
from tests.llm.test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    clean, toxic = clean_and_toxic(60)
    passage = " ".join(f"item{i}" for i in range(20))
    texts = clean + toxic + [clean[0], clean[1] + " end", None, "", f"{passage} and more", clean[2] * 40 + passage]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(texts)] + [(5, clean[5], "en", "c", 1), (None, "no id here", "en", "c", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_rows(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    logits = model.scorer()
    kept = [r for r in rows if toxicity.noisy_or(logits(p) if (p := toxicity.sentences(r["text"])) else np.zeros(0), model.bias) < 0.5]
    assert 60 <= len(kept) < len(rows)
    label = brute_components([brute_print(r["text"] or "") for r in kept], 4)
    best = {}
    for r, k in zip(kept, label):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if k not in best or key < best[k][0]:
            best[k] = (key, r)
    kept = [r for _, r in best.values()]
    kept = [r for r in kept if not plain_overlap(r["text"], [(1, " ".join(f"item{i}" for i in range(20)))])[4]]
    sizes = {}
    for r in kept:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
    targets = plain_targets(sizes)
    draws = spark.createDataFrame([(r["doc_id"], r["text"]) for r in kept], "i long, t string")
    draw = {(r["i"], r["t"]): r["u"] for r in draws.select("i", "t", mixing.unit_draw(mixing.draw_key(draws["i"], draws["t"]), "mix").alias("u")).collect()}
    lib, want = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), []
    for r in kept:
        rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
        ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] * (int(rate) + (draw[r["doc_id"], r["text"]] < rate - int(rate)))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts)])[:-1].tolist()


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema
        assert stage(spark, docs.limit(0), folder).count() == 0
