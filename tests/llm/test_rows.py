"""The rows of op1 and op5 against plain versions of their scores."""

import math
import random
import zlib

import numpy as np
import pytest

from emberlens.llm import quality, queries, toxicity
from emberlens.llm.common import table
from tests.llm.test_filters import clean_and_toxic, good_and_bad


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('rows')}"
    clean, toxic = clean_and_toxic(60)
    good, bad = good_and_bad(60)
    long = " ".join(random.Random(1).choices(good, k=800))
    texts = clean + toxic + good + bad + [None, "", " \n", "one", long, long + " badword"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(5, clean[5], "de", None, None), (None, good[0], None, "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 180), int(60 <= i < 120)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def held_out(i, folds, fold):
    return i is not None and zlib.crc32(str(i).encode()) % folds == fold


def test_quality_rows(spark, folder):
    docs = table(spark, folder, "documents")
    model, features = quality.train(docs, table(spark, folder, "labels"), metadata_cols=("n_chars",)), quality.Features()
    want = []
    for r in docs.collect():
        f, v = features(r["text"] or "", (r["n_chars"],))
        z = model.bias + sum(float(model.weights[i]) * x for i, x in zip(f, v))
        vx = model.factors[f].astype(float) * np.array(v)[:, None]
        z += sum(float(vx[i] @ vx[j]) for i in range(len(f)) for j in range(i)) if len(f) < 300 else 0.5 * float((vx.sum(0) ** 2 - (vx * vx).sum(0)).sum())
        want.append((str(r["doc_id"]), held_out(r["doc_id"], 4, 2), round(1 / (1 + math.exp(-max(-40, min(40, z)))), 4)))
    got = queries.op1_quality(spark, folder).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    pairs = list(zip(sorted((str(r["doc_id"]), r["held_out"], r["score"]) for r in got), sorted(want)))
    assert len(got) == len(want) and all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-3) for a, b in pairs)


def test_toxicity_rows(spark, folder):
    docs = table(spark, folder, "documents")
    model, want = toxicity.train(docs, table(spark, folder, "labels")), []
    for r in docs.collect():
        low = "".join(c.lower() if c.isascii() else c for c in r["text"] or "")
        cut = "".join("\n" if c in ".!?\n" else c if not c.isascii() or c.isalnum() else " " for c in low)
        clean = 1 / (1 + math.exp(model.bias))
        for sentence in cut.split("\n"):
            words = sentence.split(" ")
            weight = sum(model.weights.get(b, 0.0) for w in words if w for b in toxicity.features(w.encode()))
            if weight > toxicity.FLOOR:  # what a sentence has beyond the floor
                clean *= (1 + math.exp(model.bias + toxicity.FLOOR)) / (1 + math.exp(model.bias + weight))
        want.append((str(r["doc_id"]), held_out(r["doc_id"], 5, 0), 1 - clean))
    got = queries.op5_toxicity(spark, folder).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got) and {r["predicted"] for r in got} == {0, 1}
    pairs = list(zip(sorted((str(r["doc_id"]), r["held_out"], r["score"]) for r in got), sorted(want)))
    assert len(got) == len(want) and all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9) for a, b in pairs)
