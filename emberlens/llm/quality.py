"""Text quality by a factorisation machine.

Features are a text's hashed words, statistics of its structure in bins, and its
metadata in bins. Their pairwise interactions have low rank, ``<v_i, v_j>``, and all
of them are summed in time linear in the features by

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm.common import whole_text
from emberlens.llm.labelled import in_fold, sample

#: Buckets of hashed words, bins of each statistic, and the rank of interactions.
BUCKETS, BINS, RANK = 1 << 18, 16, 8
#: Distinct words whose buckets a worker keeps.
WORDS_KEPT = 400_000
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGITS = bytes(range(0x30, 0x3A))
_HIGH = bytes(range(0x80, 0x100))
_SIGNS = bytes(b for b in range(0x21, 0x7F) if b not in _UPPER + _LOWER + _DIGITS + b".,'\"-!?")
_WORD = bytes(b if b in _LOWER + _DIGITS + _HIGH else b + 32 if b in _UPPER else 0x20 for b in range(256))


def _share(part: float, whole: float) -> int:
    """The bin of a share: fine near 0, where most texts are."""
    return min(BINS - 1, int(BINS * math.sqrt(part / whole))) if whole else 0


def _size(n: float) -> int:
    return min(BINS - 1, int(n).bit_length())


def structure(text: str) -> list[int]:
    """The bin of each statistic of a whole text."""
    raw = text.encode()
    tokens = raw.split()
    n, t = len(raw), len(tokens)
    lines = raw.split(b"\n")
    many = lambda kept: n - len(raw.translate(None, kept))
    upper, lower = many(_UPPER), many(_LOWER)
    return [
        _size(n),
        _size(t),
        _size(n / len(lines)),
        min(BINS - 1, n // t) if t else 0,
        _share(len(set(tokens)), t),
        _share(len(set(zip(tokens, tokens[1:]))), t),
        _share(sum(map(bytes.__eq__, tokens, tokens[1:])), t),
        _share(upper, upper + lower),
        _share(many(_DIGITS), n),
        _share(many(_SIGNS), n),
        _share(many(_HIGH), n),
        _share(raw.count(b".") + raw.count(b"!") + raw.count(b"?"), t or 1),
        _share(raw.count(b"!"), t or 1),
        _share(raw.count(b","), t or 1),
        _share(sum(len(x) < 4 for x in tokens), t),
        _share(len(set(lines)), len(lines)),
        _share(len(raw.translate(_WORD).split()), t or 1),
    ]


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # one for each feature
    factors: np.ndarray  # RANK for each feature

    def score(self, features: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities of documents whose features lie end to end, ``sizes`` of each."""
        starts = np.cumsum(sizes) - sizes
        v = self.factors[features] * values[:, None]
        z = np.add.reduceat(self.weights[features] * values, starts)
        z += 0.5 * (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64) + self.bias, -40, 40)))


class Features:
    """Texts as features; no two fields share a feature."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str, metadata: Sequence[float | None] = ()) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        words = set(text.encode().translate(_WORD).split())
        for w in words:
            if w not in self.known:
                self.known[w] = zlib.crc32(w) % BUCKETS
        hashed = np.unique(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        bins = [*structure(text), *(0 if x is None else 1 + min(BINS - 2, int(max(x, 0)).bit_length()) for x in metadata)]
        stats = BUCKETS + np.arange(len(bins)) * BINS + np.array(bins)
        return np.concatenate([hashed, stats]), np.concatenate([np.full(len(hashed), 1 / math.sqrt(max(1, len(hashed)))), np.ones(len(stats))])


def n_features(n_metadata: int = 0) -> int:
    return BUCKETS + (len(structure("")) + n_metadata) * BINS


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int, rounds: int = 60, rate: float = 0.05, l2: float = 1e-3, least: int = 8, seed: int = 7) -> Model:
    """Fits by full gradients with a step size for each weight. Features that fewer
    than ``least`` documents have stay 0. Without labels of both kinds the score is
    the labels' own share."""
    y = np.asarray(labels, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(math.log(share / (1 - share)), np.zeros(n, np.float32), np.zeros((n, RANK), np.float32))
    if not len(y) or y.min() == y.max():
        return model
    x = np.concatenate([f for f, _ in rows])
    keep = np.bincount(x, minlength=n) >= least
    used = np.flatnonzero(keep)
    at = keep[x]
    value = np.concatenate([v for _, v in rows])[at]
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])[at]
    x = (np.cumsum(keep) - 1)[x[at]]
    k, docs = len(used), len(y)
    order = np.argsort(x, kind="stable")  # sums by feature are sums of runs in this order, sums by document in the given one
    by_feature = np.searchsorted(x[order], np.arange(k))
    sizes = np.bincount(doc, minlength=docs)
    has, begins = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]

    def by_doc(values: np.ndarray) -> np.ndarray:
        out = np.zeros(docs)
        out[has] = np.add.reduceat(values, begins) if len(begins) else 0
        return out

    w = np.zeros((RANK + 1, k))
    w[1:] = np.random.default_rng(seed).normal(0, 0.05, (RANK, k))
    bias, m, s = model.bias, np.zeros((RANK + 1, k)), np.zeros((RANK + 1, k))
    for t in range(1, rounds + 1 if k else 0):
        vx = [w[f][x] * value for f in range(RANK + 1)]
        sums = [by_doc(v) for v in vx]
        z = bias + sums[0] + 0.5 * sum(sums[f] ** 2 - by_doc(vx[f] * vx[f]) for f in range(1, RANK + 1))
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / docs
        dx = d[doc] * value
        g = np.empty_like(w)
        g[0] = np.add.reduceat(dx[order], by_feature)
        for f in range(1, RANK + 1):
            g[f] = np.add.reduceat((dx * (sums[f][doc] - vx[f]))[order], by_feature)
        g += l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
        bias -= rate * float(np.sign(d.sum())) * min(1.0, abs(d.sum()) * 10)
    model.bias = float(bias)
    model.weights[used] = w[0]
    model.factors[used] = w[1:].T
    return model


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    metadata_cols: Sequence[str] = (),
) -> Model:
    """A model of the labelled rows outside the held-out fold; see ``labelled.sample`` for their bound."""
    rows = sample(docs, labels.where(~in_fold(labels[id_col], folds, held_out)), label_col, id_col, text_col, metadata_cols=metadata_cols)
    features = Features()
    return fit([features(r[0], r[2:]) for r in rows], np.array([r[1] for r in rows]), n_features(len(metadata_cols)))


def score(
    docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", metadata_cols: Sequence[str] = ()
) -> DataFrame:
    """``(id, score, predicted)`` for each row, from the whole text and the numeric
    ``metadata_cols``, which must be those of the training.

    A null text counts as empty, and an empty text has a score like any other; null
    metadata has a bin of its own. A very long text is one row's work: its words and pairs of words exist at
    once. Each row gives a row; null ids stay; other columns, of any name, are left out; an empty
    table gives no rows. The broadcast model has ``n_features`` times ``RANK + 1``
    numbers, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        features = Features()
        for batch in batches:
            rows = [features(t, m) for t, *m in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            for at in range(0, len(rows), 1000):
                some = rows[at : at + 1000]
                sizes = np.array([len(f) for f, _ in some])
                p = shared.value.score(np.concatenate([f for f, _ in some]), np.concatenate([v for _, v in some]).astype(np.float32), sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [id_col, "score", "predicted"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    extra = [F.col(c).cast("double").alias(f"meta_{i}") for i, c in enumerate(metadata_cols)]
    return docs.select(F.col(id_col), whole_text(text_col).alias("text_"), *extra).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
