"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its hashed
words; a document's is their noisy-or, ``1 - prod(1 - p)``, in which the bias counts
once a document: a sentence without weighted words adds nothing, and only what a sentence has
beyond ``FLOOR`` counts, in the fit's last rounds as in scores. Only documents have
labels: their gradient reaches the sentences through the noisy-or, so that those
which explain the label learn it, and the same scores locate them.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm.common import whole_text
from emberlens.llm.labelled import in_fold, sample

#: Buckets of hashed words.
BUCKETS = 1 << 22
#: Of a word's bytes: letters and digits stay, A-Z as a-z, sentence ends become line breaks, others spaces.
_SENTENCES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".!?\n" else 0x20
    for b in range(256)
)
#: Bytes of the beginnings that are features.
STEMS = (4, 8)
#: Bytes of a text whose words exist at a time.
PIECE_BYTES = 1 << 22
#: Log-odds of a document before anything is learned, and words whose sums a worker keeps.
PRIOR, WORDS_KEPT = -5.0, 400_000
#: Weight from which a sentence counts in scores: common words with small weights, however often, make no text toxic.
FLOOR = 3.0


def pieces(text: str | None) -> Iterator[list[list[bytes]]]:
    """The words of each sentence that has any, a piece of a long text at a time."""
    data, at = (text or "").encode().translate(_SENTENCES), 0
    while at < len(data):
        end = data.find(b"\n", at + PIECE_BYTES) + 1 or len(data)
        if parts := [w for line in data[at:end].split(b"\n") if (w := line.split())]:
            yield parts
        at = end


def sentences(text: str | None) -> list[list[bytes]]:
    return [s for part in pieces(text) for s in part]


def features(word: bytes) -> list[int]:
    """Buckets of a word: its own and those of its beginnings, which the words of one stem share."""
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n] + b"-") % BUCKETS for n in range(STEMS[0], min(STEMS[1], len(word) - 1) + 1))]


@dataclass
class Model:
    bias: float
    weights: dict[int, float]  # by bucket

    def scorer(self):
        known: dict[bytes, float] = {}

        def logits(parts: list[list[bytes]]) -> np.ndarray:
            if len(known) > WORDS_KEPT:
                known.clear()
            flat = [w for p in parts for w in p]
            for w in set(flat):
                if w not in known:
                    known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            x = np.fromiter(map(known.__getitem__, flat), np.float64, len(flat))
            starts = np.cumsum([0, *map(len, parts[:-1])])
            return self.bias + np.add.reduceat(x, starts)

        return logits


def _of(text: str | None, logits) -> np.ndarray:
    """The log-odds of all sentences of a whole text."""
    parts = [logits(p) for p in pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0)


def noisy_or(logits: np.ndarray, bias: float = -np.inf) -> float:
    """The document's probability. ``bias`` counts once, with or without sentences, and each sentence
    by what it has beyond ``bias + FLOOR``, so that length alone makes no text toxic."""
    beyond = np.maximum(np.logaddexp(0, logits) - np.logaddexp(0, bias + FLOOR), 0)
    return float(-np.expm1(-np.logaddexp(0, bias) - beyond.sum()))


def fit(
    texts: Iterable[str], labels: Sequence[int], rounds: int = 30, rate: float = 0.6, l2: float = 1e-4, least: int = 4, floor: float = FLOOR, prior: float = PRIOR, last: int = 10, times: float = 1.0
) -> Model:
    """Fits by full gradients with a step size for each weight. The floor would keep weights of 0 from ever growing, so it is 0 at first;
    the ``last`` rounds fit the formula that scores. Weights stay at 0 or
    above: words can only add to a sentence's toxicity, the bias alone speaks for
    the rest, so that an insult isn't outweighed by what stands around it. The numbers here had the least log loss over three folds
    of sf0.1's training rows; no held-out label was looked at for them. A toxic document
    counts ``times`` as much as another. Buckets that fewer than ``least`` distinct (document, word) pairs have are left out.
    Without labels of both kinds nothing is toxic."""
    y = np.asarray(labels, bool)
    numbers: dict[bytes, int] = {}
    in_words, sentence_sizes, doc_sizes, in_docs = array("i"), array("i"), array("i"), Counter()
    for text in texts:
        parts = sentences(text)
        doc_sizes.append(len(parts))
        sentence_sizes.extend(map(len, parts))
        own = [numbers.setdefault(w, len(numbers)) for s in parts for w in s]
        in_words.extend(own)
        in_docs.update(set(own))
    if not len(in_words) or y.all() or not y.any():
        return Model(prior, {})
    words = np.frombuffer(in_words, np.int32)
    starts = np.cumsum(sentence_sizes) - np.frombuffer(sentence_sizes, np.int32)  # no sentence is empty
    sentence = np.repeat(np.arange(len(sentence_sizes), dtype=np.int32), sentence_sizes)
    doc = np.repeat(np.arange(len(doc_sizes), dtype=np.int32), doc_sizes)
    buckets, of = array("i"), array("i")
    for i, w in enumerate(numbers):
        own = features(w)
        buckets.extend(own)
        of.extend([i] * len(own))
    of = np.frombuffer(of, np.int32)
    distinct, f = np.unique(np.frombuffer(buckets, np.int32), return_inverse=True)
    keep = np.bincount(f, np.array([in_docs[i] for i in range(len(numbers))])[of]) >= least
    of, f = of[keep[f]], (np.cumsum(keep) - 1)[f[keep[f]]]
    n = int(keep.sum())
    softplus, sigmoid = lambda x: np.logaddexp(0, x), lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    w, bias, m, v = np.zeros(n), prior, np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + last + 1):
        under = floor if t > rounds else 0.0
        x = np.add.reduceat(np.bincount(of, w[f], len(numbers))[words], starts)
        counts = x >= under
        beyond = np.where(counts, softplus(bias + x) - softplus(bias + under), 0)
        s = np.clip(np.bincount(doc, beyond, len(doc_sizes)) + softplus(bias), 1e-9, 500)
        of_doc = np.where(y, -times / np.expm1(s), 1.0)
        d = np.where(counts, of_doc[doc] * sigmoid(bias + x), 0)
        by_word = np.bincount(words, d[sentence], len(numbers))
        of_bias = d.sum() - (of_doc[doc] * counts).sum() * sigmoid(bias + under) + of_doc.sum() * sigmoid(bias)
        g = np.append(np.bincount(f, by_word[of], n), of_bias) / len(y) + l2 * np.append(w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        w, bias = np.maximum(w - step[:-1], 0), bias - 0.1 * step[-1]
    used = np.abs(w) > 1e-3
    return Model(float(bias), dict(zip(distinct[keep][used].tolist(), w[used].tolist())))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled rows outside the held-out fold; see ``labelled.sample`` for their bound."""
    rows = sample(docs, labels.where(~in_fold(labels[id_col], folds, held_out)), label_col, id_col, text_col)
    return fit((t for t, _ in rows), [y for _, y in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted, worst_sentence, offending)`` for each row.

    ``score`` is the noisy-or over all sentences of the whole text, the bias counted once, ``predicted`` 1
    from ``threshold`` on, ``worst_sentence`` the number (from 0, null if there is
    none) of the likeliest sentence, ``offending`` the numbers of those that reach
    the threshold by themselves. Sentences end at ``. ! ?`` and line breaks; those
    without words aren't numbered. Null, empty and wordless texts have the bias alone. Words of very long texts exist a piece at a
    time. Each row gives a row; null ids stay; other columns, of any name, are left out; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        logits = shared.value.scorer()
        cut = np.log(threshold / (1 - threshold))
        for batch in batches:
            scores, worst, offending = [], [], []
            for text in batch.column(1).to_pylist():
                z = _of(text, logits)
                scores.append(noisy_or(z, shared.value.bias))
                worst.append(int(z.argmax()) if len(z) else None)
                offending.append(np.flatnonzero(z >= cut).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array(worst, pa.int32()), pa.array(offending, pa.list_(pa.int32())),
                ],
                [id_col, "score", "predicted", "worst_sentence", "offending"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("text_")).mapInArrow(
        run, f"`{id_col}` {kind}, score double, predicted int, worst_sentence int, offending array<int>"
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``: each by itself, so repeated rows stay or go
    together, and null and empty texts stay. An empty table stays empty."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        logits = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([noisy_or(_of(t, logits), shared.value.bias) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
