"""Quality, toxicity, mixing, line dedup and decontamination against plain versions on small tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlens.llm import decontamination, labelled, line_dedup, mixing, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, text_ string"


def docs_of(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], None if t is None else len(t), "x", "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", " \n\t", "word", "x" * 100_000, "é" * 3, "a b " * 20_000]


# quality


def test_factorisation_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.Model(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, quality.RANK)).astype(np.float32))
    rows = [(rng.choice(50, k, replace=False), rng.normal(size=k)) for k in (1, 2, 9, 20)]
    got = m.score(np.concatenate([f for f, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float32), np.array([len(f) for f, _ in rows]))
    for p, (f, v) in zip(got, rows):
        z = m.bias + sum(m.weights[i] * x for i, x in zip(f, v))
        z += sum(float(m.factors[f[i]] @ m.factors[f[j]]) * v[i] * v[j] for i in range(len(f)) for j in range(i + 1, len(f)))
        assert p == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4, abs=1e-6)


def good_and_bad(n=240):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    good = [". ".join(" ".join(rng.choices(words, k=9)) for _ in range(5)) + "." for _ in range(n)]
    bad = [" ".join(w.upper() + "$$$" for w in rng.choices(words, k=30)) for _ in range(n)]
    return good, bad


def test_quality_learns_and_scores_odd_texts(spark):
    good, bad = good_and_bad()
    docs = docs_of(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(good) * 2)] + [(None, 1), (3, None), (10**9, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, metadata_cols=("n_chars",))
    rows = quality.score(docs, model, metadata_cols=("n_chars",)).collect()
    assert len(rows) == len(good) * 2 + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["doc_id"] < len(good) * 2 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] < len(good)) for r in held]) > 0.95
    assert quality.score(docs.limit(0), model, metadata_cols=("n_chars",)).count() == 0
    flat = quality.train(docs, labels.where("quality = 1"), metadata_cols=("n_chars",))
    assert all(r["score"] > 0.5 for r in quality.score(docs, flat, metadata_cols=("n_chars",)).collect())


# toxicity


def test_noisy_or():
    z = np.array([-3.0, 0.5, -8])
    assert toxicity.noisy_or(z) == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z)))) and toxicity.noisy_or(np.zeros(0), -2.0) == pytest.approx(1 / (1 + np.exp(2.0))) and toxicity.noisy_or(np.zeros(0)) == 0


def test_sentences_of_long_texts_come_in_pieces(monkeypatch):
    text = "One two! three. " * 40 + "\n\nfour"
    whole, z = toxicity.sentences(text), toxicity._of(text, lambda p: np.array([len(s) for s in p]))
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 9)
    assert toxicity.sentences(text) == whole and len(list(toxicity.pieces(text))) > 5
    assert toxicity._of(text, lambda p: np.array([len(s) for s in p])).tolist() == z.tolist() == [len(s) for s in whole]


def clean_and_toxic(n=150):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    clean = [". ".join(" ".join(rng.choices(words, k=8)) for _ in range(12)) for _ in range(n)]
    toxic = [t.replace(t.split(". ")[5], t.split(". ")[5] + " " + rng.choice(["badword", "worseword"])) for t in (". ".join(" ".join(rng.choices(words, k=8)) for _ in range(12)) for _ in range(n))]
    return clean, toxic


def test_toxicity_learns_and_locates(spark):
    clean, toxic = clean_and_toxic()
    docs = docs_of(spark, clean + toxic + ODD)
    labels = spark.createDataFrame([(i, int(i >= len(clean))) for i in range(len(clean) * 2)] * 2 + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    n = len(clean) * 2
    held = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i]["predicted"] == int(i >= len(clean)) for i in held]) > 0.97
    assert np.mean([rows[i]["worst_sentence"] == 5 for i in held if i >= len(clean)]) > 0.9
    for k, t in enumerate(ODD):
        r = rows[n + k]
        assert 0 <= r["score"] < 0.5 and (r["worst_sentence"] is None) == (not toxicity.sentences(t)) and (toxicity.sentences(t) or r["score"] == pytest.approx(1 / (1 + np.exp(-model.bias))))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(1 for r in rows.values() if r["score"] < 0.5)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.drop_toxic(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("predicted = 1").count() == 0


def test_length_alone_is_not_toxic(spark):
    clean, toxic = clean_and_toxic()
    model = toxicity.fit(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    unknown, known = "nothing here to see", clean[0].split(". ")[0]
    long = [(s + end) * 100_000 for s in (unknown, known) for end in (". ", "\n")]
    docs = docs_of(spark, [*long, *[t + " badword." for t in long], unknown])
    for m in (model, toxicity.Model(-6.2, model.weights), toxicity.Model(toxicity.PRIOR, {})):
        rows = {r["doc_id"]: r for r in toxicity.score(docs, m).collect()}
        assert all(rows[i]["score"] == pytest.approx(rows[8]["score"]) and not rows[i]["predicted"] for i in (0, 1))
        assert not rows[2]["predicted"] and not rows[3]["predicted"]
        assert all(rows[i]["predicted"] == bool(m.weights) for i in range(4, 8))
        assert not m.weights or all(rows[i]["worst_sentence"] == 100_000 for i in range(4, 8))
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()) == [0, 1, 2, 3, 8]


def test_samples_are_bounded_and_whole(spark):
    docs = docs_of(spark, ["aaa", "bb", None, "c" * 50], ids=[1, 2, 3, 4])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 0), (4, 1)], "doc_id long, toxic int")
    assert sorted(labelled.sample(docs, labels, "toxic")) == [("", 0), ("aaa", 1), ("c" * 50, 1)]
    assert len(labelled.sample(docs, labels, "toxic", most_docs=2)) == 2
    assert sum(len(t) for t, _ in labelled.sample(docs, labels, "toxic", most_chars=10)) <= 10


def test_a_long_text_leaves_other_rows_in_the_sample(spark):
    texts = {i: "x" * (i % 7 + 1) for i in range(60)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    by_hash = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id")).collect()]
    for at, long in ((0, 5_000), (30, 5_000), (59, 5_000), (0, 900)):
        own = texts | {by_hash[at]: "y" * long}
        docs = docs_of(spark, [*own.values(), own[by_hash[1]]], ids=[*own, by_hash[1]])
        want = [(own[i], i % 2) for i in by_hash if len(own[i]) < 10]
        assert labelled.sample(docs, labels, "toxic", most_chars=1_000) == want
    want = [(own[i], i % 2) for i in by_hash]
    assert labelled.sample(docs, labels, "toxic", most_chars=1_200) == want
    assert len(labelled.sample(docs_of(spark, ["z" * 400] * 60), labels, "toxic", most_chars=1_000)) == 2
    one = [*own.values()]
    one[by_hash[0]] = "y" * 30_000_000
    assert len(labelled.sample(docs_of(spark, one), labels, "toxic")) == 59


# mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, budget, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(w[s] for s in left)
        over = [s for s in left if w[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: w[s] * level for s in left}
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
            left.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 50, None: 7}, {"a": 0, "b": 3}, {"z": 10}, {"é": 5, "e": 500, "f": 3, "g": 80, "h": 1, "i": 400}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes)) and all(t <= 2 * sizes[s] + 1e-9 for s, t in got.items())


def test_equal_rows_draw_each_for_itself(spark):
    docs = docs_of(spark, ["one two three"] * 3_000 + ["other words here"] * 500 + [None] * 3, ids=[7] * 3_000 + list(range(500)) + [None] * 3, sources=["a"] * 3_000 + ["b"] * 500 + ["c"] * 3)
    taken = lambda df: sorted((r["doc"]["source"], str(r["doc"]["doc_id"]), r["copies"]) for r in mixing.mix(df).collect())
    rows = taken(docs)
    words = sum(c * 3 for s, _, c in rows if s == "a")
    target = plain_targets({"a": 9_000, "b": 1_500, "c": 0})["a"]
    assert len(rows) == 3_503 and abs(words - target) < 0.05 * target
    assert rows == taken(docs.repartition(5)) and mixing.mix(docs).schema == mixing.mix(docs.limit(1)).schema


def test_mix(spark):
    rng = random.Random(3)
    texts = ["w " * rng.randrange(1, 30) for _ in range(900)] + ODD
    sources = [None if i % 11 == 0 else f"s{i % 5}" if i % 3 else "hot" for i in range(len(texts))]
    docs = docs_of(spark, texts, ids=[None if i == 7 else i // 2 if i < 4 else i for i in range(len(texts))], sources=sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    for source in set(sources):
        own = [r for r in rows if r["doc"]["source"] == source]
        rate = own[0]["target"] / own[0]["source_size"] if own[0]["source_size"] else 0
        assert {r["copies"] for r in own} <= {math.floor(rate), math.floor(rate) + 1, 2} and max(r["copies"] for r in own) <= 2
        noise = math.sqrt(sum(r["size"] ** 2 for r in own) / 4)
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 4 * noise + 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.emit(mixing.mix(docs))
    assert out.schema == docs.schema and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_without_ids_draw_each_for_itself(spark):
    docs = docs_of(spark, [f"text {i} of some words" for i in range(600)], ids=[None] * 300 + [7] * 300, sources=["a", "b", "c"] * 200)
    rows = mixing.mix(docs).collect()
    for ids in (None, 7):
        taken = [r["copies"] for r in rows if r["doc"]["doc_id"] == ids and r["target"] % r["source_size"]]
        assert len(set(taken)) > 1
    assert abs(sum(r["size"] * r["copies"] for r in rows) - 1.5 * 3000) < 300


# lines


def plain_lines(rows):
    """Removed positions by id, by looking at all windows in order."""
    first, gone = {}, {}
    for i, text in sorted(rows):
        lines = [x.strip(" ") for x in text.split("\n")]
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(w):
                continue
            a = first.setdefault(w, (i, p))
            if a != (i, p) and not (a[0] == i and p < a[1] + 3):
                gone.setdefault(i, set()).update(range(p, p + 3))
    return gone


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(12)] + ["", " "]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.7 else f"own {rng.random()}" for _ in range(rng.randrange(0, 40))) for _ in range(120)]
    texts += ["A\n" * 9, "p1\np2\np3\np4\np5", "x\np1\np2\np3\np4\np5\ny", "\n\n\n\n\n", "one", ""]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    gone = plain_lines(list(enumerate(texts)))
    for i, t in enumerate(texts):
        kept = [x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())]
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["text"]) == (t.count("\n") + 1, len(gone.get(i, ())), "\n".join(kept)), i


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line {i}" for i in range(100_000)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark, ["\n".join(lines), "x\n" + "\n".join(lines[500:504])])).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["n_lines"] == 100_000 and (got[1]["n_removed"], got[1]["text"]) == (4, "x")


def test_line_dedup_of_odd_rows(spark):
    same = "a\nb\nc\nd"
    docs = docs_of(spark, [None, "", same, same, same, "z\r\nq"], ids=[1, 2, None, 3, 3, 4])
    rows = line_dedup.dedup_lines(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], str(r["text"])) for r in rows) == sorted([("1", 0, "None"), ("2", 0, ""), ("None", 0, same), ("3", 4, ""), ("3", 4, ""), ("4", 0, "z\r\nq")])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


# decontamination


def plain_overlap(text, items):
    words = decontamination.words(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontamination.words(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == w[i : i + k]:
                    hit.update(range(p, p + k))
                    found.add(str(item) if item is not None else "")
    names = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("slice_rows", [200_000, 9])
def test_overlaps(spark, slice_rows):
    rng = random.Random(6)
    vocabulary = ["The", "a", "of", "naïve", "ÉTÉ", "x1", "it's", "zebra", "quill", "mauve"]
    items = [(i if i else None, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 13, 14, 20])))) for i in range(14)] + [(50, None), (3, "of a of"), (99, "zebra quill mauve x1")]
    texts = [" ".join(rng.choices(vocabulary + [f"n{i}" for i in range(30)], k=rng.randrange(60))) for _ in range(40)]
    texts += [f"before, {t} after" for _, t in items if t] + [f"{t[:-3]}" for _, t in items if t] + ["The " * 400, *ODD]
    docs, bench = docs_of(spark, texts), spark.createDataFrame([(i, t, "n") for i, t in items], "item_id long, text string, doc_id string").repartition(2)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.overlaps(docs, bench, slice_rows=slice_rows).collect()}
    want = {i: plain_overlap(t, items) for i, t in enumerate(texts)}
    assert got == want
    kept = decontamination.drop_contaminated(docs, bench, slice_rows=slice_rows)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in want.items() if not w[4])


def test_words_of_long_texts_are_numbered_in_pieces(monkeypatch):
    w = decontamination.Windows([(["a", "b", "c"], "1")])
    text = "A  b, c zz " * 50 + "abc"
    whole = w.number(text)
    monkeypatch.setattr(decontamination, "PIECE_BYTES", 7)
    assert w.number(text).tolist() == whole.tolist() == [w.vocabulary.get(x, 0) for x in decontamination.words(text)] and w.number(None).tolist() == []


def test_the_filter_passes_what_it_has(spark):
    words = [b"naive", "été".encode(), b"x1", b"zebra", b"quill"]
    hashes = decontamination._hashes(words, 0, 5, 2)
    df = spark.createDataFrame([(w.decode(),) for w in words], "w string").select(F.xxhash64("w").alias("hash"))
    assert [r[0] for r in df.collect()] == decontamination._hashes(words, 0, 5, 1).tolist()
    assert [r[0] for r in spark.range(1).select(F.xxhash64(F.lit("x1 zebra"))).collect()] == [hashes[2]] and len(hashes) == 4
    bits = decontamination._bits(df.unionByName(spark.createDataFrame([(0,), (-1,), (decontamination.FILTER_BITS - 1,), (32_768,)], "hash long"))).value
    some = np.array([0, 1, -1, -2, 32_767, 32_768, 32_769, *decontamination._hashes(words, 0, 5, 1), *hashes])
    assert decontamination._passing(some, bits).tolist() == [0, 2, 5, 7, 8, 9, 10, 11] and np.unpackbits(bits).sum() == 8


def test_candidates_of_long_texts_come_in_pieces(monkeypatch):
    text = "A  b, c zz ÉTÉ " * 40 + "abc"
    ws = decontamination.words(text)
    all_of = [(i, tuple(ws[i : i + 3])) for i in range(len(ws) - 2)]
    for piece in (1 << 20, 1, 7, 60):
        monkeypatch.setattr(decontamination, "PIECE_BYTES", piece)
        runs = list(decontamination._runs(text, 6))
        assert [(base + i, tuple(w[i : i + 3])) for base, w, low, high in runs for i in range(low, high) if i + 3 <= len(w)] == all_of
        assert all(w[max(0, i - 6) : i + 6] == ws[max(0, base + i - 6) : base + i + 6] for base, w, low, high in runs for i in range(low, high))
    assert list(decontamination._runs("", 6)) == [] and decontamination._n_words(text) == len(ws) and decontamination._n_words(" .") == 0


def test_many_copies_and_null_ids_join_whole(spark):
    item = " ".join(f"w{i}" for i in range(20))
    texts = [item + " and more"] * 200 + ["clean words"] * 50 + [None, item[:-4]]
    docs = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    bench = spark.createDataFrame([(1, item), (2, item), (3, "of a")], "item_id long, text string")
    rows, joined = (sorted(map(str, decontamination.overlaps(docs, bench, slice_rows=n).collect())) for n in (200_000, 0))
    assert rows == joined and len(rows) == 252
    assert decontamination.drop_contaminated(docs, bench, slice_rows=0).count() == 51
    assert decontamination.overlaps(docs, bench.limit(0), slice_rows=-1).where("n_hit > 0").count() == 0 and decontamination.overlaps(docs.limit(0), bench, slice_rows=0).count() == 0


def test_overlaps_of_empty_tables(spark):
    docs, bench = docs_of(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) for r in decontamination.overlaps(docs, bench).collect()] == [(0, 0, False, hashlib.sha256(b"").hexdigest())] * 2
    assert decontamination.overlaps(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").withColumn("held", labelled.in_fold(F.col("doc_id"), 5, 0))
    assert all(r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in df.collect())
