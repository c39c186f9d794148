"""Source divergence against exact arithmetic in plain Python."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlens.llm import byte_words, divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, least_docs, most=50):
    docs, n, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        n.update((*g, t) for t in terms)
        docs.update((g[0], t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), k in docs.items():
        if k >= least_docs:
            kept[lang].append(t)
    p = {}
    for lang, source in [*groups, *((lang, None) for lang, _ in groups)]:
        own = {t: sum(n[x, s, t] for x, s in groups if x == lang) if source is None else n[lang, source, t] for t in kept[lang]}
        whole = sum(own.values()) + 5 * len(own)
        p[lang, source] = {t: 1 + 10**9 * (c + 5) // whole for t, c in own.items()}
    out = set()
    for lang, source in groups:
        pairs = [(s, sum(abs(p[lang, source][t] - p[lang, s][t]) for t in kept[lang])) for x, s in groups if x == lang and s != source]
        terms = [(t, d) for t in kept[lang] if n[lang, source, t] and (d := p[lang, source][t] - p[lang, None][t]) > 0]
        for part, items, top in (("pair", pairs, None), ("term", terms, most)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
            out |= {(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)}
    return out


def rows_of(df):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], SCHEMA).repartition(3)


def some(n=400, sources=7, words=60, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Word", "é", "中", "ÉCOLE", "x") for b in "abcdefghijkl"][:words]
    rows = []
    for i in range(n):
        s = rng.randrange(sources)
        rows.append((" ".join(rng.choices(vocabulary[s:], k=rng.randint(0, 40))) + ".", rng.choice(["en", "de"]), f"s{s}"))
    return rows


@pytest.mark.parametrize(("block", "chunk", "span"), [(16, 4096, 256), (2, 5, 2), (3, 1, 1), (1, 7, 3)])
def test_tiles(spark, monkeypatch, block, chunk, span):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("SPAN", span)):
        monkeypatch.setattr(divergence, name, value)
    # sources without terms, a language that keeps none, nulls
    rows = [*some(), ("", "en", "none"), (None, "en", None), (None, None, None), ("alone one", "fr", "a"), ("alone two", "fr", "b"), (" 12 ", "xx", "s0")]
    got = rows_of(divergence.audit(docs_of(spark, rows), least_docs=20, most_terms=5))
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 20, 5)
    assert ("fr", "a", "pair", "b", 0, 1) in got and any(r[3] == "" for r in got)


def test_many_groups_go_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "ENTRIES", 10)
    rows = some(300) + [(" ".join(["long"] * 5_000), "en", "s1")] * 30
    assert set(rows_of(divergence.audit(docs_of(spark, rows), least_docs=10))) == plain_audit(rows, 10)


def test_empty_and_repeated(spark):
    assert rows_of(divergence.audit(docs_of(spark, some(5)).limit(0))) == []
    rows = some(40) * 3
    assert set(rows_of(divergence.audit(docs_of(spark, rows), least_docs=10))) == plain_audit(rows, 10)


def test_shares_of_large_counts(spark):
    counts = [0, 1, 7, 10**9, 10**13, 4 * 10**15]
    whole = sum(counts) + 5 * len(counts)
    want = [1 + 10**9 * (c + 5) // whole for c in counts]
    assert divergence.shares(np.array(counts), whole).tolist() == want
    df = spark.createDataFrame([(c, sum(counts), len(counts)) for c in counts], "n long, total long, v long")
    assert [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()] == want


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(rows_of(queries.op12_divergence(spark, "/root/testdata/sf0.001"))) == sorted(want)


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_words_of_bytes(size):
    rng = random.Random(size)
    texts = ["".join(rng.choices("ab é中.", k=rng.choice([0, 1, 5, 30]))) for _ in range(300)]
    found = []
    for first, data, ends in byte_words.chunks(pa.array(["no", *texts]).slice(1), size):
        words, doc = byte_words.cut(data, ends, data != 0x20, np.append(False, data[:-1] == 0x2E))
        found += zip((doc + first).tolist(), words.to_pylist())
    assert found == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^ .]*\.|[^ .]+", t)]
