"""Spelling variants against all pairs of words, and the query's rows against its SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from emberlens.llm import queries, spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows, least_chars=6, least_n=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_n}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, word string, n string").repartition(3)


@pytest.mark.parametrize("top", [spelling.TOP, 2, 1])
def test_all_pairs(spark, monkeypatch, top):
    monkeypatch.setattr(spelling, "TOP", top)
    rng = random.Random(top)
    words = {"".join(rng.choices("abé", k=rng.randint(6, 8))) for _ in range(120)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "stammer", "stammerx", "stamer", "ÀÉÎÕÜß×÷"}
    rows = [(i % 50, " ".join([w.upper() if i % 2 else w] * rng.choice([1, 5, 6, 30, 160, 900])) + "-") for i, w in enumerate(sorted(words))] + [(None, "nobody " * 9), (None, "nobodys " * 50), (7, "chained " * 6 + "chaineds " * 31 + "chainedss " * 200)]
    want = plain_variants(plain_words(rows))
    assert rows_of(spelling.variants(docs_of(spark, rows))) == want
    assert any(f for _, f, *_ in want) and any(f != r and f for _, f, r, *_ in want)


def test_slips_and_odd_rows(spark):
    rows = [(i, f"common wordings {i % 3} again again again") for i in range(400)] + [(None, None), (3, ""), (4, " \n"), (5, "x" * 20_000), (6, "y" * 3_000 + " " + "y" * 3_001), (6, "short " * 9)] * 5
    got = rows_of(spelling.variants(docs_of(spark, rows)))
    assert got == plain_variants(plain_words(rows)) and {len(w) for w, *_ in got} >= {3_000, 3_001, 20_000}
    assert spelling.variants(docs_of(spark, rows).limit(0)).count() == 0


def test_roots_follow_long_ways(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w30")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(forms).collect()} == {f"w{i}": "w37" for i in range(37)} | {"a": "w37"}


def test_each_pair_is_met_once(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(150)}
    near = spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    assert {r["word"]: r["n_near"] for r in near} == {w: k for w in words if (k := sum(one_edit(w, x) for x in words))}


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = queries.op11_spelling(spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.OP11_SQL})").fetchall()
    assert rows_of(df) == set(want) and df.count() == len(want) > 100
