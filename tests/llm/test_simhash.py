"""SimHash against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash

from emberlens.llm import gray_index, simhash
from emberlens.llm.components import connected_components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(codes, h):
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i in range(len(codes)):
            for j in range(len(codes)):
                if bin(codes[i] ^ codes[j]).count("1") <= h and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


TEXTS = ["", None, " \t\n", "One two", "ONE  two", "Ärger ÄRGER ä", "a b c d e f g " * 300, "the the the the", "x\x0by\x0cz w q", "one two"]


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def clusters(rng, n):
    """Random codes with neighbourhoods and chains."""
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 7), replace=False))) for b in base for _ in range(4)]
    return np.unique(np.concatenate([base, np.array(near, np.uint64)]))


@pytest.mark.parametrize("bucket, depth", [(50_000, 3), (20, 2), (8, 1)])
def test_links_join_what_all_pairs_join(spark, bucket, depth):
    codes = clusters(np.random.default_rng(bucket), 60)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    got = connected_components(gray_index.link(df, 4, bucket, depth)).collect()
    name = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    want = brute_components([int(c) for c in codes], 4)
    groups = {}
    for i, lab in enumerate(want):
        groups.setdefault(lab, set()).add(i)
    found = {}
    for r in got:
        found.setdefault(name[r["root"]], set()).add(name[r["node"]])
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_dense_bucket_in_one_task():
    rng = np.random.default_rng(5)
    codes = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 4), replace=False)) for _ in range(1200)], np.uint64))
    codes = codes[np.argsort(gray_index.gray_rank(codes))]
    got = gray_index.components(np.zeros(len(codes), np.int64), codes, 1)
    want = brute_components([int(c) for c in codes], 1)
    assert len(set(got.tolist())) == len(set(want)) and all((got[i] == got[j]) == (want[i] == want[j]) for i in range(0, len(codes), 7) for j in range(len(codes)))


def random_codes(n, seed=1):
    codes = np.unique(np.frombuffer(np.random.default_rng(seed).bytes(8 * n), np.uint64))
    return codes[np.argsort(gray_index.gray_rank(codes))]


def test_the_index_prunes_below_a_node():
    """Of 20,000 fingerprints below one upper node, a search meets a tenth of all pairs in the mean over the blocks."""
    shares = []
    for before, least in gray_index.carried(gray_index.blocks_of(0, 4), 0).values():
        codes, work = random_codes(20_000, least), gray_index.Work()
        gray_index.components(np.zeros(len(codes), np.int64), codes, 4, np.full(len(codes), before, np.uint64), np.full(len(codes), least), work)
        shares.append((work.nodes + work.codes) / (len(codes) * (len(codes) - 1) / 2))
        assert work.codes < 0.1 * work.nodes + work.left and work.left > 0.2 * work.nodes
    assert shares == sorted(shares, reverse=True) and sum(shares) / 5 < 0.12 and shares[-1] < 0.01


def test_work_of_the_whole_tree():
    codes, work = random_codes(100_000), gray_index.Work()
    for mask, (before, least) in gray_index.carried(gray_index.blocks_of(0, 4), 0).items():
        bits = codes & np.uint64(mask)
        order = np.lexsort((gray_index.gray_rank(codes), bits))
        gray_index.components(bits[order], codes[order], 4, np.full(len(codes), before, np.uint64), np.full(len(codes), least), work)
    assert work.nodes + work.codes < 0.002 * len(codes) * (len(codes) - 1) / 2


def test_links_are_found_at_the_first_block_they_agree_on():
    codes = clusters(np.random.default_rng(9), 150)
    label = {int(c): int(c) for c in codes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for mask, (before, least) in gray_index.carried(gray_index.blocks_of(0, 4), 0).items():
        bits = codes & np.uint64(mask)
        order = np.lexsort((gray_index.gray_rank(codes), bits))
        own = codes[order]
        got = gray_index.components(bits[order], own, 4, np.full(len(codes), before, np.uint64), np.full(len(codes), least))
        for a, b in zip(own, own[got]):
            a, b = find(int(a)), find(int(b))
            label[max(a, b)] = min(a, b)
    want = brute_components([int(c) for c in codes], 4)
    found = [find(int(c)) for c in codes]
    assert len(set(found)) == len(set(want)) == len(set(zip(found, want)))


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [*TEXTS, base, base.replace("w399", "zz"), base, "quite another text with other words in it"]
    rows = [(i if i != 1 else None, t, f"f{i}", i) for i, t in enumerate(texts)] + [(10, base, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, code int").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_print(r[1] or "") for r in rows]
    label = brute_components(prints, 4)
    least = {}
    for r, lab in zip(rows, label):
        if r[0] is not None:
            least[lab] = min(least.get(lab, r[0]), r[0])
    want = sorted((str(r[0]), f"{p:016x}", least[lab]) for r, p, lab in zip(rows, prints, label))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    least = {}
    for r, lab in zip(rows, label):
        key = (r[0] is None, r[0] or 0)
        least[lab] = min(least.get(lab, key), key)
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(least.values())
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long, "x"), (2, long + " end", "y"), (3, long[: len(long) // 3], "z")], "doc_id long, text string, code string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert got[2]["component_id"] == 1 and got[1]["fingerprint"] == f"{brute_print(long):016x}"
    assert [r["doc_id"] for r in simhash.keep_one(docs.where("doc_id < 3")).collect()] == [1]
