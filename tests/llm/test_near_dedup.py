import random
import re

import numpy as np
import pytest

from locatext.llm import near_dedup as N
from locatext.llm import queries as Q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=4):
    """All pairs, by a plain inverted index of shingles."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    owners, parent = {}, {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    near = {}
    for ids in owners.values():
        for a in ids:
            for b in ids:
                if a < b:
                    near[a, b] = near.get((a, b), 0) + 1
    for (a, b), n in near.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def family(rnd, start, n, words=60, edits=3):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    for j in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        yield start + j, " ".join(w)


@pytest.mark.parametrize("block,pivots", [(4, 2), (2048, 2), (2048, 1)])
def test_families_chains_and_common_passages(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PIVOTS", pivots)
    rnd = random.Random(11)
    rows = [r for f in range(12) for r in family(rnd, 1000 * f + 7, 9)]
    chain = [f"c{i}" for i in range(80)]
    for j in range(12):  # neighbours are near, ends are far
        chain = chain[3:] + [f"n{j}a", f"n{j}b", f"n{j}c"]
        rows.append((20000 + j, " ".join(chain)))
    common = " ".join(f"p{i}" for i in range(40))
    rows += [(30000 + j, common + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(25))) for j in range(30)]
    rows += [(40000, None), (40001, ""), (40002, " \t\n"), (40003, "One two"), (40004, "one TWO"), (40005, "one  two three"), (40006, "É a"), (40007, "é a"), (40008, "x " * 30000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component_id int, n int")
    got = {r["doc_id"]: tuple(r)[1:] for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "A b c d e")], "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2, 3, False), (5, 2, 3, False), (None, 2, None, True), (3, 2, 3, True)], key=str)
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(3)
    for d in (0, 1, N.T // 2, N.T):
        for _ in range(60):
            a = rng.integers(0, 1 << N.BITS, N.K).astype(np.uint16)
            b = a.copy()
            b[rng.choice(N.K, d, replace=False)] ^= 1
            x, y = N.index_keys(np.stack([a, b]))
            assert (x == y).any()


def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["component"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == root(i) for i in parent)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op8_near_dedup(spark, d).collect()}
    assert got == brute(rows)


def test_common_edits_against_all_pairs():
    rnd = random.Random(9)
    for _ in range(300):
        pivot = set(range(60))
        sets = []
        for _ in range(14):
            gone = {rnd.randrange(60) for _ in range(rnd.randrange(16))}
            sets.append((pivot - gone) | {rnd.randrange(100, 130) for _ in range(rnd.randrange(8))})
        jac = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
        component = [0 if jac(x, pivot) else i + 1 for i, x in enumerate(sets)]
        rows = [(i, component[i], len(x), np.array(sorted(x ^ pivot), dtype=np.int64)) for i, x in enumerate(sets)]
        want = {(i, j) for i in range(14) for j in range(i + 1, 14) if component[i] != component[j] and jac(sets[i], sets[j])}
        assert N.common_edits(rows) == want
