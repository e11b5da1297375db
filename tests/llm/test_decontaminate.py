import random
import re

import pytest

from locatext.llm import decontaminate as D
from locatext.llm import queries as Q


def naive(item, text, least):
    """Greedy string tiling by comparing every pair of positions."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and i + k not in used_i and t + k not in used_t:
                    k += 1
                if k >= least and (best is None or (-k, i, t) < best):
                    best = (-k, i, t)
        if best is None:
            return out
        k, i, t = -best[0], best[1], best[2]
        used_i |= set(range(i, i + k))
        used_t |= set(range(t, t + k))
        out.append((i, t, k))


def test_tiling_against_all_pairs():
    rnd = random.Random(4)
    for _ in range(400):
        item = [rnd.randrange(4) for _ in range(rnd.randrange(1, 25))]
        text = [rnd.randrange(4) for _ in range(rnd.randrange(1, 40))]
        for least in (1, 3, 5):
            got, want = D.tiles(item, text, least), naive(item, text, least)
            assert sum(k for *_, k in got) == sum(k for *_, k in want)


def plain_words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, least=5, need=0.5):
    out = set()
    for d, t in docs:
        for i, b in items:
            ids = {}
            w, x = ([ids.setdefault(v, len(ids) + 1) for v in plain_words(y)] for y in (b, t))
            if w:
                covered = sum(k for *_, k in D.tiles(w, x, min(least, len(w))))
                if covered >= need * len(w):
                    out.add((d, i, len(w), covered))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 150])
def test_planted_cases_against_brute_force(spark, part_bytes):
    a = "the quick brown fox jumps over the lazy dog while seven wizards watch from the old tower"
    b = "Über allen Gipfeln ist Ruh, in allen Wipfeln spürest du kaum einen Hauch."
    half = a.split()
    moved = " ".join(half[9:] + ["and", "then"] + half[:9])
    docs = [(1, f"x y {a.upper()}! z"), (2, moved), (3, "nothing here"), (4, None), (5, ""), (6, " ".join(half[:6])), (7, b.replace(" ", "### ")), (8, "tiny item"), (9, a + " " + a), (10, ("w " * 5000) + b), (10, "again " + b)]
    items = [(100, a), (101, b), (102, "tiny item"), (103, None), (104, ""), (100, a)]
    found = D.find_leaks(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes).collect()
    assert {tuple(r)[:4] for r in found} == brute(docs, items)
    assert {r["doc_id"] for r in found} == {1, 2, 7, 8, 9, 10}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs, items).count() == 0
    assert D.find_leaks(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    # Pairs without a common run of five words cannot be tiled; brute force the rest.
    runs = lambda t: {tuple(w[i : i + 5]) for w in [plain_words(t)] for i in range(len(w) - 4)}
    of_item = [(i, b, runs(b)) for i, b in items]
    want = set()
    for x, t in docs:
        r = runs(t)
        want |= brute([(x, t)], [(i, b) for i, b, s in of_item if s & r])
    assert {tuple(r)[:4] for r in Q.op9_decontaminate(spark, d).collect()} == want


def test_repeated_documents_items_and_a_very_long_text(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    docs = [(1, item), (1, item), (2, None), (3, "!!!"), (4, "x " * 300_000 + item + " y" * 300_000)]
    leaks = D.find_leaks(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(9, item), (9, item), (8, None)], "item_id long, text string"))
    got = sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in leaks.collect())
    assert got == [(1, 9, 10)] * 4 + [(4, 9, 10)] * 2
