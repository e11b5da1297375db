import hashlib
import random
from collections import Counter

import pytest

from locatext.llm import queries as Q
from locatext.llm import repeats as R


def brute(texts, length):
    """Every window's count; covered bytes go."""
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made(rnd, n):
    pool = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randrange(5, 60))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = "".join(rnd.choice(pool) if rnd.random() < 0.5 else "".join(rnd.choice("efghij") for _ in range(rnd.randrange(30))) for _ in range(rnd.randrange(9)))
        out.append(t)
    return out


def brute_words(rows, length):
    """Words in runs of ``length`` that another document (id and text) holds too."""
    said = [(t or "").encode().split() for _, t in rows]
    owners = {}
    for r, w in zip(rows, said, strict=True):
        for i in range(len(w) - length + 1):
            owners.setdefault(tuple(w[i : i + length]), set()).add((r[0], r[1] or ""))
    out = []
    for w in said:
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if len(owners[tuple(w[i : i + length])]) > 1:
                gone[i : i + length] = b"\x01" * length
        out.append((sum(gone), any(gone)))
    return out


@pytest.mark.parametrize("options", [dict(length=20, gram=6), dict(length=20, gram=6, max_pieces=2, step=4, hot_rows=5), dict(length=24, gram=5, max_pieces=1, step=7), dict(length=12, gram=12, hot_rows=1)])
def test_against_all_windows(spark, options):
    rnd = random.Random(options["length"] + options.get("max_pieces", 0))
    texts = made(rnd, 60) + ["a" * 300, "ab" * 90, "", None, "x" * 19, "same text that is long enough to be repeated", "same text that is long enough to be repeated"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (6, "another text under a repeated id 123456789"), (None, texts[7]), (None, "nothing like it: 0918273645 @@@@@@@@@")]
    rows += [(200, "a b a c\ta b  a c d"), (201, "x a b a c a b a c"), (202, "q q q q q q q"), (203, "x a b a c a b a c a b"), (203, "x a b a c a b a c a b")]
    words = options["length"] // 5
    want = [(*x, *y) for x, y in zip(brute([(t or "").encode() for _, t in rows], options["length"]), brute_words(rows, words), strict=True)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, tag int, id int")
    given = dict(options)
    kind, runs = R.Strings(1, given.pop("length"), given.pop("gram")), R.Strings(8, words, 2, across=True)
    got = sorted((tuple(r) for r in R.remove(docs, kind=kind, runs=runs, **given).collect()), key=str)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=str)


def test_maximal_repeats_have_all_occurrences_and_are_maximal():
    rnd = random.Random(8)
    for _ in range(150):
        texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(14))).encode() + b"##" + "".join(rnd.choice("ab") for _ in range(rnd.randrange(14))).encode() for _ in range(7)]
        lefts, rights = [t.split(b"##")[0][::-1] for t in texts], [b"##" + t.split(b"##")[1] for t in texts]
        got = {(left, right, tuple(sorted(g))) for left, right, g in R.maximal_repeats(lefts, rights, 6)}
        want = set()
        for i in range(7):
            for left in range(len(lefts[i]) + 1):
                for right in range(2, len(rights[i]) + 1):
                    have = [j for j in range(7) if lefts[j][:left] == lefts[i][:left] and len(lefts[j]) >= left and rights[j][:right] == rights[i][:right] and len(rights[j]) >= right]
                    further_l = {lefts[j][left : left + 1] for j in have}
                    further_r = {rights[j][right : right + 1] for j in have}
                    if len(have) > 1 and left + right >= 6 and (len(further_l) > 1 or b"" in further_l) and (len(further_r) > 1 or b"" in further_r):
                        want.add((left, right, tuple(have)))
        assert got == want


def test_stretches_of_a_long_text(spark, monkeypatch):
    rnd = random.Random(5)
    t = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    docs = spark.createDataFrame([(1, t + t[500:900]), (2, t[100:300])], "doc_id long, text string")
    monkeypatch.setattr(R, "STRETCH", 700)
    got = sorted(tuple(r)[1:5] for r in R.remove(docs, kind=R.Strings(1, 40, 10)).collect())
    assert got == sorted(brute([(t + t[500:900]).encode(), t[100:300].encode()], 40))


def test_stretches_of_many_words(spark, monkeypatch):
    rnd = random.Random(6)
    words = [rnd.choice("abcdefgh") for _ in range(400)]
    rows = [(1, " ".join(words)), (2, "\n".join(words[90:180])), (3, " ".join(words[:9]))]
    monkeypatch.setattr(R, "STRETCH", 70)
    got = sorted(tuple(r)[0:1] + tuple(r)[5:] for r in R.remove(spark.createDataFrame(rows, "doc_id long, text string"), runs=R.Strings(8, 12, 3, across=True)).collect())
    assert got == [(r[0], *w) for r, w in zip(rows, brute_words(rows, 12), strict=True)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.remove(docs).count() == 0


def test_query_against_all_windows(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = zip(brute([t.encode() for _, t in rows], 400), brute_words(rows, 51), strict=True)
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op3_suffix_dedup(spark, d).collect()}
    assert got == {i: (*x, *y) for (i, _), (x, y) in zip(rows, want, strict=True)}
    assert any(r[5] and not r[1] for r in got.values())
