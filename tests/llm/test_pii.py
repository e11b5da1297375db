import hashlib
import itertools
import math
import random
import re

import pytest

from locatext.llm import pii
from locatext.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rnd = random.Random(2)
    pieces = ["a.b@c.d", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "+", ".", "-", " ", "é", "0007", "x@y", "@z.com", "12", "%", "(", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("9" * 20000 + ".1.1.1") == []


def _paths(lat, w):
    """Every segmentation with its score (for small lattices)."""
    arcs = pii._segment_scores(lat, w)

    def go(i, s):
        if i == lat.n:
            yield 0.0, ()
            return
        for v, rest in go(i + 1, 0):
            yield v, rest
        for j in range(i + 1, lat.n + 1):
            for a, scores, _ in arcs[j]:
                if a == i:
                    for k, x in enumerate(scores, 1):
                        if x > -math.inf:
                            for v, rest in go(j, k):
                                yield v + x + pii._after(s, w)[k], ((pii._STATES[k], lat.cuts[i], lat.cuts[j]), *rest)

    return list(go(0, 0))


def test_decoding_and_likelihood_against_all_segmentations():
    w = dict(pii.train())
    for text in ("tok 12-34-5678 x", "@me_1 1.2.3.4 id", "call 030 1234 5678"):
        lat = pii.Lattice(text, 0, len(text), pii._disjoint(pii.base_spans(text)))
        paths = _paths(lat, w)
        assert abs(max(v for v, _ in paths) - next(v for v, p in paths if list(p) == pii.decode(lat, w))) < 1e-9
        gold = set(next(p for _, p in paths if len(p) == 1))
        ll, grad = pii._gradient(lat, gold, w)
        z = pii._lse([v for v, _ in paths])
        assert abs(ll - (next(v for v, p in paths if set(p) == gold) - z)) < 1e-6
        for f in itertools.islice(sorted(grad), 0, None, 17):
            up, down = dict(w), dict(w)
            up[f], down[f] = w.get(f, 0) + 1e-4, w.get(f, 0) - 1e-4
            assert abs((pii._gradient(lat, gold, up)[0] - pii._gradient(lat, gold, down)[0]) / 2e-4 - grad[f]) < 1e-3


def test_held_out_accuracy_of_the_added_kinds():
    w, right, found, gold_n = pii.train(), 0, 0, 0
    for text, gold in pii._sentences(99, 400):
        base, every = pii.find_spans(text, w)
        added = set(every) - set(base)
        gold = {g for g in gold if not any(a < g[2] and g[1] < b for _, a, b in base)}
        right, found, gold_n = right + len(added & gold), found + len(added), gold_n + len(gold)
    assert right / gold_n > 0.85 and right / found > 0.85


@pytest.mark.parametrize("n", [1, 3])
def test_rows(spark, n):
    rows = [(1, None, "a"), (2, "", "a"), (3, 'a@b.co 1.2.3.4 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "a"), (None, "x", None)] * n
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.find(df).collect()
    assert len(out) == 4 * n
    r = next(r for r in out if r["doc_id"] == 3)
    assert (r["n_email"], r["n_ip"]) == (1, 1) and r["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert r["spans"].startswith("email:0:6,ip:7:14,secret:") and r["found"][2]["text"].startswith("04dbe")
    assert pii.find(df.limit(0)).count() == 0


def test_long_unbroken_text_is_linear():
    pii.find_spans("a1@" * 60000, pii.train())


@pytest.mark.parametrize(
    "before,value,after,kind",
    [
        ("please pay to iban ", "GB29 NWBK 6016 1331 9268 19", " today", "account"),
        ("konto ", "NL91 ABNA 0417 1643 00", ".", "account"),
        ("iban: ", "IE29 AIBK 9311 5212 3456 78", "", "account"),
        ("iban ", "MT84 MALT 0110 00A1 2B45 M1L2 AST0 01S", " ok", "account"),
        ("my password: ", "hunterXsecretABCdefghij", " end", "secret"),
        ('the token = "', "AbCdEfGhIjKlMnOpQrStUvWx", '" x', "secret"),
    ],
)
def test_values_that_are_not_runs_of_digits(before, value, after, kind):
    _, every = pii.find_spans(before + value + after, pii.train())
    assert every == [(kind, len(before), len(before) + len(value))]


def test_a_word_that_announces_nothing():
    assert pii.find_spans("the token holder and the key person kept a secret meeting", pii.train())[1] == []


def test_whole_table_against_the_patterns(spark):
    """op1_pii on every document of sf0.001: base spans as the patterns say, and all of
    them among the spans."""
    d = "/root/testdata/sf0.001"
    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(re.sub("[ -]", "", m)[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    got = {r["doc_id"]: r for r in QUERIES["op1_pii"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        base = [(k, *m.span()) for k, form, good in forms for m in re.finditer(form, r["text"] or "") if good(m[0])]
        said = [f"{k}:{s}:{e}" for k, s, e in base]
        out = got[r["doc_id"]]
        assert [out[f"n_{k}"] for k, _, _ in forms] == [sum(b[0] == k for b in base) for k, _, _ in forms]
        assert out["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        every = out["spans"].split(",") if out["spans"] else []
        assert len(every) == out["n_spans"] and set(said) <= set(every)
