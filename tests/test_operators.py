"""Operators that have no SQL form, and properties of those that have."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from locatext.functions import lexing as L
from locatext.operators import claims, fragments, geometry, graphs, records, relations, resolution, search
from locatext.plans import planner
from locatext.sources import sinks, text


def test_bm25_against_sqlite_full_text_search(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("pump valve seal rotor shaft gauge".split()) for _ in range(rnd.randrange(1, 12)))) for i in range(60)] + [(60, "unique token here")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", rows)
    want = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'seal OR token'"))
    got = {r["id"]: r["score"] for r in search.bm25(spark.createDataFrame(rows, "id long, x string"), ["id"], "x", ["seal", "token"]).collect()}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


def test_weighted_columns_and_phrases_against_sqlite(spark):
    rnd = random.Random(4)
    words = "pump valve seal rotor shaft gauge".split()
    said = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    rows = [(i, said(12), said(4), said(3)) for i in range(80)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, c)")
    db.executemany("INSERT INTO t(rowid, a, b, c) VALUES (?, ?, ?, ?)", rows)
    want = dict(db.execute("""SELECT rowid, bm25(t, 2, 1.5, 1) FROM t WHERE t MATCH '"seal rotor" OR "gauge" OR "pump valve seal"'"""))
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    got = {r["id"]: r["score"] for r in search.bm25_columns(df, ["id"], {"a": 2, "b": 1.5, "c": 1}, ["seal rotor", "gauge", "pump valve seal"]).collect()}
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


@pytest.mark.parametrize("seed", range(3))
def test_packers_keep_their_budgets(spark, seed):
    rnd = random.Random(seed)
    rows = [(d, i, rnd.randrange(1, 900)) for d in range(5) for i in range(rnd.randrange(1, 30))]
    df = spark.createDataFrame(rows, "d long, i long, size long")
    sizes = {(d, i): s for d, i, s in rows}
    kept = {}
    for r in fragments.pack_skip(df, "d", ["i"], "size", 1000, 4).collect():
        kept.setdefault(r["d"], []).append(r["i"])
    for d, ids in kept.items():
        want, used = [], 0
        for i in sorted(i for e, i in sizes if e == d):
            if len(want) < 4 and (used + sizes[d, i] <= 1000 or not want):
                want.append(i)
                used += sizes[d, i]
        assert sorted(ids) == want
    batches = {}
    for r in fragments.pack_runs(df, "d", "i", "size", 1500, 3).collect():
        batches.setdefault((r["d"], r["batch"]), []).append(r["i"])
    assert sum(map(len, batches.values())) == len(rows)
    assert all(len(b) <= 3 and (len(b) == 1 or sum(sizes[d, i] for i in b) <= 1500) for (d, _), b in batches.items())


def test_splits_join_back(spark):
    rows = [(1, "x" * 10), (2, ""), (3, "é" * 7 + "b")]
    df = spark.createDataFrame(rows, "i long, t string").select("t", F.array_join(fragments.split_text(F.col("t"), 3), "").alias("j"))
    assert all(r["t"] == r["j"] for r in df.collect())


def test_components_and_closure(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100
    tree = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "r")], "child string, parent string")
    assert graphs.ancestors(spark, tree).count() == 6


def test_latest_revision_conflicts_and_order(spark):
    rows = [("a", "2024-01-01", "x", 1, "f"), ("a", "2024-02-01", "y", 2, "f"), ("b", "2024-01-01", "x", 1, "f"), ("b", "2024-01-01", "z", 1, "g"), ("c", None, "x", 1, "f"), ("c", "2024-01-01", "x", 1, "f"), ("d", "2024-03-01", "x", 1, "f"), ("d", "2024-01-01", "y", 2, "f")]
    for _ in range(2):
        random.Random(1).shuffle(rows)
        got = {r["s"]: (r["status"], r["value"]) for r in resolution.latest_revision(spark.createDataFrame(rows, "s string, d string, v string, q int, f string"), "s", "d", "v", "q", "f").collect()}
        assert got == {"a": ("LATEST_APPLIED", "y"), "b": ("UNRESOLVED", None), "c": ("UNRESOLVED", None), "d": ("UNRESOLVED", None)}


def test_numbering_without_a_group_window(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.7 else "cold", k) for k in rnd.sample(range(10_000), 400)]
    got = {(r["g"], r["k"]): r["n"] for r in records.numbered(spark.createDataFrame(rows, "g string, k long"), "g", "k", 256).collect()}
    for g in ("hot", "cold"):
        assert [got[g, k] for k in sorted(k for h, k in rows if h == g)] == list(range(1, sum(h == g for h, _ in rows) + 1))


def test_interval_join_against_all_pairs(spark):
    rnd = random.Random(6)
    make = lambda: [(rnd.randrange(3), i, s, s + rnd.randrange(1, 40)) for i in range(60) for s in [rnd.randrange(300)]]
    a, b = make(), make()
    got = relations.interval_join(spark.createDataFrame(a, "k int, a int, a_s long, a_e long"), spark.createDataFrame(b, "k int, b int, b_s long, b_e long"), "k", 16)
    want = {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[3] > y[2] and x[2] < y[3]}
    rows = [(r["k"], r["a"], r["b"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_statement_window_and_citation(spark):
    t = "First one. The size is 2.5 mm here. Last\nline"
    df = spark.createDataFrame([(t,)], "t string")
    at = t.index("2.5")
    row = df.select(records.statement(F.col("t"), F.lit(at), F.lit(at + 3)).alias("s"), records.citation(F.col("t"), F.lit("2.5")).alias("c"), records.citation(F.col("t"), F.lit("i")).alias("d")).first()
    assert row["s"] == "The size is 2.5 mm here." and row["c"] == at and row["d"] is None


def test_identifiers_and_status(spark):
    cases = [("RFI No. 0042", "42"), ("rfi–7-A.", "7-A"), ("no digits", None), ("rfi 9@x.com", None), ("RFI # 00", "0")]
    df = spark.createDataFrame(cases, "t string, w string").select("w", L.rfi_identifier(F.col("t")).alias("g"))
    assert all(r["w"] == r["g"] for r in df.collect())
    said = spark.createDataFrame([("not  approved",), ("Revise / Resubmit",), ("odd",)], "t string").select(L.submittal_status(F.col("t")).alias("s"))
    assert [r["s"] for r in said.collect()] == ["REJECTED", "REVISE AND RESUBMIT", "ODD"]


def test_claims_and_dispositions(spark):
    said = spark.createDataFrame([(1, "needs 4.5 and 7"), (2, "ok")], "k long, text string")
    cited = spark.createDataFrame([(1, "it is 7")], "k long, text string")
    assert [tuple(r) for r in claims.unsupported(said, cited, "k", "number").collect()] == [(1, "4.5")]
    row = spark.createDataFrame([("was not approved",)], "t string").select(claims.disposition(F.col("t")).alias("d")).first()
    assert row["d"] == "REJECTED"


EVIDENCE = [("e1", "RFI", "42", "QUESTION", "d1", "RFI 42\nStatus: Open\nWhat size?"), ("e2", "RFI", "42", "RESPONSE", "d2", "RFI 42\nUse 2 inch"), ("e3", "RFI", "7", "QUESTION", "d3", "Status: Open"), ("e4", "RFI", "7", "RESPONSE", "d4", "Status: Closed"), ("e5", "SUBMITTAL", "A-1", None, "d5", "pump data sheet")]


@pytest.mark.parametrize(
    "question,intent,outcome,values",
    [("What is the status of RFI 042?", "status", "ANSWERED", ["Open"]), ("what is the status of rfi 7", "status", "CONFLICT", ["Closed", "Open"]), ("How many RFIs are there?", "inventory_count", "ANSWERED", ["2"]), ("What was the response to RFI 42?", "rfi_content", "ANSWERED", ["RFI 42\nUse 2 inch"]), ("Which files mention RFI 42?", "item_documents", "ANSWERED", ["d1", "d2"]), ("pump sheet please", "retrieve", "CONTEXT", [])],
)
def test_questions(spark, question, intent, outcome, values):
    rows = spark.createDataFrame(EVIDENCE, "evidence_id string, workflow string, identifier string, role string, document_id string, raw_text string")
    r = planner.ask(rows, question).first()
    assert (r["intent"], r["outcome"], r["values"]) == (intent, outcome, values)
    if intent == "retrieve":
        assert r["cited"] == ["e5"]


def test_page_lines_and_columns(spark):
    words = [("p", x, y, x + 20.0, y + 10.0, t) for x, y, t in [(0.0, 0.0, "a"), (25.0, 1.0, "b"), (200.0, 0.5, "c"), (0.0, 20.0, "d"), (201.0, 21.0, "e")]]
    df = spark.createDataFrame(words, "page string, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r["text"] for r in geometry.word_lines(df).orderBy("line").collect()] == ["a b c", "d e"]
    assert [(r["col"], r["text"]) for r in geometry.column_layout(df).orderBy("col", "line").collect()] == [(1, "a b"), (1, "d"), (2, "c"), (2, "e")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(b"From: x@y.z\r\nSubject: Hi\r\nContent-Type: text/html\r\n\r\n<p>one<script>no</script><p>two")
    parts = [(r["part"], r["raw_text"]) for r in text.read_emails(spark, str(tmp_path / "in")).orderBy("ord").collect()]
    assert parts == [("HEADERS", "Subject: Hi"), ("HEADERS", "From: x@y.z"), ("BODY", "one\ntwo")]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i long, t string")
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "out"), ["i"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sinks.rebuild(df, str(tmp_path / "parts"), ["t"])
    sinks.rebuild(df.where("t = 'a'"), str(tmp_path / "parts"), ["t"])
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 3
    sinks.export_json(df, str(tmp_path / "json"), F.col("i") == 1)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"i":1,"t":"a"}']


@pytest.mark.parametrize(
    "question,outcome,values",
    [
        ("List all RFIs", "ANSWERED", sorted(["42", "7", *map(str, range(100, 112))])),
        ("List all documents", "ANSWERED", sorted(["a1.eml", "d1", "d2", "d3", "d4", "d5", *(f"n{i}" for i in range(100, 112))])),
        ("How many emails are there?", "ANSWERED", ["1"]),
        ("Which RFIs are open?", "ANSWERED", ["42"]),
        ("list rfis by status", "ANSWERED", sorted(["42: Open", "7: CONFLICT", *(f"{i}: NONE" for i in range(100, 112))])),
        ("Which RFIs does email A1.eml mention?", "ANSWERED", ["42"]),
        ("Which emails mention RFI 42?", "ANSWERED", ["a1.eml"]),
        ("What is the subject of email A1.eml?", "ANSWERED", ["Pipe size"]),
        ("Show the thread of a1.eml", "UNSUPPORTED", []),
        ("What are the attachments of a1.eml?", "UNSUPPORTED", []),
        ("Which drawings does RFI 42 reference?", "NONE", []),
        ("Which clauses does RFI 42 reference?", "NONE", []),
        ("Which submittals are related to RFI 42?", "NONE", []),
    ],
)
def test_questions_with_a_plan_or_none(spark, question, outcome, values):
    more = [("m1", "RFI", "42", None, "a1.eml", "From: x@y.z\nSubject: Pipe size\nsee RFI 42"), *((f"f{i}", "RFI", str(i), "QUESTION", f"n{i}", "What colour?") for i in range(100, 112))]
    rows = spark.createDataFrame(EVIDENCE + more, "evidence_id string, workflow string, identifier string, role string, document_id string, raw_text string")
    r = planner.ask(rows, question).first()
    assert (r["outcome"], r["values"]) == (outcome, values)


@pytest.mark.parametrize(
    "question,values",
    [
        ("Which drawings does RFI 77 reference?", ["A-1.2", "S9"]),
        ("Which clauses does RFI 77 reference?", ["PARAGRAPH:2.1"]),
        ("Which submittals are related to RFI 77?", ["SUBMITTAL:S-4"]),
        ("Which spec section applies to RFI 77?", ["033000"]),
        ("What is the cost impact of RFI 77?", ["5 USD"]),
        ("Who is assigned to RFI 77?", ["Crew 2"]),
        ("When is RFI 77 due?", ["2024-05-01"]),
    ],
)
def test_questions_read_from_forms(spark, question, values):
    text = "Cost Impact: 5 USD\nAssignee: Crew 2\nDue date: 2024-05-01\nSee sheet A-1.2 and dwg S9, para 2.1\nRelated Submittals: Submittal S-4\nSection 03 30 00"
    rows = spark.createDataFrame([("e1", "RFI", "77", None, "d", text), ("e2", "RFI", "8", None, "d", "sheet Z9")], "evidence_id string, workflow string, identifier string, role string, document_id string, raw_text string")
    r = planner.ask(rows, question).first()
    assert (r["outcome"], r["values"], r["cited"]) == ("ANSWERED", values, ["e1"])


def test_lines_of_words_by_the_running_mean_of_their_tops(spark):
    rnd = random.Random(12)
    words = [(f"p{p}", float(rnd.randrange(50)), float(rnd.randrange(60)) / 2, 0.0, 0.0, f"w{i}") for p in range(6) for i in range(rnd.randrange(25))]
    words = [(p, x, y, x + 4, y + rnd.choice([0.5, 6.0, 14.0]), t) for p, x, y, _, _, t in words]
    want = []
    for page in sorted({w[0] for w in words}):
        lines = []
        for w in sorted((w for w in words if w[0] == page), key=lambda w: (w[2], w[1], w[5])):
            if lines:
                mean = sum(v[2] for v in lines[-1]) / len(lines[-1])
                if abs(w[2] - mean) <= max(2.0, min(5.0, max(1.0, w[4] - w[2]) * 0.45)):
                    lines[-1].append(w)
                    continue
            lines.append([w])
        want += [(page, i, " ".join(v[5] for v in sorted(line, key=lambda v: v[1]))) for i, line in enumerate(lines, 1)]
    df = spark.createDataFrame(words, "page string, x0 double, y0 double, x1 double, y1 double, text string")
    assert sorted((r["page"], r["line"], r["text"]) for r in geometry.word_lines(df).collect()) == sorted(want)
