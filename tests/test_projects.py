"""Operators on project rows and fields against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from locatext.operators import fields as R
from locatext.operators import projects as P


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_fit_json_is_the_longest_start_that_fits(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice('ab"\\\n\té日🎉 ') for _ in range(rnd.randrange(60))) for _ in range(80)] + [""]
    for budget in (2, 3, 17, 40, 500):
        got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.fit_json(F.col("t"), budget).alias("x")).collect()]
        for t, x in zip(texts, got, strict=True):
            size = lambda s: len(json.dumps(s, ensure_ascii=False).encode())
            assert t.startswith(x) and size(x) <= max(budget, 2) and (x == t or size(t[: len(x) + 1]) > budget), (t, x, budget)


def test_focus(spark):
    text = "First clause here. The pump shall be tested at site, with care. Other words follow; more of them."
    assert one(spark, P.focus(F.col("t"), F.col("n")), t=text, n="pump shall be tested") == "The pump shall be tested at site, with care."
    assert one(spark, P.focus(F.col("t"), F.col("n")), t=text, n="tested pump outside") == "The pump shall be tested at site, with care."
    assert one(spark, P.focus(F.col("t"), F.col("n")), t=text, n="nothing alike at all") == text


@pytest.mark.parametrize(
    "text,want",
    [
        ("The pipe diameter is 25 mm.", [("SIZE", "25", "MM")]),
        ("Flow rate 1,200 gpm at pressure of 40 psi", [("FLOW", "1200", "GPM"), ("PRESSURE", "40", "PSI")]),
        ("See 42 for nothing", []),
        ("width height 3 m", [("HEIGHT", "3", "METER")]),
        ("", []),
    ],
)
def test_measures(spark, text, want):
    assert [tuple(x) for x in one(spark, R.measured(F.col("t")), t=text)] == want


def test_strict_objects_and_references(spark):
    strict = lambda t: one(spark, P.strict_object(F.col("t")), t=t)
    assert strict('```json\n{"a": 1}\n```') == '{"a": 1}' and strict('{"a": {"b": 1}, "c": {"b": 2}}')
    assert strict('{"a": 1, "a": 2}') is None and strict("[1]") is None and strict("no") is None
    found = one(spark, P.reference_paths(F.col("t")), t='{"x":[{"evidence_ids":["a","b"]},{"y":{"evidence_ids":["b","c"]}}],"evidence_ids":[]}')
    assert found == ["a", "b", "c"]


def test_classes(spark):
    docs = [
        (1, "Subject: RE: RFI No. 0042\nSUBMITTAL: S-1\nStatus: Closed\nResponse: yes", "RFI_RESPONSE", "42", "RESPONSE", "CLOSED"),
        (2, "SUBMITTAL: S-9\nStatus: No exceptions taken\nRFI 3", "SUBMITTAL", "S-9", "SUBMITTAL", "APPROVED"),
        (3, "RFI 7\nQuestion: why?", "RFI_QUESTION", "7", "QUESTION", None),
        (4, "RFI 8\nStatus: open\nStatus: closed", "OTHER", "8", "UNKNOWN", "CLOSED / OPEN"),
        (5, "nothing", "UNKNOWN", None, None, None),
        (6, "", "UNKNOWN", None, None, None),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "id int, text string")
    got = {r["id"]: (r["document_type"], r["identifier"], r["role"], r["status"]) for r in R.classify(df).collect()}
    assert got == {d[0]: d[2:] for d in docs}


def test_a_row_out_of_scope_fails_the_query(spark):
    rows = spark.createDataFrame([(1, "P", "S"), (2, "P", None)], "row_id long, project_id string, snapshot_id string")
    assert P.guarded(rows.where("row_id = 1"), "P", "S").count() == 1
    with pytest.raises(Exception, match="out of scope"):
        P.guarded(rows, "P", "S").collect()


def test_page_routes(spark):
    route = lambda *v: spark.createDataFrame([v], "t string, w int, g int, x int, y int").select(P.page_route(*map(F.col, "twgxy"))).first()[0]
    assert route("Door schedule", 5, 90, 9, 9) == "SCHEDULE" and route("x\n  PART 2 - PRODUCTS", 3, 0, 9, 9) == "SPEC_PAGE"
    assert route("", 0, 0, 9, 9) == "BLANK" and route("", 0, 1, 2000, 9) == "GRAPHIC_OR_SCAN"
    assert route("a", 1, 40, 9, 9) == "DRAWING" and route("a", 1, 0, 9, 1401) == "DRAWING"
    assert route("a", 120, 1, 9, 9) == "SPEC_PAGE" and route("a", 9, 1, 9, 9) == "MIXED" and route("a", 9, 0, 9, 9) == "TEXT_PAGE"
