"""What once failed on larger tables only, on small ones."""

import random

import duckdb
import pytest

from locatext import catalog
from locatext.operators import fields, graphs


def same_as_sql(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_closure_beyond_the_row_limit_of_a_recursive_query(spark):
    rnd = random.Random(8)
    # Two parents here and there, a row twice, a node without a parent, a chain of 70.
    edges = [(f"x{i}", f"x{rnd.randrange(i)}") for i in range(1, 40)] + [("x9", "x2"), ("x9", "x2"), (None, "x5"), ("y", None)] + [(f"c{i}", f"c{i + 1}") for i in range(70)]
    want, step = [], [(c, p, 1) for c, p in edges]
    while step:
        want += step
        step = [(c, q, d + 1) for c, p, d in step for b, q in edges if p is not None and b == p]
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        got = [tuple(r) for r in graphs.ancestors(spark, spark.createDataFrame(edges, "child string, parent string")).collect()]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_closure_of_a_cycle_is_an_error(spark):
    with pytest.raises(RuntimeError):
        graphs.ancestors(spark, spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "child string, parent string"), levels=8).count()


def test_the_classifier_searches_a_text_once_for_each_pattern(spark):
    texts = ["RFI No. 007\nQuestion: a?", "Subject: re: submittal – S‑9\nStatus: approved", None, "", "none"]
    df = fields.classify(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("regexp_instr(") == 2 and plan.count("response|answer|reply") == 1
    got = {r["id"]: (r["document_type"], r["workflow_type"], r["identifier"], r["role"], r["status"]) for r in df.collect()}
    assert got == {0: ("RFI_QUESTION", "RFI", "7", "QUESTION", None), 1: ("SUBMITTAL", "SUBMITTAL", "S-9", "SUBMITTAL", "APPROVED")} | dict.fromkeys((2, 3, 4), ("UNKNOWN", None, None, None, None))
    assert df.columns == ["id", "text", "workflow_type", "identifier", "role", "status", "document_type"]


def test_orders_of_one_row_group_are_read_by_many_tasks(spark):
    from locatext.plans import forms

    assert forms.forms(spark, "/root/testdata/sf0.001", spread=True).rdd.getNumPartitions() > 1


def test_variants_of_keys_of_seven_digits_and_more(spark, tmp_path):
    keys = [0, 7, 99999, 100000, 999999, 1000003, 8999999, 12345678901, 100000, 1000003, -5, -123456, None]
    got = same_as_sql(spark, tmp_path, "rfi_variants", "orders", [(k,) for k in keys], "o_orderkey long")
    assert len(got) == 9 and (1000003, "rfi 100000", "rfi 1000003") in [r[:3] for r in got]


def test_islands_of_fractions_and_nulls(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([1, 2, None]), rnd.randrange(40) / 2, rnd.choice([7, 8, None])) for _ in range(400)]
    rows += [(9, 1, 5.0, 2), (9, 1, 5.0, None), (10, 1, 5.0, 2), (10, 1, 6.5, 2), (10, 1, 7.5, 2)]
    same_as_sql(spark, tmp_path, "interval_merge", "lineitem", rows, "l_suppkey long, l_linenumber int, l_quantity double, l_partkey long")


def test_islands_of_rows_that_tie_do_not_overlap(spark):
    from locatext.operators import fragments

    rnd = random.Random(10)
    rows = [(k, s, s + 1 + rnd.randrange(2)) for k in range(40) for s in (rnd.randrange(60) for _ in range(80))]
    want = []
    for k, s, e in sorted(rows):
        if want and want[-1][0] == k and s <= want[-1][2]:
            want[-1][2:] = [max(e, want[-1][2]), want[-1][3] + 1]
        else:
            want.append([k, s, e, 1])
    got = fragments.merge_intervals(spark.createDataFrame(rows, "k long, a long, b long"), "k", "a", "b")
    assert sorted(map(list, got.collect())) == want
