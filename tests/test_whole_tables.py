"""Queries that answer for every row of their table, on small fixtures."""

import random

import duckdb
from locatext import catalog


def test_threads_over_all_events_against_union_find(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(60), rnd.choice(["view", "click"]), f'{{"k": {rnd.randrange(70)}}}') for i in range(1, 80)] + [(80, 900, "view", "{}")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, user, kind, props in rows:
        parent[find(f"u{user}")] = find((kind, props) if "k" in props else f"u{user}")
    want = {}
    for user in {f"u{r[1]}" for r in rows}:
        want.setdefault(find(user), []).append(user)
    got = {r["node"]: r["component"] for r in catalog.QUERIES["thread_components_all"](spark, str(tmp_path)).collect()}
    assert got == {u: min(users) for users in want.values() for u in users}


def test_variants_of_all_orders(spark, tmp_path):
    keys = [0, 7, 1499, 99999, 100000, 149999, 1234567]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, catalog.QUERIES["rfi_variants_all"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.ORACLE_SQL["rfi_variants_all"]).fetchall()) and len(got) == len(keys)
    assert got[-1][:3] == (1234567, "rfi 1234567", "rfi 01234567")
