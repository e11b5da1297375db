import hashlib

import pytest
from pyspark.sql import functions as F

from locatext.llm import exact_dedup

U = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(str.maketrans(U, U.lower())), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"capacity": 2, "max_depth": 4}, {"key": lambda n: F.pmod(F.xxhash64(n), F.lit(3)), "capacity": 1, "max_depth": 3}, {"key": lambda n: F.lit(-5).cast("long")}])
def test_against_a_plain_loop(spark, options):
    rows = [(i, f"Text {i % 7}") for i in range(40)] + [(100, None), (101, ""), (102, "É"), (103, "é"), (104, "ÀBC"), (105, "Àbc"), (None, "Text 1"), (None, "lonely"), (7, "Text 0"), (7, "Text 0"), (200, "x" * 100_000), (201, "X" * 100_000)]
    docs = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, key string").withColumn("norm", F.lit(1)).withColumn("sha", F.lit(2))
    assert sorted((tuple(r) for r in exact_dedup.mark(docs, **options).collect()), key=str) == plain(rows)


def test_empty_table(spark):
    assert exact_dedup.mark(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "A", "en"), (2, "a", None), (3, None, "x")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, exact_dedup.keep_largest_id(docs).collect())) == [(2, "a", None), (3, None, "x")]


def test_directory_splits_only_overfull_buckets():
    leaves = exact_dedup.directory({0: 5, 1: 5, 2: 1, 15: 2}, 5, 4)
    assert leaves == [(4, 0), (4, 1), (3, 1), (2, 1), (1, 1)]
    assert exact_dedup.directory({}, 5, 4) == [(0, 0)]


def test_buckets_split_until_they_fit_and_rows_read_their_own(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"))
    entries = docs.groupBy(F.xxhash64("text").alias("key"), "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).select("key", F.unhex(F.sha2("text", 256)).alias("sha"), "n", "keep_id")
    index, levels, path = exact_dedup.build_index(entries, capacity=10, max_depth=3)
    rows = index.collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["bucket"], set()).add(r["key"] & (1 << 64) - 1)
    assert len(rows) == 500 and len(levels) > 1 and max(map(len, sizes.values())) <= 10
    # A bucket is a range of keys: no other bucket's key lies within.
    ranges = sorted((min(k), max(k)) for k in sizes.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    # A row's bucket holds its entry, and its folder holds nothing else.
    for r in exact_dedup.in_buckets(docs.limit(40).select(F.xxhash64("text").alias("key")), levels).collect():
        folder = {x["key"] & (1 << 64) - 1 for x in spark.read.parquet(f"{path}/bucket={r['bucket']}").collect()}
        assert folder == sizes[r["bucket"]] and r["key"] & (1 << 64) - 1 in folder


def test_entries_with_many_rows_are_broadcast(spark):
    rows = [(i, "HOT" if i % 3 else f"t{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in exact_dedup.mark(docs, hot_rows=5).collect()), key=str) == plain(rows)
