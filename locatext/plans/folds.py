"""Ordered folds: packers under item and byte budgets. The SQL forms walk the rows by
recursion, one step a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.functions.vocab import LIMITS
from locatext.operators import fragments as G
from locatext.registry import EV, evidence, query
from locatext.session import table

_BYTES = "r AS (SELECT doc_id, ord, CAST(strlen(raw_text) AS BIGINT) AS size FROM ev)"


@query(f"WITH {EV}, {_BYTES}, c AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS upto FROM r) SELECT doc_id, ord, CAST(least(size, 2000 - (upto - size)) AS BIGINT) AS taken FROM c WHERE upto - size < 2000")
def pack_prefix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix packing: rows in order until the budget, the last one clipped."""
    from pyspark.sql import Window as W

    rows = evidence(spark, sf_dir).select("doc_id", "ord", F.octet_length("raw_text").cast("long").alias("size"))
    upto = F.sum("size").over(W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    room = 2000 - (F.col("upto") - F.col("size"))
    return rows.withColumn("upto", upto).where(room > 0).select("doc_id", "ord", F.least("size", room).alias("taken"))


_FOLD = """n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM r)"""


@query(f"""WITH RECURSIVE {EV}, {_BYTES}, {_FOLD},
f AS (SELECT doc_id, i, ord, size AS used, CAST(1 AS BIGINT) AS n, true AS kept FROM n WHERE i = 1
 UNION ALL SELECT n.doc_id, n.i, n.ord, CASE WHEN f.used + n.size <= 1500 AND f.n < 8 THEN f.used + n.size ELSE f.used END, CASE WHEN f.used + n.size <= 1500 AND f.n < 8 THEN f.n + 1 ELSE f.n END, f.used + n.size <= 1500 AND f.n < 8 FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT doc_id, ord FROM f WHERE kept""")
def pack_skip_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).select("doc_id", "ord", F.octet_length("raw_text").alias("size"))
    return G.pack_skip(rows, "doc_id", ["ord"], "size", 1500, LIMITS["results"])


@query(f"""WITH RECURSIVE {EV}, {_BYTES}, {_FOLD},
f AS (SELECT doc_id, i, ord, size AS used, 1 AS n, 1 AS batch FROM n WHERE i = 1
 UNION ALL SELECT n.doc_id, n.i, n.ord, CASE WHEN f.used + n.size > 8800 OR f.n >= 4 THEN n.size ELSE f.used + n.size END, CASE WHEN f.used + n.size > 8800 OR f.n >= 4 THEN 1 ELSE f.n + 1 END, CASE WHEN f.used + n.size > 8800 OR f.n >= 4 THEN f.batch + 1 ELSE f.batch END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT doc_id, ord, batch FROM f""")
def batch_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).select("doc_id", "ord", F.octet_length("raw_text").alias("size"))
    return G.pack_runs(rows, "doc_id", "ord", "size", LIMITS["batch_bytes"], LIMITS["batch_items"])


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT doc_id, ord, CAST(length(raw_text) + 1 AS BIGINT) AS size FROM ev), {_FOLD},
f AS (SELECT doc_id, i, ord, size AS used, 1 AS batch FROM n WHERE i = 1
 UNION ALL SELECT n.doc_id, n.i, n.ord, CASE WHEN f.used + n.size > 1600 THEN n.size ELSE f.used + n.size END, CASE WHEN f.used + n.size > 1600 THEN f.batch + 1 ELSE f.batch END FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT doc_id, batch, min(ord) AS first_line, max(ord) AS last_line FROM f GROUP BY ALL""")
def pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line packer: fragments of at most 1,600 characters with their line range."""
    rows = evidence(spark, sf_dir).select("doc_id", "ord", (F.length("raw_text") + 1).alias("size"))
    packed = G.pack_runs(rows, "doc_id", "ord", "size", LIMITS["fragment_chars"], 1 << 30)
    return packed.groupBy("doc_id", "batch").agg(F.min("ord").alias("first_line"), F.max("ord").alias("last_line"))


@query("WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS ids FROM lineitem GROUP BY l_orderkey), n AS (SELECT array_to_string(ids, ',') AS ids, l_orderkey, (row_number() OVER (PARTITION BY ids ORDER BY l_orderkey) - 1) // 4 AS batch FROM s) SELECT ids, batch, count(*) AS n, min(l_orderkey) AS first_key FROM n GROUP BY ALL")
def verify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fours of records with the same evidence set. A set may be hot: its rows are
    numbered within ranges of the key that are counted first, not in one window."""
    from locatext.operators.records import numbered

    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("ids"))
    rows = numbered(sets, "ids", "l_orderkey", 1 << 12)
    return rows.groupBy("ids", F.floor((F.col("n") - 1) / 4).alias("batch")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))
