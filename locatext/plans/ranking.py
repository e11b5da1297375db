"""Window, order and limit queries; per-document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locatext.operators import fragments as G
from locatext.registry import EV, evidence, query
from locatext.session import table


@query(f"WITH {EV}, c AS (SELECT doc_id, ord, CASE WHEN regexp_matches(raw_text, '^[A-Z][a-z]+ [a-z]+ ') THEN left(raw_text, 8) END AS head FROM ev) SELECT doc_id, ord, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS context FROM c")
def carry_forward_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).withColumn("head", F.when(F.col("raw_text").rlike("^[A-Z][a-z]+ [a-z]+ "), F.substring("raw_text", 1, 8)))
    return G.carry_forward(rows, "doc_id", "ord", "head", "context").select("doc_id", "ord", "context")


@query(f"WITH {EV}, c AS (SELECT doc_id, ord, sum(CASE WHEN starts_with(raw_text, 'T') OR starts_with(raw_text, 'D') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS g FROM ev) SELECT doc_id, CAST(g AS BIGINT) AS group_no, count(*) AS lines, min(ord) AS first_ord FROM c GROUP BY ALL")
def boundary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.col("raw_text").startswith("T") | F.col("raw_text").startswith("D")
    return G.boundary_groups(evidence(spark, sf_dir), "doc_id", "ord", starts).groupBy("doc_id", "group_no").agg(F.count("*").alias("lines"), F.min("ord").alias("first_ord"))


@query(f"WITH {EV}, h AS (SELECT doc_id, ord, max(CASE WHEN contains(raw_text, '@') OR starts_with(raw_text, '>') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS q FROM ev) SELECT doc_id, count(*) FILTER (WHERE q = 0) AS body, count(*) FILTER (WHERE q = 1) AS history FROM h GROUP BY doc_id")
def quoted_history_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.col("raw_text").contains("@") | F.col("raw_text").startswith(">")
    parts = G.split_history(evidence(spark, sf_dir), "doc_id", "ord", starts)
    return parts.groupBy("doc_id").agg(F.count_if(F.col("part") == "BODY").alias("body"), F.count_if(F.col("part") == "HISTORY").alias("history"))


_IV = "i AS (SELECT l_suppkey AS k, l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS s, l_linenumber * 100 + CAST(l_quantity AS BIGINT) + 1 + l_partkey % 2 AS e FROM lineitem)"


@query(f"WITH {_IV}, f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i), g AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM f) SELECT k, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY k, no")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rounded half to even, as the SQL's cast does; Spark's cuts the fraction off.
    start = F.col("l_linenumber") * 100 + F.rint("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), start.alias("a"), (start + 1 + F.col("l_partkey") % 2).alias("b"))
    return G.merge_intervals(rows, "k", "a", "b")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    top = done.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("t"))
    return top.select("o_custkey", "t.o_orderkey", "t.o_orderdate")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, 250 AS next_offset FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 200")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    page = orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(200).limit(50)
    return page.join(F.broadcast(orders.agg(F.count("*").alias("total")))).withColumn("next_offset", F.lit(250))


@query("SELECT o_orderpriority, min_by(o_orderkey, o_orderkey + epoch(o_orderdate) * 1000000) AS head FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return waiting.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("head"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n, CASE WHEN n > 15 THEN 'REFUSED' ELSE 'SCANNED' END AS outcome FROM c")
def capped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.withColumn("outcome", F.when(F.col("n") > 15, "REFUSED").otherwise("SCANNED"))


@query("WITH w AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR ts - before > INTERVAL 1 DAY) AS runs FROM w GROUP BY user_id")
def adjacency_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rows that follow each other closely (lag and a gap test)."""
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", before.alias("before"))
    fresh = F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("INTERVAL 1 DAY"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(fresh).alias("runs"))


@query("SELECT doc_id, CAST(u.pos AS INTEGER) - 1 AS pos, substr(text, (CAST(u.pos AS INTEGER) - 1) * 1600 + 1, 1600) AS piece FROM documents, unnest(range(CAST(greatest(1, ceil(length(text) / 1600.0)) AS BIGINT))) WITH ORDINALITY AS u(i, pos)")
def text_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(G.split_text(F.col("text"), 1600)).alias("pos", "piece"))


@query(f"WITH {EV}, t AS (SELECT doc_id, (ord - 1) // 6 AS tab, len(list_filter(string_split(raw_text, ' '), lambda x: x <> '')) AS cells, length(raw_text) AS chars FROM ev) SELECT doc_id, tab, count(*) AS n_rows, count(*) >= 2 AND count(*) FILTER (WHERE cells >= 2) >= 2 AND sum(cells) >= 4 AND sum(chars) >= 20 AS usable FROM t GROUP BY ALL")
def table_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.size(F.filter(F.split("raw_text", " "), lambda x: x != ""))
    rows = evidence(spark, sf_dir).select("doc_id", F.floor((F.col("ord") - 1) / 6).alias("tab"), cells.alias("cells"), F.length("raw_text").alias("chars"))
    usable = (F.count("*") >= 2) & (F.count_if(F.col("cells") >= 2) >= 2) & (F.sum("cells") >= 4) & (F.sum("chars") >= 20)
    return rows.groupBy("doc_id", "tab").agg(F.count("*").alias("n_rows"), usable.alias("usable"))


@query(f"WITH {EV} SELECT doc_id, ord, CASE WHEN contains(raw_text, '@') THEN 'EMAIL_HEADER' WHEN contains(raw_text, 'License') THEN 'EMAIL_SIGNATURE' WHEN length(raw_text) < 12 THEN 'TOO_SHORT' END AS reason FROM ev WHERE contains(raw_text, '@') OR contains(raw_text, 'License') OR length(raw_text) < 12")
def skip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("raw_text")
    reason = F.when(t.contains("@"), "EMAIL_HEADER").when(t.contains("License"), "EMAIL_SIGNATURE").when(F.length(t) < 12, "TOO_SHORT")
    return evidence(spark, sf_dir).select("doc_id", "ord", reason.alias("reason")).where(F.col("reason").isNotNull())


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey")
def rect_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


_SCALE = "s AS (SELECT p_partkey, (['SCALE: 1:' || (p_size * 5), 'scale 1:50 and 1:100', 'NTS', 'no scale here'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS said FROM part)"


@query(f"WITH {_SCALE} SELECT p_partkey, CASE WHEN contains(said, 'NTS') THEN NULL WHEN len(list_distinct(regexp_extract_all(said, '1:([0-9]+)', 1))) = 1 THEN CAST(regexp_extract(said, '1:([0-9]+)', 1) AS INTEGER) END AS ratio FROM s")
def scale_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.concat(F.lit("SCALE: 1:"), (F.col("p_size") * 5).cast("string")), F.lit("scale 1:50 and 1:100"), F.lit("NTS"), F.lit("no scale here")), (F.col("p_partkey") % 4 + 1).cast("int"))
    found = F.array_distinct(F.regexp_extract_all("said", F.lit("1:([0-9]+)"), F.lit(1)))
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said")).select("p_partkey", F.when(~F.col("said").contains("NTS") & (F.size(found) == 1), F.get(found, F.lit(0)).cast("int")).alias("ratio"))
