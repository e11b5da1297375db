"""Tree and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.operators import graphs as G
from locatext.registry import query
from locatext.session import table

_TREE = "e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT node, parent, depth + 1 FROM up JOIN e ON up.ancestor = e.child) SELECT * FROM up")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    edge = lambda df, p, x, q, y: df.select(F.concat(F.lit(p), x).alias("child"), F.concat(F.lit(q), y).alias("parent"))
    edges = edge(c, "c", "c_custkey", "n", "c_nationkey").unionByName(edge(n, "n", "n_nationkey", "r", "n_regionkey")).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent")))
    return G.ancestors(spark, edges)


@query("""WITH RECURSIVE t AS (SELECT 'u' || user_id AS u, 'k' || json_extract_string(props, '$.k') || event_type AS k FROM events WHERE event_id % 23 = 0), ed AS (SELECT DISTINCT a.u AS a, b.u AS b FROM t a JOIN t b ON a.k = b.k),
reach AS (SELECT a, b FROM ed UNION SELECT r.a, ed.b FROM reach r JOIN ed ON r.b = ed.a) SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def thread_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the events that the SQL names (one in 23); ``thread_components_all`` reads every event."""
    return _threads(table(spark, sf_dir, "events").where("event_id % 23 = 0 AND get_json_object(props, '$.k') || event_type IS NOT NULL"))


@query()
def thread_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads over all events. It has no SQL: the recursion pairs every two users of a key."""
    return _threads(table(spark, sf_dir, "events"))


def _threads(events: DataFrame) -> DataFrame:
    """Users that share a message key are one thread; a user without any key is one alone."""
    user = F.concat(F.lit("u"), "user_id")
    key = F.concat(F.lit("~k"), F.get_json_object("props", "$.k"), "event_type")
    keys = events.where("user_id IS NOT NULL").select(user.alias("u"), F.coalesce(key, F.concat(F.lit("~"), user)).alias("k"))
    return G.components(keys.distinct(), "u", "k").where("NOT startswith(node, '~')")


@query("SELECT conv_id, count(*) AS messages, count(*) - count(DISTINCT sha256(text)) AS duplicates, count(*) FILTER (WHERE turn = 0) AS roots, CASE WHEN count(*) = 1 THEN 'SINGLE' WHEN count(*) <> count(DISTINCT sha256(text)) OR count(*) FILTER (WHERE turn = 0) <> 1 THEN 'AMBIGUOUS' ELSE 'LINKED' END AS state FROM conversations GROUP BY conv_id")
def thread_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d, roots = F.count("*"), F.countDistinct(F.sha2("text", 256)), F.count_if(F.col("turn") == 0)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n.alias("messages"), (n - d).alias("duplicates"), roots.alias("roots"), F.when(n == 1, "SINGLE").when((n != d) | (roots != 1), "AMBIGUOUS").otherwise("LINKED").alias("state"))


@query("""WITH p AS (SELECT source AS path, '' AS parent, 1 AS depth, doc_id FROM documents UNION ALL SELECT source || ' > ' || lang, source, 2, doc_id FROM documents), n AS (SELECT path, parent, depth, min(doc_id) AS first_seq FROM p GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY parent ORDER BY first_seq) AS ordinal FROM n""")
def scope_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.scope_nodes(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")


@query("SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'F') AS is_source_text, min(o_orderkey) AS first_key FROM orders GROUP BY ALL")
def identifier_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("is_source_text"), F.min("o_orderkey").alias("first_key"))


@query("SELECT l_orderkey AS parent, l_partkey AS child, l_linenumber AS idx, count(*) AS import_count FROM lineitem GROUP BY ALL")
def attachment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"), F.col("l_linenumber").alias("idx")).agg(F.count("*").alias("import_count"))


@query("WITH m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R') SELECT l.l_orderkey, count(*) AS block_rows, max(l_linenumber) AS last_row FROM lineitem l JOIN m USING (l_orderkey) GROUP BY l.l_orderkey")
def table_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matched row brings the whole block (order) it stands in."""
    lines = table(spark, sf_dir, "lineitem")
    matched = lines.where("l_quantity = 50 AND l_returnflag = 'R'").select("l_orderkey").distinct()
    return lines.join(matched, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("block_rows"), F.max("l_linenumber").alias("last_row"))


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), '>' ORDER BY turn) AS order_of_turns FROM conversations GROUP BY conv_id")
def thread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topological order of reply chains (each turn answers the one before)."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")), ">").alias("order_of_turns"))
