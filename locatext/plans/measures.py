"""Aggregation queries: coverage, metrics, workflow groups, scorecards, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.functions import lexing as L
from locatext.operators import measures as M
from locatext.registry import EV, evidence, query
from locatext.session import table


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE n_chars < 100) AS short, count(DISTINCT source) AS sources, count(*) FILTER (WHERE lang = 'en') AS english, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS evidence FROM documents")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") < 100).alias("short"), F.countDistinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"), F.sum("n_chars").alias("chars"), F.sum(F.size(F.split("text", "\n"))).alias("evidence"))


@query("SELECT user_id, event_type, count(*) AS samples, round(sum(value), 4) AS total, round(max(value), 4) AS top, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def metric_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metric_totals(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value")


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value IS NULL) AS unknown, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS units FROM events GROUP BY event_type")
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value").isNull()).alias("unknown"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("units"))


_GROUPS = """m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'QUESTION' WHEN 'assistant' THEN 'RESPONSE' ELSE 'UNKNOWN' END AS role FROM conversations),
g AS (SELECT conv_id, count(*) AS members, count(*) FILTER (WHERE role = 'QUESTION') AS questions, count(*) FILTER (WHERE role = 'RESPONSE') AS responses, string_agg(DISTINCT role, ' / ' ORDER BY role) AS roles FROM m GROUP BY conv_id),
s AS (SELECT *, CASE WHEN questions > 1 OR responses > 1 THEN 'AMBIGUOUS' WHEN questions > 0 AND responses > 0 THEN 'LINKED' ELSE 'OPEN' END AS state FROM g)"""


@query(f"WITH {_GROUPS} SELECT conv_id, members, questions, responses, roles FROM s")
def workflow_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.workflow_groups(table(spark, sf_dir, "conversations"))


@query(f"WITH {_GROUPS} SELECT conv_id, state FROM s")
def workflow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.workflow_groups(table(spark, sf_dir, "conversations")).select("conv_id", M.workflow_state(F.col("questions"), F.col("responses")).alias("state"))


@query(f"WITH {_GROUPS} SELECT state, count(*) AS groups, CAST(sum(members) AS BIGINT) AS members FROM s GROUP BY state")
def workflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = M.workflow_groups(table(spark, sf_dir, "conversations")).withColumn("state", M.workflow_state(F.col("questions"), F.col("responses")))
    return groups.groupBy("state").agg(F.count("*").alias("groups"), F.sum("members").alias("members"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping_id(o_orderpriority, o_orderstatus) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def workflow_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: grouping sets over the summary."""
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(f"WITH {EV} SELECT doc_id, count(*) AS n_rows, min(ord) AS first_row, max(ord) AS last_row, count(DISTINCT raw_text) AS texts, CAST(sum(strlen(raw_text)) AS BIGINT) AS bytes FROM ev GROUP BY doc_id")
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.min("ord").alias("first_row"), F.max("ord").alias("last_row"), F.countDistinct("raw_text").alias("texts"), F.sum(F.octet_length("raw_text")).alias("bytes"))


@query("SELECT p_brand, p_type, count(*) AS parts, count(DISTINCT p_size) AS sizes, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END AS size FROM part GROUP BY ALL")
def material_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("parts"), F.countDistinct("p_size").alias("sizes"), F.when(F.countDistinct("p_size") == 1, F.min("p_size")).alias("size"))


@query("WITH p AS (SELECT l_orderkey, l_returnflag AS name, count(DISTINCT l_linestatus) AS values, min(l_linestatus) AS one FROM lineitem GROUP BY ALL) SELECT l_orderkey, name, CASE WHEN values = 1 THEN one END AS value, values > 1 AS conflict FROM p")
def property_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("name")).agg(F.collect_set("l_linestatus").alias("v"))
    return grouped.select("l_orderkey", "name", L.only_value(F.col("v")).alias("value"), (F.size("v") > 1).alias("conflict"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber)), 3) AS length, round(sum(abs(l_quantity) * l_linenumber), 3) AS area FROM lineitem GROUP BY ALL")
def layer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and area totals of drawing entities per layer."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.hypot("l_quantity", F.col("l_linenumber").cast("double"))), 3).alias("length"), F.round(F.sum(F.abs("l_quantity") * F.col("l_linenumber")), 3).alias("area"))


@query("WITH i AS (SELECT l_partkey, l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL) SELECT l_partkey, CASE WHEN bool_or(lo <> hi) THEN 'CONFLICT' ELSE 'OK' END AS status, CASE WHEN NOT bool_or(lo <> hi) THEN round(sum(lo), 2) END AS total FROM i GROUP BY l_partkey")
def instance_dedup_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.instance_sum(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_tax) = 1 THEN min(l_tax) END AS quantity, CASE WHEN count(DISTINCT l_tax) = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status FROM lineitem GROUP BY l_orderkey")
def quantity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.countDistinct("l_tax") == 1
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(one, F.min("l_tax")).alias("quantity"), F.when(one, "RESOLVED").otherwise("UNRESOLVED").alias("status"))


@query("WITH s AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT CASE WHEN k = 1 THEN 'SUPPORTED' ELSE 'AMBIGUOUS' END AS status, count(*) AS identifiers, CAST(sum(n) AS BIGINT) AS orders FROM s GROUP BY ALL")
def status_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("k"), F.count("*").alias("n"))
    return per.groupBy(F.when(F.col("k") == 1, "SUPPORTED").otherwise("AMBIGUOUS").alias("status")).agg(F.count("*").alias("identifiers"), F.sum("n").alias("orders"))


@query("WITH d AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS k FROM d) SELECT o_orderpriority, count(*) AS identifiers, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY o_custkey) FILTER (WHERE k <= 50) AS listed FROM n GROUP BY o_orderpriority")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of distinct identifiers, and the first 50 of each (the report's limit)."""
    from pyspark.sql import Window as W

    distinct = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey").distinct()
    counts = distinct.groupBy("o_orderpriority").agg(F.count("*").alias("identifiers"))
    listed = distinct.withColumn("k", F.row_number().over(W.partitionBy("o_orderpriority").orderBy("o_custkey"))).where("k <= 50")
    listed = listed.groupBy("o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_custkey")), lambda x: x.cast("string")), ",").alias("listed"))
    return counts.join(listed, "o_orderpriority")


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles (exact)."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("WITH v AS (SELECT user_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events) SELECT user_id, count(k) AS observed, count(*) FILTER (WHERE k IS NULL) AS unknown, count(*) FILTER (WHERE k = 0) AS known_zero, CASE WHEN count(*) = count(k) THEN CAST(sum(k) AS BIGINT) END AS total FROM v GROUP BY user_id")
def observed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 13 != 0, F.get_json_object("props", "$.k").cast("long")).alias("k"))
    return M.observed(rows, ["user_id"], "k")


@query("SELECT event_type AS mode, stage, count(*) AS n, round(sum(sec), 4) AS seconds FROM (SELECT event_type, 'parse' AS stage, value AS sec FROM events UNION ALL SELECT event_type, 'rank', value * 0.25 FROM events WHERE event_id % 2 = 0) GROUP BY ALL")
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.map_filter(F.create_map(F.lit("parse"), F.col("value"), F.lit("rank"), F.when(F.col("event_id") % 2 == 0, F.col("value") * 0.25)), lambda k, v: (k == "parse") | (F.col("event_id") % 2 == 0))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.explode(stages).alias("stage", "sec"))
    return rows.groupBy("mode", "stage").agg(F.count("*").alias("n"), F.round(F.sum("sec"), 4).alias("seconds"))


_CARD = "c AS (SELECT source, count(*) AS items, count(l.doc_id) AS reviewed, count(*) FILTER (WHERE quality = 1) AS usable, count(*) FILTER (WHERE toxic = 1) AS unsupported FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)"


@query(f"WITH {_CARD} SELECT source, items, reviewed, usable, unsupported, CASE WHEN items < 15 THEN 'NOT_APPLICABLE' WHEN reviewed < 15 THEN 'INCOMPLETE_ADJUDICATION' WHEN usable >= 12 AND unsupported = 0 THEN 'THRESHOLDS_MET' ELSE 'THRESHOLDS_NOT_MET' END AS gate FROM c")
def scorecard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    card = joined.groupBy("source").agg(F.count("*").alias("items"), F.count("seen").alias("reviewed"), F.count_if(F.col("quality") == 1).alias("usable"), F.count_if(F.col("toxic") == 1).alias("unsupported"))
    gate = F.when(F.col("items") < 15, "NOT_APPLICABLE").when(F.col("reviewed") < 15, "INCOMPLETE_ADJUDICATION").when((F.col("usable") >= 12) & (F.col("unsupported") == 0), "THRESHOLDS_MET").otherwise("THRESHOLDS_NOT_MET")
    return card.withColumn("gate", gate)


@query(f"WITH {_CARD} SELECT source, CASE WHEN reviewed = 0 THEN 'READY' WHEN reviewed < items THEN 'IN_PROGRESS' ELSE 'COMPLETE' END AS status, CASE WHEN reviewed > 0 THEN round(usable / reviewed, 6) END AS rate FROM c")
def evaluation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = scorecard_gate(spark, sf_dir)
    status = F.when(F.col("reviewed") == 0, "READY").when(F.col("reviewed") < F.col("items"), "IN_PROGRESS").otherwise("COMPLETE")
    return card.select("source", status.alias("status"), F.round(L.safe_rate(F.col("usable"), F.col("reviewed")), 6).alias("rate"))


@query("SELECT count(*) AS refs, count(DISTINCT l_partkey) AS pages, count(DISTINCT l_suppkey) AS documents, count(*) - count(DISTINCT l_partkey) AS repeats, count(*) FILTER (WHERE l_tax = 0) AS warnings FROM lineitem")
def readiness_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("refs"), F.countDistinct("l_partkey").alias("pages"), F.countDistinct("l_suppkey").alias("documents"), (F.count("*") - F.countDistinct("l_partkey")).alias("repeats"), F.count_if(F.col("l_tax") == 0).alias("warnings"))


@query("""WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'UNSUPPORTED' WHEN 'A' THEN 'SUPPORTED' ELSE CASE WHEN l_linestatus = 'O' THEN 'NON_DOCUMENT' ELSE 'PENDING' END END AS st FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(st = 'CONTRADICTED') THEN 'CONTRADICTED' WHEN bool_or(st = 'UNSUPPORTED') THEN 'UNSUPPORTED' WHEN bool_and(st IN ('SUPPORTED', 'NON_DOCUMENT')) AND bool_or(st = 'SUPPORTED') THEN 'SUPPORTED' WHEN bool_or(st = 'SUPPORTED') THEN 'PARTIAL' WHEN bool_and(st = 'NON_DOCUMENT') THEN 'NON_DOCUMENT' ELSE 'PENDING' END AS state FROM s GROUP BY l_orderkey""")
def verification_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.when(F.col("l_returnflag") == "R", "UNSUPPORTED").when(F.col("l_returnflag") == "A", "SUPPORTED").when(F.col("l_linestatus") == "O", "NON_DOCUMENT").otherwise("PENDING")
    return M.verification_rollup(table(spark, sf_dir, "lineitem").select("l_orderkey", st.alias("state")), "l_orderkey", "state")


@query(f"WITH {EV}, c AS (SELECT file_name, family, raw_text, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS ords FROM (SELECT DISTINCT file_name, family, raw_text, doc_id, ord FROM ev) GROUP BY ALL) SELECT file_name, family, sha256(raw_text) AS content, docs, first_doc, ords FROM c WHERE docs > 1")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).select("file_name", "family", "raw_text", "doc_id", "ord").distinct()
    merged = rows.groupBy("file_name", "family", "raw_text").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"), F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("ords"))
    return merged.where("docs > 1").select("file_name", "family", F.sha2("raw_text", 256).alias("content"), "docs", "first_doc", "ords")


@query("SELECT o_orderstatus, CAST(round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS DOUBLE) AS progress FROM orders GROUP BY o_orderstatus")
def progress_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(orders.agg(F.count("*").alias("all")))).select("o_orderstatus", F.round(100 * F.col("n") / F.col("all"), 4).alias("progress"))


@query("SELECT c_mktsegment, CAST(coalesce(round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 2), 0) AS DOUBLE) AS capacity FROM customer GROUP BY c_mktsegment")
def capacity_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.coalesce(F.round(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 2), F.lit(0.0)).alias("capacity"))


@query("""SELECT * FROM (SELECT 'line without order' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'negative price', count(*) FROM lineitem WHERE l_extendedprice < 0
UNION ALL SELECT 'long text', count(*) FROM documents WHERE n_chars > 20000 UNION ALL SELECT 'repeated line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) WHERE n > 0""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locatext.operators.relations import orphans

    lines, docs, orders, labels = (table(spark, sf_dir, t) for t in ("lineitem", "documents", "orders", "labels"))
    rules = {
        "line without order": orphans(lines.select("l_orderkey"), orders, "l_orderkey", "o_orderkey"),
        "label without document": orphans(labels.select("doc_id"), docs, "doc_id", "doc_id"),
        "negative price": lines.where("l_extendedprice < 0"),
        "long text": docs.where("n_chars > 20000"),
        "repeated line": lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
    }
    return M.failed_rules(rules)


@query("SELECT count(*) AS primitives, round(sum(sqrt(power(l_quantity, 2) + power(l_linenumber, 2))), 3) AS length, round(sum(abs(l_quantity * l_linenumber)), 3) AS area, round(sum(sqrt(power(l_quantity, 2) + power(l_linenumber, 2))) * 0.125, 3) AS calibrated FROM lineitem")
def geometry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.sum(F.hypot("l_quantity", F.col("l_linenumber").cast("double")))
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("primitives"), F.round(length, 3).alias("length"), F.round(F.sum(F.abs(F.col("l_quantity") * F.col("l_linenumber"))), 3).alias("area"), F.round(length * 0.125, 3).alias("calibrated"))


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.0 END), 6) AS good_rate, count(quality) AS judged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.round(L.safe_rate(F.count_if(F.col("quality") == 1), F.count("quality")), 6).alias("good_rate"), F.count("quality").alias("judged"))
