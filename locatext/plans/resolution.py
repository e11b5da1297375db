"""Resolution, comparison, ledger and verification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.operators import records as C
from locatext.operators import resolution as X
from locatext.registry import EV, evidence, query
from locatext.session import table


@query("""WITH d AS (SELECT o_custkey, o_orderdate, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS k FROM d)
SELECT o_custkey, CASE WHEN lo = hi THEN 'LATEST_APPLIED' ELSE 'UNRESOLVED' END AS status, CASE WHEN lo = hi THEN lo END AS value, o_orderdate AS newest, n AS claims FROM t WHERE k = 1""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest_revision(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderstatus")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) > 1 AS label_conflict, count(DISTINCT o_orderdate) > 1 AS date_conflict FROM orders GROUP BY o_custkey")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.countDistinct("o_orderpriority") > 1).alias("label_conflict"), (F.countDistinct("o_orderdate") > 1).alias("date_conflict"))


@query("""WITH f AS (SELECT o_custkey AS k, o_orderpriority AS lineage, max(o_orderdate) AS newest, count(*) AS n, count(*) FILTER (WHERE o_orderdate IS NULL) AS undated FROM orders GROUP BY ALL), j AS (SELECT o.o_orderkey, f.n, f.undated, f.newest, o.o_orderdate, count(*) OVER (PARTITION BY k, lineage, o.o_orderdate) AS ties FROM orders o JOIN f ON o_custkey = k AND o_orderpriority = lineage)
SELECT o_orderkey, CASE WHEN n = 1 THEN 'ONLY_VERSION' WHEN undated > 0 THEN 'AMBIGUOUS' WHEN o_orderdate < newest THEN 'SUPERSEDED' WHEN ties > 1 THEN 'DUPLICATE_NEWEST' ELSE 'NEWEST' END AS reason FROM j""")
def effective_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which version of each lineage counts, and why."""
    return X.effective(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate").select("o_orderkey", "reason")


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name || ' Rev ' || (s_suppkey % 9) || ' 2024-01-0' || (s_suppkey % 9 + 1)), 'rev [0-9]+', '', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', '', 'g')) AS lineage FROM supplier")
def lineage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("s_name", F.lit(" Rev "), F.col("s_suppkey") % 9, F.lit(" 2024-01-0"), F.col("s_suppkey") % 9 + 1)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "rev [0-9]+", ""), "[0-9]{4}-[0-9]{2}-[0-9]{2}", "")).alias("lineage"))


@query("""WITH g AS (SELECT o_custkey AS k, sha256(string_agg(o_orderstatus, '' ORDER BY o_orderstatus)) AS h FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY k), e AS (SELECT o_custkey AS k, sha256(string_agg(o_orderstatus, '' ORDER BY o_orderstatus)) AS h, 1 AS version FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY k),
a AS (SELECT coalesce(g.k, e.k) AS k, CASE WHEN e.h IS NULL THEN 'INSERT' WHEN g.h IS NULL THEN 'BLOCK' WHEN g.h = e.h THEN 'KEEP' ELSE 'UPDATE' END AS action, coalesce(version, 0) AS v FROM g FULL JOIN e ON g.k = e.k)
SELECT k AS o_custkey, action, CAST(v + CASE WHEN action IN ('INSERT', 'UPDATE') THEN 1 ELSE 0 END AS INTEGER) AS version FROM a""")
def publish_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    digest = lambda df: df.groupBy("o_custkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("o_orderstatus")), ""), 256).alias("h"))
    new, old = digest(orders.where(F.year("o_orderdate") >= 1995)), digest(orders.where(F.year("o_orderdate") >= 1996)).withColumn("version", F.lit(1))
    return X.publish_actions(new, old, "o_custkey", "h")


@query("WITH s AS (SELECT user_id, max_by(event_type, event_id) AS state, count(*) AS events FROM events GROUP BY user_id) SELECT user_id, state, events FROM s")
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.state_of(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type")


@query("SELECT user_id, min(event_id) FILTER (WHERE event_type = 'purchase') AS checkpoint, min(event_id) FILTER (WHERE event_type = 'click' AND event_id > c) AS first_after FROM (SELECT *, min(event_id) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS c FROM events) GROUP BY user_id")
def generated_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint of each key and the first human event after it (one aggregation back)."""
    events = table(spark, sf_dir, "events")
    first = events.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("checkpoint"))
    after = events.join(first, "user_id").groupBy("user_id", "checkpoint").agg(F.min(F.when((F.col("event_type") == "click") & (F.col("event_id") > F.col("checkpoint")), F.col("event_id"))).alias("first_after"))
    return after.select("user_id", "checkpoint", "first_after")


@query("SELECT event_type || ':g' || (event_id % 3) AS task_key, regexp_extract(event_type || ':g' || (event_id % 3), '^([a-z]+):g[0-9]+$', 1) AS family, CAST(regexp_extract(event_type || ':g' || (event_id % 3), ':g([0-9]+)$', 1) AS INTEGER) AS generation, count(*) AS n FROM events GROUP BY ALL")
def task_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(":g"), F.col("event_id") % 3).alias("task_key"))
    return keyed.groupBy("task_key", F.regexp_extract("task_key", "^([a-z]+):g[0-9]+$", 1).alias("family"), F.regexp_extract("task_key", ":g([0-9]+)$", 1).cast("int").alias("generation")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY ALL) SELECT user_id, count(*) AS cached, count(*) FILTER (WHERE last > 5000) AS live FROM c GROUP BY user_id")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    return last.groupBy("user_id").agg(F.count("*").alias("cached"), F.count_if(F.col("last") > 5000).alias("live"))


@query("SELECT source, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS snapshot, count(*) AS n FROM documents GROUP BY source")
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"]), ",")
    return docs.groupBy("source").agg(F.sha2(ordered, 256).alias("snapshot"), F.count("*").alias("n"))


@query("SELECT * FROM (SELECT c_custkey, '/c_name' AS path, c_name AS claim FROM customer UNION ALL SELECT c_custkey, '/c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, '/c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)")
def field_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flatten(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_name", "c_mktsegment", "c_nationkey"])


@query("WITH q AS (SELECT doc_id, text, substr(text, length(text) // 2, 12) AS quote FROM documents WHERE length(text) >= 40), p AS (SELECT doc_id, quote, instr(text, quote) AS f, text FROM q) SELECT doc_id, CASE WHEN f > 0 AND instr(substr(text, f + 1), quote) = 0 THEN CAST(f - 1 AS INTEGER) END AS start FROM p")
def citation_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quotes count only where they occur once."""
    rows = table(spark, sf_dir, "documents").where("length(text) >= 40").select("doc_id", "text", F.expr("substring(text, cast(length(text) div 2 as int), 12)").alias("quote"))
    return rows.select("doc_id", C.citation(F.col("text"), F.col("quote")).alias("start"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(ceil(CAST(l_extendedprice AS DECIMAL(18, 2)) * 1000000) AS BIGINT) AS micro, CAST(l_quantity AS BIGINT) * l_linenumber AS product, CASE WHEN l_linenumber <> 0 THEN CAST(l_quantity AS BIGINT) % l_linenumber = 0 END AS exact FROM lineitem")
def decimal_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal arithmetic with an exactness test; micro-unit ceilings."""
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.ceil(F.col("l_extendedprice").cast("decimal(18,2)") * 1000000).cast("long").alias("micro"), (q * F.col("l_linenumber")).alias("product"), (q % F.col("l_linenumber") == 0).alias("exact"))


@query("SELECT p_partkey, p_size || '/8' AS fraction, p_size / 8.0 AS value, greatest(p_size - 10, 20 - p_size, 0) AS distance FROM part")
def fraction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("p_size", F.lit("/8"))
    parts = F.split(said, "/")
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("fraction"), (parts[0].cast("double") / parts[1].cast("double")).alias("value"), F.greatest(F.col("p_size") - 10, 20 - F.col("p_size"), F.lit(0)).alias("distance"))


@query("SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN 'ANSWERED' ELSE 'CONFLICT' END AS outcome, array_to_string(list_sort(list(DISTINCT lang)), ',') AS values FROM documents GROUP BY source")
def field_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field readers' plan: distinct values per target, and what they amount to."""
    grouped = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("v"))
    return grouped.select("source", X.agree(F.col("v")).alias("outcome"), F.array_join("v", ",").alias("values"))


@query(f"WITH {EV}, f AS (SELECT doc_id, regexp_extract(raw_text, 'token = \"([0-9a-fA-F]+)\"', 1) AS v FROM ev WHERE contains(raw_text, 'token = ')) SELECT doc_id, count(DISTINCT v) AS n, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value FROM f WHERE v <> '' GROUP BY doc_id")
def labelled_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Label: value`` reader: cheap containment first, then the pattern."""
    rows = evidence(spark, sf_dir).where(F.col("raw_text").contains("token = "))
    values = rows.select("doc_id", F.regexp_extract("raw_text", 'token = "([0-9a-fA-F]+)"', 1).alias("v")).where("v <> ''")
    return values.groupBy("doc_id").agg(F.countDistinct("v").alias("n"), F.when(F.countDistinct("v") == 1, F.min("v")).alias("value"))


@query("WITH r AS (SELECT o_orderkey, (['1', '2', '10', 'A', 'B', 'R2'])[CAST(o_orderkey % 6 AS INTEGER) + 1] AS label, o_custkey FROM orders), g AS (SELECT o_custkey, bool_and(regexp_full_match(label, '[0-9]+')) AS ints, bool_and(regexp_full_match(label, '[A-Z]')) AS letters, max(CASE WHEN regexp_full_match(label, '[0-9]+') THEN CAST(label AS INTEGER) END) AS top, max(label) AS last FROM r GROUP BY o_custkey) SELECT o_custkey, CASE WHEN ints THEN CAST(top AS VARCHAR) WHEN letters THEN last END AS newest FROM g")
def revision_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels compare only where all are integers or all single letters."""
    label = F.element_at(F.array(*map(F.lit, ["1", "2", "10", "A", "B", "R2"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return X.newest_label(table(spark, sf_dir, "orders").select("o_custkey", label.alias("label")), "o_custkey", "label")


@query("SELECT doc_id, sha256(source || '|' || lang || '|' || sha256(text)) AS check_key, CASE WHEN doc_id % 2 = 0 THEN 'REUSED' ELSE 'STALE' END AS verdict FROM documents")
def verification_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict is reused where the hash of all it depended on is the same."""
    docs = table(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.sha2(F.concat_ws("|", "source", "lang", F.sha2("text", 256)), 256).alias("check_key"))
    saved = docs.select("doc_id", F.sha2(F.concat(F.concat_ws("|", "source", "lang", F.sha2("text", 256)), F.when(F.col("doc_id") % 2 == 0, "").otherwise("old")), 256).alias("check_key"), F.lit(True).alias("hit"))
    return now.join(saved, ["doc_id", "check_key"], "left").select("doc_id", "check_key", F.when(F.col("hit"), "REUSED").otherwise("STALE").alias("verdict"))


@query("SELECT p_type, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(lower(p_type), '(standard|actor|document)')) AS admissible FROM part GROUP BY p_type")
def admissible_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(~F.lower("p_type").rlike("(standard|actor|document)")).alias("admissible"))


@query("WITH s AS (SELECT page_id, sha256(html) AS digest, length(html) AS chars FROM pages) SELECT digest, count(*) AS copies, min(page_id) AS first_page, any_value(chars) AS chars FROM s GROUP BY digest")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.sha2("html", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("page_id").alias("first_page"), F.any_value(F.length("html").cast("long")).alias("chars"))


@query("WITH e AS (SELECT l_orderkey, l_linenumber, sha256(l_orderkey || '|' || l_linenumber || '|' || l_returnflag) AS h, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem) SELECT l_orderkey, count(*) AS links, count(*) FILTER (WHERE before IS NOT NULL AND l_linenumber <> before + 1) AS breaks FROM e GROUP BY l_orderkey")
def receipt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each receipt must follow the one before it."""
    from pyspark.sql import Window as W

    before = F.lag("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", before.alias("before"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("links"), F.count_if(F.col("before").isNotNull() & (F.col("l_linenumber") != F.col("before") + 1)).alias("breaks"))


@query("SELECT o_orderkey, c_name || ' #' || o_orderkey AS label, CASE WHEN o_orderstatus = 'F' THEN 'reviewed' WHEN o_totalprice > 400000 THEN 'blocked' END AS state FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' OR o_totalprice > 400000")
def result_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' OR o_totalprice > 400000")
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat("c_name", F.lit(" #"), "o_orderkey").alias("label"), F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_totalprice") > 400000, "blocked").alias("state"))


