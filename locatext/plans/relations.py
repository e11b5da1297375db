"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.operators import relations as R
from locatext.operators import search as S
from locatext.registry import EV, evidence, query
from locatext.session import table


@query(f"WITH {EV} SELECT d.source, count(*) AS n, count(DISTINCT ev.doc_id) AS docs FROM ev JOIN documents d USING (doc_id) GROUP BY d.source")
def evidence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return evidence(spark, sf_dir).select("doc_id").join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT d.doc_id, l.quality, b.item_id IS NOT NULL AS is_item FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def item_result_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("hit"))
    return d.join(l, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", "quality", F.coalesce("hit", F.lit(False)).alias("is_item"))


@query("SELECT o_orderkey, (SELECT max(l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS first_flag FROM orders")
def first_field_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlated look-up of one array element, decorrelated to a left join."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("first_flag"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphans(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def scope_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = table(spark, sf_dir, "customer").select("c_custkey")
    for condition in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'"):
        out = out.join(orders.where(condition), "c_custkey", "left_semi")
    return out


_PATHS = "p AS (SELECT doc_id, source || ' > ' || lang || ' > ' || CAST(doc_id % 10 AS VARCHAR) AS path FROM documents)"


@query(f"WITH {_PATHS}, s AS (SELECT DISTINCT source || ' > ' || lang AS scope FROM documents UNION SELECT DISTINCT source FROM documents) SELECT scope, count(*) AS n FROM s JOIN p ON path = scope OR starts_with(path, scope || ' > ') GROUP BY scope")
def path_prefix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    paths = docs.select("doc_id", F.concat_ws(" > ", "source", "lang", (F.col("doc_id") % 10).cast("string")).alias("path"))
    scopes = docs.select(F.concat_ws(" > ", "source", "lang").alias("scope")).union(docs.select("source")).distinct()
    return R.prefix_scopes(paths, "path").join(scopes, "scope", "left_semi").groupBy("scope").agg(F.count("*").alias("n"))


@query("""SELECT l.l_orderkey, p.p_name, s.s_name, n.n_name FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n_nationkey WHERE l_linenumber = 1 AND l_returnflag = 'R'""")
def attachment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    kept = l.where("l_linenumber = 1 AND l_returnflag = 'R'")
    return kept.join(p, kept.l_partkey == p.p_partkey).join(s, kept.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select("l_orderkey", "p_name", "s_name", "n_name")


@query("SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'Q' || l.quality ELSE d.source END AS kind, CASE WHEN l.quality IS NOT NULL THEN 'OVERRIDE' ELSE 'PARSER' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def overlay_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind"))
    manual = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.concat(F.lit("Q"), "quality").alias("kind"))
    return R.overlay(base, manual, "doc_id", "kind")


@query("SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 3")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.divide(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("WITH r AS (SELECT conv_id, unnest(list_distinct([turn, turn + 1, turn - 1])) AS turn FROM conversations) SELECT conv_id, turn, count(*) AS refs FROM r JOIN conversations USING (conv_id, turn) GROUP BY ALL")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    refs = turns.select("conv_id", F.explode(F.array_distinct(F.array("turn", F.col("turn") + 1, F.col("turn") - 1))).alias("turn"))
    return refs.join(turns, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.count("*").alias("refs"))


_SPAN = "CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + 3 + l_linenumber AS e"


@query(f"WITH a AS (SELECT l_orderkey, l_linenumber AS n, {_SPAN} FROM lineitem) SELECT x.l_orderkey, x.n AS a, y.n AS b FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND x.n < y.n AND x.e > y.s AND x.s < y.e")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("s"), (F.col("l_quantity").cast("long") + 3 + F.col("l_linenumber")).alias("e"))
    a = rows.select("l_orderkey", F.col("n").alias("a"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = rows.select("l_orderkey", F.col("n").alias("b"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return R.interval_join(a, b, "l_orderkey", 8).where("a < b").select("l_orderkey", "a", "b")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 15000 AND 25000")
def bbox_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("l_quantity").between(10, 20) & F.col("l_extendedprice").between(15000, 25000)
    return table(spark, sf_dir, "lineitem").where(inside).select("l_orderkey", "l_linenumber")


@query(f"WITH {EV}, e AS (SELECT doc_id, ord, (ord - 1) // 10 AS section FROM ev WHERE contains(raw_text, '@') OR contains(raw_text, 'token')) SELECT a.doc_id, a.ord AS left_ord, b.ord AS right_ord, a.section = b.section AS same_section FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.ord < b.ord AND (a.section = b.section OR b.ord - a.ord <= 1)")
def locality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).where(F.col("raw_text").contains("@") | F.col("raw_text").contains("token")).select("doc_id", "ord", F.floor((F.col("ord") - 1) / 10).alias("section"))
    a, b = rows.select("doc_id", F.col("ord").alias("left_ord"), F.col("section").alias("sa")), rows.select("doc_id", F.col("ord").alias("right_ord"), F.col("section").alias("sb"))
    near = (F.col("left_ord") < F.col("right_ord")) & ((F.col("sa") == F.col("sb")) | (F.col("right_ord") - F.col("left_ord") <= 1))
    return a.join(b, "doc_id").where(near).select("doc_id", "left_ord", "right_ord", (F.col("sa") == F.col("sb")).alias("same_section"))


@query("""WITH a AS (SELECT o_custkey AS k, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS h FROM orders WHERE year(o_orderdate) = 1995 GROUP BY k), b AS (SELECT o_custkey AS k, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS h FROM orders WHERE year(o_orderdate) = 1996 GROUP BY k)
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locatext.operators.resolution import compare_runs

    orders = table(spark, sf_dir, "orders")
    base, new = (orders.where(F.year("o_orderdate") == y) for y in (1995, 1996))
    return compare_runs(base, new, "o_custkey", "o_orderstatus")


_LEDGER = "SELECT event_id, 'POINT' AS branch FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'PREFIX' FROM events WHERE starts_with(event_type, 'c') UNION ALL SELECT event_id, 'OTHER' FROM events WHERE event_type = 'view' AND value > 50"


@query(f"SELECT branch, count(*) AS n, count(DISTINCT event_id) AS ids FROM ({_LEDGER}) GROUP BY branch")
def family_ledger_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, t = table(spark, sf_dir, "events"), F.col("event_type")
    parts = [events.where(c).select("event_id", F.lit(n).alias("branch")) for n, c in (("POINT", t == "purchase"), ("PREFIX", t.startswith("c")), ("OTHER", (t == "view") & (F.col("value") > 50)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("branch").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("WITH a AS (SELECT p_partkey, p_brand, p_size FROM part), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 97 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part) (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def table_equality_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    b = a.withColumn("p_size", F.when(F.col("p_partkey") % 97 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return R.equal_tables(a, b)


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1 THEN 'COMPLETE' ELSE 'DUPLICATE' END AS status, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS original FROM documents")
def content_dedup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return R.content_status(docs, ["source"], "sha256", "doc_id").select("doc_id", "status", "original")


@query(f"WITH {EV}, d AS (SELECT doc_id, raw_text, min(ord) AS ord, count(*) AS copies FROM ev GROUP BY ALL) SELECT doc_id, ord, copies FROM d")
def exact_row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-content dedup in rank order: the best-ranked row of equal text stays."""
    rows = evidence(spark, sf_dir)
    best = S.first_per_content(rows.select("doc_id", "raw_text", "ord"), ["doc_id", "raw_text"], [F.asc("ord")])
    copies = rows.groupBy("doc_id", "raw_text").agg(F.count("*").alias("copies"))
    return best.join(copies, ["doc_id", "raw_text"]).select("doc_id", "ord", "copies")


@query("WITH c AS (SELECT doc_id, 60 AS bonus, false AS adjacent FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, 40, true FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 20, doc_id % 2 = 0 FROM documents WHERE n_chars > 2000) SELECT doc_id, max(bonus) AS bonus, bool_or(adjacent) AS adjacent FROM c GROUP BY doc_id")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = [docs.where(c).select("doc_id", F.lit(b).alias("bonus"), a.alias("adjacent")) for c, b, a in (("source = 'src1'", 60, F.lit(False)), ("lang = 'fr'", 40, F.lit(True)), ("n_chars > 2000", 20, F.col("doc_id") % 2 == 0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc_id").agg(F.max("bonus").alias("bonus"), F.bool_or("adjacent").alias("adjacent"))


@query("WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F')) AS a, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O')) AS b FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)), ',') AS missing, array_to_string(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x)), ',') AS new FROM s")
def set_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lambda s: F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))))
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(seen("F").alias("a"), seen("O").alias("b"))
    return sets.select("o_custkey", F.array_join(F.array_except("a", "b"), ",").alias("missing"), F.array_join(F.array_except("b", "a"), ",").alias("new"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("pos"))
    return firsts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("WITH l AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS used FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), s AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS cited FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY ALL) SELECT l.l_orderkey, used, coalesce(cited, 0) AS cited, used > coalesce(cited, 0) AS rejected FROM l LEFT JOIN s USING (l_orderkey)")
def claim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose values are not all among the cited values are rejected."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    used = F.collect_set("l_suppkey")
    cited = F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")))
    sets = lines.groupBy("l_orderkey").agg(used.alias("u"), cited.alias("c"))
    return sets.select("l_orderkey", F.size("u").cast("long").alias("used"), F.size("c").cast("long").alias("cited"), (F.size(F.array_except("u", "c")) > 0).alias("rejected"))
