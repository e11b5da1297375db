"""Document readers and record repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locatext.functions import documents as D
from locatext.operators import fragments as G
from locatext.registry import EV, evidence, query
from locatext.session import table


@query("SELECT o_orderkey, 'RFI ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ',SUBMITTAL A-' || (o_orderkey % 50) ELSE '' END AS refs FROM orders")
def workflow_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.concat(F.lit("See rfi #"), "o_custkey", F.lit(" and RFI "), "o_custkey", F.when(k % 2 == 0, F.concat(F.lit("; Submittal A-"), k % 50)).otherwise(""), F.lit(" from rfi9@x.com"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(D.workflow_references(said), ",").alias("refs"))


@query("WITH p AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[;?.] *'), lambda x: trim(x)), lambda x: x <> '') AS parts, text FROM benchmark) SELECT item_id, CASE WHEN len(parts) BETWEEN 2 AND 12 THEN CAST(len(parts) AS INTEGER) ELSE 1 END AS n, CASE WHEN len(parts) BETWEEN 2 AND 12 THEN parts[1] ELSE trim(text) END AS first FROM p")
def answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "benchmark").select("item_id", D.answer_parts(F.col("text")).alias("p"))
    return parts.select("item_id", F.size("p").alias("n"), F.col("p")[0].alias("first"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS number, (['INCH', 'MM', 'PSI', 'PERCENT'])[l_linenumber % 4 + 1] AS unit FROM lineitem")
def numbers_with_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, [" inches", "mm", " psi", "%"])), F.col("l_linenumber") % 4 + 1)
    said = F.concat(F.lit("part 7 needs "), F.col("l_quantity").cast("long"), form, F.lit(" at least"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(D.with_unit(said)).alias("u"))
    return rows.select("l_orderkey", "l_linenumber", "u.number", "u.unit")


@query("SELECT o_orderkey, (['DUE', 'ISSUED', 'RECEIVED', 'RESPONSE', NULL])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS role FROM orders")
def date_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ["Response due: ", "issue date = ", "It was received on ", "answered ", "see "])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    said = F.concat(label, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.date_role(said).alias("role"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) <= 60 AS whole FROM documents")
def utf8_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping never splits a character and fills the budget but for one character."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", D.clip_bytes(F.col("text"), 60).alias("c"))
    good = (F.octet_length("c") <= 60) & F.startswith("text", "c") & ((F.col("c") == F.col("text")) | (F.octet_length("c") > 56))
    return rows.where(good).select("doc_id", (F.col("c") == F.col("text")).alias("whole"))


@query(f"WITH {EV} SELECT doc_id, ord, substr(raw_text, greatest(1, CAST(instr(lower(raw_text), 'token') AS INTEGER) - 40), 80) AS context FROM ev WHERE contains(lower(raw_text), 'token')")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("doc_id", "ord", D.context_window(F.col("raw_text"), "token", 80).alias("context")).where(F.col("context").isNotNull())


@query("SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '[^A-Za-z0-9._ -]', '_', 'g') AS name, regexp_matches(lower(url), '[.]html$') AS is_html FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", D.safe_name(F.col("url")).alias("name"), F.lower("url").endswith(".html").alias("is_html"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'token = \"[A-Za-z0-9_+/=-]{8,}')) AS secrets FROM documents WHERE regexp_matches(text, 'token = \"[A-Za-z0-9_+/=-]{8,}')")
def secret_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("token"))
    masked = docs.select("doc_id", D.scrubbed(F.col("text")).alias("t"))
    return masked.select("doc_id", F.size(F.regexp_extract_all("t", F.lit('token = "[*]{3}'), F.lit(0))).cast("long").alias("secrets")).where("secrets > 0")


@query("SELECT p_partkey, upper(left(lower(split_part(p_type, ' ', 1)), 1)) || substr(lower(split_part(p_type, ' ', 1)), 2) AS label FROM part")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", D.humanised(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("label"))


@query("SELECT l_orderkey, string_agg(l_returnflag || '=' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' | ' ORDER BY l_linenumber, l_partkey, l_returnflag || '=' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS row_text FROM lineitem GROUP BY l_orderkey")
def table_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat("l_returnflag", F.lit("="), F.col("l_quantity").cast("long"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", cell.alias("c")))).alias("r"))
    return rows.select("l_orderkey", F.array_join(F.transform("r", lambda x: x["c"]), " | ").alias("row_text"))


@query("WITH n AS (SELECT c_custkey, 'key' || (c_custkey % 40) AS k, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) AS i FROM customer) SELECT c_custkey, CASE WHEN i = 1 THEN k ELSE k || '~' || i END AS candidate_key FROM n")
def duplicate_key_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract repair: later records of a key get ``~n``."""
    from locatext.operators.records import numbered

    keyed = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("key"), F.col("c_custkey") % 40).alias("k"))
    rows = numbered(keyed, "k", "c_custkey", 1 << 12)
    return rows.select("c_custkey", F.when(F.col("n") == 1, F.col("k")).otherwise(F.concat("k", F.lit("~"), "n")).alias("candidate_key"))


@query("WITH a AS (SELECT DISTINCT l_orderkey, l_suppkey AS k, l_suppkey % 7 AS parent FROM lineitem) SELECT l_orderkey, count(*) AS atoms, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.l_orderkey = a.l_orderkey AND b.k = a.parent)) AS orphan_parents FROM a GROUP BY l_orderkey")
def quality_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms whose parent is not among the record's own lose it; properties dedupe."""
    atoms = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k"), (F.col("l_suppkey") % 7).alias("parent")).distinct()
    sets = atoms.groupBy("l_orderkey").agg(F.count("*").alias("atoms"), F.collect_list("parent").alias("ps"), F.collect_set("k").alias("ks"))
    return sets.select("l_orderkey", "atoms", F.size(F.filter("ps", lambda p: ~F.array_contains("ks", p))).cast("long").alias("orphan_parents"))


@query("""WITH RECURSIVE s AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS i, CAST(l_quantity AS BIGINT) AS size FROM lineitem),
f AS (SELECT k, i, CASE WHEN size <= 420 THEN size ELSE 0 END AS used, size <= 420 AS kept FROM s WHERE i = 1 UNION ALL SELECT s.k, s.i, CASE WHEN f.used + s.size <= 420 THEN f.used + s.size ELSE f.used END, f.used + s.size <= 420 FROM f JOIN s ON s.k = f.k AND s.i = f.i + 1)
SELECT k AS l_suppkey, count(*) FILTER (WHERE kept) AS blocks, max(used) AS bytes FROM f GROUP BY k""")
def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block packing: no exception for the first, so an oversized block is skipped."""
    order = W.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.row_number().over(order).alias("i"), F.col("l_quantity").cast("long").alias("size"))
    kept = G.pack_skip(rows, "l_suppkey", ["i"], "size", 420, first_always=False)
    out = kept.join(rows, ["l_suppkey", "i"]).groupBy("l_suppkey").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"))
    return rows.select("l_suppkey").distinct().join(out, "l_suppkey", "left").select("l_suppkey", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name || ' ' || o_orderpriority || ' ' || o_orderstatus), 'urgent f')")
def free_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.where(F.lower(F.concat_ws(" ", "c_name", "o_orderpriority", "o_orderstatus")).contains("urgent f")).select("o_orderkey")


@query("WITH e AS (SELECT o_custkey, count(*) FILTER (WHERE year(o_orderdate) = 1995) AS a, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS b FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN a = 0 OR b = 0 THEN 'PENDING' WHEN a = b THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM e")
def evaluation_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_year = lambda y: F.count_if(F.year("o_orderdate") == y)
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(in_year(1995).alias("a"), in_year(1996).alias("b"))
    return counts.select("o_custkey", F.when((F.col("a") == 0) | (F.col("b") == 0), "PENDING").when(F.col("a") == F.col("b"), "UNCHANGED").otherwise("CHANGED").alias("state"))
