"""Provenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.operators import provenance as P
from locatext.registry import query
from locatext.session import table


def _json(*columns: str) -> str:
    """Compact JSON list of values as text, in DuckDB."""
    return "'[' || " + " || ',' || ".join(f"'\"' || {c} || '\"'" for c in columns) + " || ']'"


@query("""WITH m AS (SELECT p_partkey AS k, p_brand || CASE WHEN p_partkey % 11 = 0 THEN '?' ELSE '' END AS d FROM part WHERE p_partkey % 13 <> 0), b AS (SELECT p_partkey AS k, p_brand AS d FROM part WHERE p_partkey % 17 <> 0)
SELECT coalesce(m.k, b.k) AS p_partkey, CASE WHEN b.k IS NULL THEN 'MISSING' WHEN m.k IS NULL THEN 'ADDED' WHEN m.d = b.d THEN 'SAME' ELSE 'CHANGED' END AS state FROM m FULL JOIN b ON m.k = b.k""")
def manifest_authentication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of digests against its rebuilt rows."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    said = F.concat("p_brand", F.when(k % 11 == 0, "?").otherwise(""))
    manifest = part.where(k % 13 != 0).select("p_partkey", P.row_hash("p_partkey", said).alias("digest"))
    return P.authenticate(manifest, part.where(k % 17 != 0).select("p_partkey", P.row_hash("p_partkey", "p_brand").alias("digest")), ["p_partkey"])


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, sha256({_json('l_orderkey', 'l_linenumber', 'l_partkey')}) AS digest FROM lineitem WHERE (l_orderkey + l_linenumber) % 31 <> 0),
b AS (SELECT *, lag(digest) OVER w AS prev, lag(l_linenumber) OVER w AS number FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, l_linenumber FROM b WHERE (l_linenumber % 5 = 4 AND prev IS NOT NULL) OR l_linenumber - coalesce(number, l_linenumber - 1) <> 1""")
def broken_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that do not continue their chain: every fifth cites a wrong digest, and
    some receipts are gone."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "lineitem").where((F.col("l_orderkey") + F.col("l_linenumber")) % 31 != 0)
    made = rows.select("l_orderkey", "l_linenumber", P.row_hash("l_orderkey", "l_linenumber", "l_partkey").alias("digest"))
    before = F.lag("digest").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    said = made.withColumn("previous", F.when(F.col("l_linenumber") % 5 == 4, F.when(before.isNotNull(), "wrong")).otherwise(before))
    return P.broken_links(said, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 3 > 0 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 20 = 0) GROUP BY user_id, event_type")
def staged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a stage without repeats and without what is done."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return P.staged_append(e.where("event_id % 3 > 0"), e.where("event_id % 20 = 0"), ["user_id", "event_type"], "event_id")


@query("WITH s AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, o_orderkey, EXISTS (SELECT 1 FROM orders i WHERE i.o_orderstatus = 'O' AND i.o_custkey = s.o_custkey AND i.o_orderpriority = s.o_orderpriority) AS shown FROM s")
def followup_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplements of a case that its inputs really hold, by digest."""
    o = table(spark, sf_dir, "orders").withColumn("digest", F.sha2("o_orderpriority", 256))
    return P.supplements_shown(o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "digest"), o.where("o_orderstatus = 'O'"), ["o_custkey"]).select("o_custkey", "o_orderkey", "shown")


@query("""SELECT o.o_orderkey AS cite, o.o_orderkey AS page, min(l_quantity) AS x0, min(l_linenumber * 10.0)::DOUBLE AS top, max(l_quantity + 5) AS x1, max(l_linenumber * 10.0 + 8)::DOUBLE AS bottom, count(*) AS words FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE l_linenumber * 10.0 < 10 + o_custkey % 30 AND 5 + o_custkey % 9 < l_linenumber * 10.0 + 8 GROUP BY o.o_orderkey""")
def review_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the words that cited ranges overlap."""
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_linenumber") * 10.0).cast("double").alias("y0"), (F.col("l_quantity") + 5).alias("x1"), (F.col("l_linenumber") * 10.0 + 8).cast("double").alias("y1"))
    cited = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cite"), F.col("o_orderkey").alias("page"), (5 + F.col("o_custkey") % 9).alias("y0"), (10 + F.col("o_custkey") % 30).alias("y1"))
    return P.highlights(cited, words)


@query("SELECT c_custkey AS identity, CASE WHEN c_custkey % 4 = 0 THEN 'INSERTED' WHEN c_custkey % 7 = 0 THEN 'REFUSED' ELSE 'UNCHANGED' END AS outcome FROM customer")
def result_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent saves by identity and semantic hash."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    meaning = lambda salt: P.row_hash("c_name", "c_mktsegment", salt)
    saved = c.where(k % 4 != 0).select(k.alias("identity"), meaning(F.when(k % 7 == 0, "old").otherwise("new")).alias("meaning"))
    return P.save_once(saved, c.select(k.alias("identity"), meaning(F.lit("new")).alias("meaning")))


@query("""WITH t AS (SELECT event_id, user_id % 50 AS family, event_id % 6 AS generation, event_type, event_id % 4 AS attempts FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 AND attempts < 3 AND event_id % 5 <> 1 AND generation = max(generation) OVER (PARTITION BY family) THEN 'WOULD_QUEUE' ELSE 'KEPT' END AS action FROM t""")
def requeue_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which failed tasks a requeue would run again (nothing is changed)."""
    k = F.col("event_id")
    tasks = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("family"), (k % 6).alias("generation"), (k % 4).alias("attempts"), F.when(k % 2 == 0, "FAILED").otherwise("DONE").alias("state"), (k % 5 != 1).alias("retryable"))
    return P.requeue(tasks).select("event_id", "action")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'n' || event_id END AS name, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN [] ELSE ['E1', 'E' || event_id] END AS evidence_ids FROM events")
def normalised_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model as typed columns; what is no object is null."""
    k = F.col("event_id")
    said = F.when(k % 3 == 0, "sorry").when(k % 3 == 1, F.concat(F.lit('{"name":"n'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"name":"n'), k, F.lit('","evidence_ids":["E1"," ","E'), k, F.lit('"]}')))
    reply = P.normalised_reply(F.col("said"), "name string, evidence_ids array<string>", ["evidence_ids"])
    typed = table(spark, sf_dir, "events").select("event_id", said.alias("said")).withColumn("r", F.when(F.col("said").startswith("{"), reply))
    return typed.select("event_id", "r.name", "r.evidence_ids")
