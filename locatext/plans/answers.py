"""Claim-support and question queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.operators import claims as V
from locatext.plans.planner import recognise
from locatext.registry import query
from locatext.session import table


def _unsupported_sql(pattern: str) -> str:
    return f"""WITH c AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM (SELECT conv_id, text || ' ' || (conv_id % 7) || '.5 2024-01-0' || (conv_id % 9 + 1) AS text FROM conversations WHERE role = 'assistant')),
u AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM (SELECT conv_id, text || ' ' || (conv_id % 3) || '.5 2024-01-01' AS text FROM conversations WHERE role = 'user'))
SELECT conv_id, value FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = c.conv_id AND u.value = c.value)"""


def _claims(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    turns, cid = table(spark, sf_dir, "conversations"), F.col("conv_id")
    said = turns.where("role = 'assistant'").select("conv_id", F.concat("text", F.lit(" "), cid % 7, F.lit(".5 2024-01-0"), cid % 9 + 1).alias("text"))
    cited = turns.where("role = 'user'").select("conv_id", F.concat("text", F.lit(" "), cid % 3, F.lit(".5 2024-01-01")).alias("text"))
    return V.unsupported(said, cited, "conv_id", family)


@query(_unsupported_sql("[0-9]+(?:[.][0-9]+)?"))
def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir, "number")


@query(_unsupported_sql("[0-9]{4}-[0-9]{2}-[0-9]{2}"))
def unsupported_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir, "date")


@query("""WITH s AS (SELECT o_orderkey, (['Approved as noted', 'was NOT approved', 'still pending review', 'closed', 'no status', 'Revise and resubmit'])[CAST(o_orderkey % 6 AS INTEGER) + 1] AS said FROM orders)
SELECT said, (CASE said WHEN 'Approved as noted' THEN 'APPROVED_AS_NOTED' WHEN 'was NOT approved' THEN 'REJECTED' WHEN 'still pending review' THEN 'PENDING' WHEN 'closed' THEN 'CLOSED' WHEN 'Revise and resubmit' THEN 'REVISE_AND_RESUBMIT' END) AS disposition, count(*) AS n FROM s GROUP BY ALL""")
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = ["Approved as noted", "was NOT approved", "still pending review", "closed", "no status", "Revise and resubmit"]
    said = F.element_at(F.array(*map(F.lit, phrases)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(said.alias("said")).groupBy("said", V.disposition(F.col("said")).alias("disposition")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS sources, count(*) - count(DISTINCT l_suppkey) AS repeats, count(DISTINCT l_returnflag) AS families, count(DISTINCT l_suppkey) >= 2 AND count(*) = count(DISTINCT l_suppkey) AND count(DISTINCT l_returnflag) >= 2 AS comparable FROM lineitem GROUP BY l_orderkey")
def comparison_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison needs two families, two sources and no source twice."""
    n, s, f = F.count("*"), F.countDistinct("l_suppkey"), F.countDistinct("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(s.alias("sources"), (n - s).alias("repeats"), f.alias("families"), ((s >= 2) & (n == s) & (f >= 2)).alias("comparable"))


@query("SELECT o_custkey, count(*) AS parts, count(DISTINCT o_orderpriority) AS covered, count(DISTINCT o_orderpriority) = 5 AS complete FROM orders GROUP BY o_custkey")
def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("parts"), F.collect_set("o_orderpriority").alias("have"))
    return sets.select("o_custkey", "parts", F.size("have").cast("long").alias("covered"), (F.size(F.array_except(wanted, "have")) == 0).alias("complete"))


@query()
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed requests of a fixed set of questions (the planner runs on the driver)."""
    asked = ["What is the status of RFI 042?", "How many submittals are there?", "Who is assigned to RFI No. 7?", "When was submittal 03-1000-1 approved?", "What is the subject of email a.eml?", "Which files mention RFI 12?", "What was the response to RFI 9?", "Compare the pumps"]
    rows = [(q, r.intent, r.workflow, r.identifier, r.argument) for q in asked for r in [recognise(q)]]
    return spark.createDataFrame(rows, "question string, intent string, workflow string, identifier string, argument string")
