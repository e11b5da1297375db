"""Registration of queries with their SQL oracle, and the evidence view they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The same evidence view in SQL: one row per line of every document.
EV = (
    "ev AS (SELECT doc_id, source || '/' || lang AS file_name, lang AS family, u.line AS raw_text, "
    "CAST(u.ord AS BIGINT) AS ord FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, ord))"
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents as evidence rows (doc_id, file_name, family, raw_text, ord)."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("file_name"), F.col("lang").alias("family"), F.posexplode(F.split("text", "\n")).alias("ord", "raw_text"))
    return lines.withColumn("ord", F.col("ord").cast("long") + 1)
