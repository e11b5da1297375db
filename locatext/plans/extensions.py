"""Queries beyond the documented core: HTML text, streams, embeddings, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.operators import geometry
from locatext.registry import query
from locatext.session import table
from locatext.sources.text import visible_text_udf
from locatext.streaming import events as E


@query()
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page (a stateful parser: Arrow batches)."""
    return table(spark, sf_dir, "pages").select("page_id", visible_text_udf("html").alias("text"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows by day; the streaming form is ``streaming.events``."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events) SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions FROM s GROUP BY user_id")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", before.alias("before"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("INTERVAL 12 HOUR"))).alias("sessions"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts through Structured Streaming with a watermark."""
    out = E.run_to_files(E.windowed_counts(E.read_events(spark, f"{sf_dir}/events.parquet")))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS mean_square FROM embeddings GROUP BY label")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(square), 4).alias("mean_square"))


@query()
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from word boxes: orders stand for pages, their lines for words."""
    rows = table(spark, sf_dir, "lineitem")
    words = rows.select(F.col("l_orderkey").cast("string").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_linenumber") * 6.0).alias("y0"), (F.col("l_quantity") + 10.0).alias("x1"), (F.col("l_linenumber") * 6.0 + 10.0).alias("y1"), F.col("l_returnflag").alias("text"))
    return geometry.word_lines(words)
