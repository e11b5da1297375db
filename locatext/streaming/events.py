"""Extensions beyond batch: windowed counts and per-key state over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.session import scratch_path


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; the schema is that of the files already there. The path
    is given as a pattern, which the file source takes for files and folders alike."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path[:-1] + f"[{path[-1]}]")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and total per window and type; state older than the watermark is dropped."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_files(df: DataFrame, label: str = "stream") -> DataFrame:
    """Drive a streaming frame through all available input into the shared folder, batch
    by batch with a checkpoint, and read it back. Updates of a key replace each other:
    of each window and type the last batch's row counts. Nothing passes the driver."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/rows")
    q = df.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    values = [c for c in df.columns if c not in ("window", "event_type")]
    last = rows.groupBy("window", "event_type").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select("window", "event_type", "v.*")
