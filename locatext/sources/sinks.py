"""Sinks: idempotent appends, partition rebuilds, reviewer and result exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the table does not have yet."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(*key)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.dropDuplicates(key).write.parquet(path)
        return
    df.dropDuplicates(key).join(have, key, "left_anti").write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replace exactly the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def export_json(df: DataFrame, path: str, reviewed: Column | None = None) -> None:
    """Nested reviewer export, one JSON document a row; with ``reviewed`` only those."""
    rows = df.where(reviewed) if reviewed is not None else df
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def export_sheets(sheets: dict[str, DataFrame], path: str, cell: int = 32767) -> None:
    """One CSV folder per sheet; cells are cut at the spreadsheet's cell limit."""
    for name, df in sheets.items():
        cut = [F.substring(F.col(c).cast("string"), 1, cell).alias(c) for c in df.columns]
        df.select(*cut).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
