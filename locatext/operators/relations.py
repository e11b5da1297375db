"""Join and set operators. No join here names a strategy: Catalyst and adaptive
execution choose it from sizes; sides that are single rows or stated constants are
broadcast where they are built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def overlay(base: DataFrame, override: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of ``override`` where it has one, else of ``base``."""
    over = override.select(key, F.col(column).alias("__o"))
    return base.join(over, key, "left").withColumn("source", F.when(F.col("__o").isNotNull(), "OVERRIDE").otherwise("PARSER")).withColumn(column, F.coalesce("__o", column)).drop("__o")


def divide(rows: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Keys that have every wanted value (relational division)."""
    hit = rows.where(F.col(value).isin(wanted)).groupBy(key).agg(F.countDistinct(value).alias("__n"))
    return hit.where(F.col("__n") == len(set(wanted))).select(key)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_end > b_start) & (a_start < b_end)


def interval_join(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of overlapping half-open intervals [s, e) of one key. Both sides are dealt
    to the bins of ``width`` they touch, so it is an equi-join; a pair is kept only in
    the bin where the later of the two starts, so it comes once."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a, b = left.withColumn("__bin", bins("a_s", "a_e")), right.withColumn("__bin", bins("b_s", "b_e"))
    joined = a.join(b, [key, "__bin"]).where(overlaps(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e")))
    return joined.where(F.col("__bin") == F.floor(F.greatest("a_s", "b_s") / width)).drop("__bin")


def prefix_scopes(rows: DataFrame, path: str, separator: str = " > ") -> DataFrame:
    """Every row with each of its path's prefixes as ``scope``: prefix matching as an
    equi-join, linear in the depth of the path."""
    parts = F.split(path, separator)
    return rows.withColumn("scope", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))))


def equal_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks; empty where they are equal."""
    left, right = a.exceptAll(b).withColumn("side", F.lit("left")), b.exceptAll(a).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def content_status(rows: DataFrame, scope: list[str], digest: str, seq: str) -> DataFrame:
    """First of equal content is COMPLETE, later ones are DUPLICATE of it."""
    w = W.partitionBy(*scope, digest).orderBy(seq)
    return rows.withColumn("status", F.when(F.row_number().over(w) == 1, "COMPLETE").otherwise("DUPLICATE")).withColumn("original", F.first(seq).over(w))
