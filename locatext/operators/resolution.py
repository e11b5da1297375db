"""Resolution and comparison: latest revisions, run comparison, publish actions,
ledgers. A conflict is a row that says so, never an arbitrary winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def compare_runs(base: DataFrame, new: DataFrame, key: str, outcome: str) -> DataFrame:
    """ADDED, REMOVED, UNCHANGED (equal multisets of outcomes) or CHANGED per key."""
    bag = lambda df, n: df.groupBy(key).agg(F.array_sort(F.collect_list(outcome)).alias(n))
    joined = bag(base, "__a").join(bag(new, "__b"), key, "full_outer")
    change = F.when(F.col("__a").isNull(), "ADDED").when(F.col("__b").isNull(), "REMOVED").when(F.col("__a") == F.col("__b"), "UNCHANGED").otherwise("CHANGED")
    return joined.select(key, change.alias("change"))


def latest_revision(claims: DataFrame, scope: str, date: str, value: str, sequence: str | None = None, family: str | None = None) -> DataFrame:
    """Newest date per scope wins if it has one value. A missing date, an inverted
    sequence within a family or several values give UNRESOLVED. Two combined
    aggregations and no window, so a hot scope is reduced before the shuffle."""
    per_day = claims.groupBy(scope, date).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("__n"))
    newest = per_day.groupBy(scope).agg(F.max_by(F.struct("__lo", "__hi", "__n"), date).alias("__top"), F.max(date).alias("newest"), F.bool_or(F.col(date).isNull()).alias("__undated"))
    if sequence and family:
        order = W.partitionBy(scope, family).orderBy(sequence)
        inverted = claims.withColumn("__before", F.max(date).over(order.rowsBetween(W.unboundedPreceding, -1))).where(F.col("__before") > F.col(date)).select(scope).distinct().withColumn("__inverted", F.lit(True))
        newest = newest.join(inverted, scope, "left")
    else:
        newest = newest.withColumn("__inverted", F.lit(None).cast("boolean"))
    good = ~F.col("__undated") & F.col("__inverted").isNull() & (F.col("__top.__lo") == F.col("__top.__hi"))
    return newest.select(scope, F.when(good, "LATEST_APPLIED").otherwise("UNRESOLVED").alias("status"), F.when(good, F.col("__top.__lo")).alias("value"), F.col("newest"), F.col("__top.__n").alias("claims"))


def publish_actions(generated: DataFrame, existing: DataFrame, key: str, digest: str) -> DataFrame:
    """Three-way merge plan: INSERT, KEEP, UPDATE (version + 1, review void) or BLOCK."""
    joined = generated.select(key, F.col(digest).alias("__g")).join(existing.select(key, F.col(digest).alias("__e"), "version"), key, "full_outer")
    action = F.when(F.col("__e").isNull(), "INSERT").when(F.col("__g").isNull(), "BLOCK").when(F.col("__g") == F.col("__e"), "KEEP").otherwise("UPDATE")
    return joined.select(key, action.alias("action")).join(existing.select(key, "version"), key, "left").select(key, "action", (F.coalesce("version", F.lit(0)) + F.when(F.col("action").isin("INSERT", "UPDATE"), 1).otherwise(0)).alias("version"))


def state_of(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Last state of each key in an append-only event table."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("events"))


def agree(values: Column) -> Column:
    """ANSWERED with one value, CONFLICT with several, NONE without."""
    return F.when(F.size(values) == 0, "NONE").when(F.size(values) == 1, "ANSWERED").otherwise("CONFLICT")


def effective(rows: DataFrame, lineage: list[str], date: str) -> DataFrame:
    """Every row with the reason it counts or not among the versions of its lineage.
    Lineage figures are aggregated first and joined back, so a hot lineage is a skewed
    join (which adaptive execution splits) and not one window."""
    figures = rows.groupBy(*lineage).agg(F.count("*").alias("__n"), F.max(date).alias("__newest"), F.bool_or(F.col(date).isNull()).alias("__undated"))
    ties = rows.groupBy(*lineage, date).agg(F.count("*").alias("__ties")).withColumnRenamed(date, "__day")
    newest = figures.join(ties, [*lineage]).where(F.col("__day") == F.col("__newest")).select(*lineage, "__n", "__newest", "__undated", "__ties")
    reason = (
        F.when(F.col("__n") == 1, "ONLY_VERSION")
        .when(F.col("__undated") | F.col("__newest").isNull(), "AMBIGUOUS")
        .when(F.col(date) < F.col("__newest"), "SUPERSEDED")
        .when(F.col("__ties") > 1, "DUPLICATE_NEWEST")
        .otherwise("NEWEST")
    )
    return rows.join(newest, lineage, "left").withColumn("reason", reason)


def newest_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Newest of labels that are all integers or all single letters; else null."""
    x = F.col(label)
    grouped = rows.groupBy(key).agg(F.every(x.rlike("^[0-9]+$")).alias("ints"), F.every(x.rlike("^[A-Z]$")).alias("letters"), F.max(F.expr(f"try_cast({label} AS INT)")).alias("top"), F.max(x).alias("last"))
    return grouped.select(key, F.when(F.col("ints"), F.col("top").cast("string")).when(F.col("letters"), F.col("last")).alias("newest"))
