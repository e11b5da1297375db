"""Aggregates: every one combines map-side; distinct counts are exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_totals(rows: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """Samples, total, maximum and mean: merging two results is another aggregation."""
    r = lambda c, n: F.round(c, digits).alias(n)
    return rows.groupBy(*keys).agg(F.count("*").alias("samples"), r(F.sum(value), "total"), r(F.max(value), "top"), F.round(F.avg(value), digits + 2).alias("mean"))


def observed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observed, unknown and known-zero counts; the total only where all are known."""
    known = F.count(value)
    return rows.groupBy(*keys).agg(known.alias("observed"), F.count_if(F.col(value).isNull()).alias("unknown"), F.count_if(F.col(value) == 0).alias("known_zero"), F.when(F.count("*") == known, F.sum(value)).alias("total"))


ROLES = {"user": "QUESTION", "assistant": "RESPONSE"}


def workflow_groups(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    role = reduce(lambda c, kv: c.when(F.col("role") == kv[0], kv[1]), list(ROLES.items())[1:], F.when(F.col("role") == "user", ROLES["user"])).otherwise("UNKNOWN")
    rows = turns.select(key, role.alias("r"))
    return rows.groupBy(key).agg(F.count("*").alias("members"), F.count_if(F.col("r") == "QUESTION").alias("questions"), F.count_if(F.col("r") == "RESPONSE").alias("responses"), F.array_join(F.array_sort(F.collect_set("r")), " / ").alias("roles"))


def workflow_state(questions: Column, responses: Column) -> Column:
    return F.when((questions > 1) | (responses > 1), "AMBIGUOUS").when((questions > 0) & (responses > 0), "LINKED").otherwise("OPEN")


def instance_sum(rows: DataFrame, scope: str, instance: str, value: str) -> DataFrame:
    """Sum over distinct instances, which must agree with themselves."""
    per = rows.groupBy(scope, instance).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    odd = F.bool_or(F.col("lo") != F.col("hi"))
    return per.groupBy(scope).agg(F.when(odd, "CONFLICT").otherwise("OK").alias("status"), F.when(~odd, F.round(F.sum("lo"), 2)).alias("total"))


def verification_rollup(rows: DataFrame, key: str, state: str) -> DataFrame:
    s = F.col(state)
    some, every = lambda *v: F.bool_or(s.isin(*v)), lambda *v: F.every(s.isin(*v))
    worst = (
        F.when(some("CONTRADICTED"), "CONTRADICTED")
        .when(some("UNSUPPORTED"), "UNSUPPORTED")
        .when(every("SUPPORTED", "NON_DOCUMENT") & some("SUPPORTED"), "SUPPORTED")
        .when(some("SUPPORTED"), "PARTIAL")
        .when(every("NON_DOCUMENT"), "NON_DOCUMENT")
        .otherwise("PENDING")
    )
    return rows.groupBy(key).agg(worst.alias("state"))


def failed_rules(rules: dict[str, DataFrame]) -> DataFrame:
    """Counts of violating rows per rule; only rules that some row breaks."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, counts).where("n > 0")
