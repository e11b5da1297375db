"""Records: numbering, field flattening, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: str, order: str, width: int, name: str = "n") -> DataFrame:
    """row_number of ``rows`` in their group by an integer ``order`` without bringing a
    hot group together: ranges of ``width`` are counted, the counts are summed up, and
    each range numbers its own rows from there."""
    cut = rows.withColumn("__r", F.floor(F.col(order) / width))
    counts = cut.groupBy(group, "__r").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__c").over(W.partitionBy(group).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(group, "__r", "__b")
    own = F.row_number().over(W.partitionBy(group, "__r").orderBy(order))
    return cut.withColumn("__own", own).join(before, [group, "__r"]).withColumn(name, F.col("__own") + F.col("__b")).drop("__own", "__b", "__r")


def flatten(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, path, claim): one row per field that has a value."""
    pairs = F.array(*[F.struct(F.lit(f"/{f}").alias("path"), F.col(f).cast("string").alias("claim")) for f in fields])
    return rows.select(*key, F.explode(pairs).alias("f")).select(*key, "f.*").where(F.col("claim").isNotNull())


def citation(text: Column, quote: Column) -> Column:
    """0-based start of the quote where it occurs exactly once, else null."""
    first = F.locate_expr(text, quote) if hasattr(F, "locate_expr") else F.position(quote, text)
    again = F.position(quote, text, first + 1)
    return F.when((first > 0) & (again == 0), first - 1)


def statement(text: Column, start: Column, end: Column) -> Column:
    """The tightest sentence or line around a span, trimmed. A full stop ends a
    sentence only before white space or the end."""
    before = F.substring(text, F.lit(1), start)
    head = F.regexp_extract(before, "(?s)^.*(?:\n|[。！？!?]|[.](?=\\s))", 0)
    left = F.length(head)
    rest = F.substring(text, end + 1, F.length(text))
    tail = F.regexp_extract(rest, "(?s)^.*?(?:\n|[。！？!?]|[.](?=\\s|$))", 0)
    right = F.when(F.length(tail) > 0, end + F.length(tail)).otherwise(F.length(text))
    return F.trim(F.substring(text, left + 1, right - left))
