"""Page selection: scores, order and packing under a byte budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locatext.operators import search as S

WEIGHT, DIGIT_WEIGHT = 6, 32


def page_scores(rows: DataFrame, terms: list[str], page: str = "doc_id", row: str = "ord", name: str = "file_name", text: str = "raw_text") -> DataFrame:
    """For each term w * min(2, sum over rows of min(2, count)), and 2 w where the file
    name has it; w is 32 for terms with a digit, else 6. Pages without a hit do not come."""
    hits = S.postings(rows, [page, row, name], text, terms).withColumn("c", F.least(F.lit(2), "tf"))
    weight = F.when(F.col("term").rlike("[0-9]"), DIGIT_WEIGHT).otherwise(WEIGHT)
    per_term = hits.groupBy(page, name, "term").agg((weight * F.least(F.lit(2), F.sum("c"))).alias("body"))
    points = F.col("body") + F.when(F.contains(F.lower(name), F.col("term")), 2 * weight).otherwise(0)
    return per_term.groupBy(page, name).agg(F.sum(points).cast("long").alias("score"))


def page_order(scored: DataFrame, page: str = "doc_id", name: str = "file_name") -> DataFrame:
    return scored.where("score > 0").orderBy(F.desc("score"), F.lower(name), F.col(page).asc_nulls_last())
