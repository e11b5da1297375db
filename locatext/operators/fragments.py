"""Per-document transforms: context carried forward, groups, splits, islands, packers.

Packers are ordered folds over one document's rows: ``aggregate`` over a sorted array
keeps them inside the JVM. Their state is one document, never a source or a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, key: str, order: str, column: str, name: str) -> DataFrame:
    """Last non-null value up to each row."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(w))


def boundary_groups(rows: DataFrame, key: str, order: str, starts: Column, name: str = "group_no") -> DataFrame:
    """Number of boundaries met so far: a new group at every row that ``starts`` one."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("long")).over(w))


def split_history(rows: DataFrame, key: str, order: str, starts: Column, name: str = "part") -> DataFrame:
    """BODY before the first row that starts quoted history, HISTORY from it on."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.when(F.max(starts.cast("int")).over(w) == 1, "HISTORY").otherwise("BODY"))


def merge_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Islands of overlapping or touching intervals and their number of members. An interval
    without a start is an island alone; one without an end comes last of its start."""
    in_order = W.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    upto = in_order.rowsBetween(W.unboundedPreceding, 0)
    flagged = rows.withColumn("__new", F.coalesce((F.col(start) > F.max(end).over(before)).cast("int"), F.lit(1)))
    islands = flagged.withColumn("__no", F.sum("__new").over(upto))
    return islands.groupBy(key, "__no").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count("*").alias("members")).drop("__no")


def _sorted(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("__rows"))


def pack_skip(rows: DataFrame, key: str, order: list[str], size: str, budget: int, limit: int | None = None, first_always: bool = True) -> DataFrame:
    """Greedy packing that skips what does not fit and goes on; the first row is kept
    whatever its size where ``first_always``. Returns (key, order columns) of the kept."""
    s0 = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"), F.array().cast(f"array<struct<{','.join(f'{c}:{rows.schema[c].dataType.simpleString()}' for c in order)}>>").alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        fits = (acc["used"] + r[size] <= budget) | (F.lit(first_always) & (acc["n"] == 0))
        if limit is not None:
            fits = fits & (acc["n"] < limit)
        return F.when(fits, F.struct((acc["used"] + r[size]).alias("used"), (acc["n"] + 1).alias("n"), F.concat(acc["kept"], F.array(F.struct(*[r[c].alias(c) for c in order]))).alias("kept"))).otherwise(acc)

    packed = _sorted(rows.withColumn(size, F.col(size).cast("long")), key, order, [size]).select(key, F.aggregate("__rows", s0, step)["kept"].alias("k"))
    return packed.select(key, F.explode("k").alias("k")).select(key, "k.*")


def pack_runs(rows: DataFrame, key: str, order: str, size: str, budget: int, items: int) -> DataFrame:
    """Batches of adjacent rows under a size and an item cap: a new batch where either
    would be exceeded. Returns (key, order, batch)."""
    s0 = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(1).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["used"] + r[size] > budget) | (acc["n"] >= items))
        batch = acc["batch"] + full.cast("int")
        return F.struct((F.when(full, 0).otherwise(acc["used"]) + r[size]).alias("used"), (F.when(full, 0).otherwise(acc["n"]) + 1).alias("n"), batch.alias("batch"), F.concat(acc["out"], F.array(batch)).alias("out"))

    packed = _sorted(rows.withColumn(size, F.col(size).cast("long")), key, [order], [size]).select(key, "__rows", F.aggregate("__rows", s0, step)["out"].alias("b"))
    return packed.select(key, F.explode(F.arrays_zip(F.col(f"__rows.{order}").alias("o"), F.col("b").alias("b"))).alias("z")).select(key, F.col("z.o").alias(order), F.col("z.b").alias("batch"))


def split_text(text: Column, chars: int) -> Column:
    """Pieces of at most ``chars`` code points."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / chars)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * chars + 1, F.lit(chars)))
