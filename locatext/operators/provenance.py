"""Proofs about results: manifests, receipts, staged appends, follow-ups, saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_hash(*columns: str | Column) -> Column:
    """SHA-256 of the compact JSON list of the values as text."""
    return F.sha2(F.to_json(F.array(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in columns])), 256)


def authenticate(manifest: DataFrame, rebuilt: DataFrame, keys: list[str], digest: str = "digest") -> DataFrame:
    """The manifest against what it is rebuilt from: SAME, CHANGED, MISSING (in what was
    rebuilt) or ADDED, for every key."""
    a = manifest.select(*keys, F.col(digest).alias("said"))
    b = rebuilt.select(*keys, F.col(digest).alias("is"))
    state = F.when(F.col("is").isNull(), "MISSING").when(F.col("said").isNull(), "ADDED").when(F.col("said") == F.col("is"), "SAME").otherwise("CHANGED")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def broken_links(receipts: DataFrame, chain: str, order: str) -> DataFrame:
    """Receipts (chain, order, previous, digest) whose ``previous`` is not the digest of
    the one before (null for the first), or whose number leaves a gap."""
    w = W.partitionBy(chain).orderBy(order)
    before, number = F.lag("digest").over(w), F.lag(order).over(w)
    seen = receipts.withColumns({"expected": before, "gap": F.col(order) - F.coalesce(number, F.col(order) - 1) != 1})
    return seen.where(~F.col("previous").eqNullSafe(F.col("expected")) | F.col("gap"))


def staged_append(staged: DataFrame, done: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows of a stage: each key once (the first asked for), none that is done."""
    first = staged.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
    return first.join(done.select(*keys).distinct(), keys, "left_anti")


def supplements_shown(supplements: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Supplements with whether a later input of their case really holds their text."""
    shown = inputs.select(*keys, F.col("digest"), F.lit(True).alias("shown")).distinct()
    return supplements.join(shown, [*keys, "digest"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


def highlights(cited: DataFrame, words: DataFrame) -> DataFrame:
    """Box around the words (page, x0, y0, x1, y1) that every cited range of a page
    (cite, page, y0, y1) overlaps, and their number; pages meet by equality."""
    w = words.select("page", "x0", "x1", F.col("y0").alias("wy0"), F.col("y1").alias("wy1"))
    met = cited.join(w, "page").where((F.col("wy0") < F.col("y1")) & (F.col("y0") < F.col("wy1")))
    return met.groupBy("cite", "page").agg(F.min("x0").alias("x0"), F.min("wy0").alias("top"), F.max("x1").alias("x1"), F.max("wy1").alias("bottom"), F.count("*").alias("words"))


def save_once(saved: DataFrame, results: DataFrame, identity: str = "identity", meaning: str = "meaning") -> DataFrame:
    """What saving ``results`` does: INSERTED, UNCHANGED (same identity and meaning) or
    REFUSED (an identity may not change its meaning)."""
    have = saved.select(identity, F.col(meaning).alias("had"))
    outcome = F.when(F.col("had").isNull(), "INSERTED").when(F.col("had") == F.col(meaning), "UNCHANGED").otherwise("REFUSED")
    return results.join(have, identity, "left").select(identity, outcome.alias("outcome"))


def requeue(tasks: DataFrame, apply: bool = False) -> DataFrame:
    """Failed tasks that may run again: retryable, no newer generation of their family,
    fewer than three attempts. A plan says WOULD_QUEUE, an application QUEUED."""
    newest = F.max("generation").over(W.partitionBy("family"))
    may = (F.col("state") == "FAILED") & F.col("retryable") & (F.col("attempts") < 3) & (F.col("generation") == newest)
    return tasks.withColumn("action", F.when(may, "QUEUED" if apply else "WOULD_QUEUE").otherwise("KEPT"))


def normalised_reply(reply: Column, schema: str, lists: list[str]) -> Column:
    """A model's JSON reply as typed columns: missing lists are empty, blanks are null,
    and a reply that is no object is null."""
    typed = F.from_json(reply, schema)
    for name in lists:
        typed = F.when(typed.isNotNull(), typed.withField(name, F.filter(F.coalesce(typed[name], F.array().cast("array<string>")), lambda x: F.trim(x) != "")))
    return typed
