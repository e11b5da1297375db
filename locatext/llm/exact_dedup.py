"""Exact duplicates by an extendible-hash index in the shared folder.

Only DataFrame operations run here.
1. Entries: texts are grouped by their 64-bit key and their normalised bytes, so equal
   keys are compared byte by byte; a group is combined before the shuffle, however many
   rows it has, and every different text moves once. Different texts under one key are
   entries of one chain.
2. Directory: it starts at depth 0 and is doubled wherever a bucket holds more than
   ``capacity`` entries, down to where a bucket's entries share one key. It is worked out
   from counts of leading bits: ``max_depth`` bits at first, and ``STEP`` bits more below
   the buckets that are then still overfull. The capacity is at least a 4096th of all
   entries, which bounds the directory for any input.
3. Owner tasks: entries are dealt by bucket (a range of keys); the owner chains them and
   writes them into the bucket's folder.
4. Look-up: rows find their bucket through the directory and meet its entries at its
   owner. Entries that more than a thousandth of all rows would look up are at most a
   thousand; they are broadcast. Rows of chained keys find their entry by the bytes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locatext.session import scratch_path, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Entries a bucket may hold before it splits.
CAPACITY = 65_536
#: Buckets are never finer than this part of all entries.
MAX_BUCKETS = 4096
#: Leading bits counted at first, and at each further level of the directory.
MAX_DEPTH, STEP = 12, 6
#: Rows that one entry may draw to its owner, unless a thousandth of all rows is more.
HOT_ROWS = 10_000


def normalised(text: Column) -> Column:
    """A-Z to a-z and nothing else; null is empty. Pure ASCII texts take the fast path."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def text_key(norm: Column) -> Column:
    return F.xxhash64(norm)


def directory(histogram: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int]]:
    """Leaf buckets as (depth, leading bits), in key order, from the number of entries
    under each ``max_depth``-bit prefix: double while a bucket is overfull."""
    leaves, todo = [], [(0, 0)]
    sizes = dict(histogram)
    by_depth = {max_depth: sizes}
    for depth in range(max_depth - 1, -1, -1):
        up: dict[int, int] = {}
        for prefix, n in by_depth[depth + 1].items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        by_depth[depth] = up
    while todo:
        depth, prefix = todo.pop()
        if depth < max_depth and by_depth[depth].get(prefix, 0) > capacity:
            todo += [(depth + 1, prefix * 2 + 1), (depth + 1, prefix * 2)]
        else:
            leaves.append((depth, prefix))
    return leaves


Level = tuple[int, dict[int, int]]


def build_directory(entries: DataFrame, capacity: int, first_bits: int = MAX_DEPTH) -> list[Level]:
    """Levels of the directory over the column ``key``: (leading bits, bucket of each
    prefix that some key has). A prefix that is missing at a level is split at the next."""
    levels: list[Level] = []
    bits, step, made = first_bits, first_bits, 0
    part = entries.select("key")
    while True:
        prefix = F.shiftrightunsigned("key", 64 - bits)
        counted = part.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"), (F.min("key") != F.max("key")).alias("parts")).collect()  # at most 2**first_bits, or 2**step for each overfull bucket
        by_parent: dict[int, dict[int, int]] = {}
        for r in counted:
            by_parent.setdefault(r["p"] >> step, {})[r["p"] & (1 << step) - 1] = r["n"]
        parts = {r["p"]: r["n"] for r in counted if r["parts"]}
        slots: dict[int, int] = {}
        deeper: list[int] = []
        for parent, sizes in sorted(by_parent.items()):
            leaf_of = {}
            for depth, leading in directory(sizes, capacity, step):
                leaf_of[depth, leading] = made
                made += 1
            for low in sizes:
                depth = next(d for d in range(step + 1) if (d, low >> (step - d)) in leaf_of)
                whole = parent << step | low
                if depth == step and parts.get(whole, 0) > capacity:
                    deeper.append(whole)
                else:
                    slots[whole] = leaf_of[depth, low >> (step - depth)]
        levels.append((bits, slots))
        if not deeper or bits == 64:
            return levels
        part = part.join(F.broadcast(_inline(entries, {p: 0 for p in deeper}, "at", "z")), prefix == F.col("at"), "left_semi")
        step = min(STEP, 64 - bits)
        bits += step


def _inline(like: DataFrame, slots: dict[int, int], key: str, value: str) -> DataFrame:
    rows = F.from_json(F.lit(json.dumps([{key: k, value: v} for k, v in slots.items()])), f"array<struct<{key}:bigint,{value}:int>>")
    return like.sparkSession.range(1).select(F.inline(rows))


def in_buckets(df: DataFrame, levels: list[Level]) -> DataFrame:
    """``df`` with the ``bucket`` of each row's ``key``, looked up in the directory (a few
    thousand rows, broadcast)."""
    if sum(len(set(slots.values())) for _, slots in levels) < 2:
        return df.withColumn("bucket", F.lit(0))
    columns = df.columns
    for i, (bits, slots) in enumerate(levels):
        if slots:
            df = df.join(F.broadcast(_inline(df, slots, f"slot{i}", f"in{i}")), F.shiftrightunsigned("key", 64 - bits) == F.col(f"slot{i}"), "left")
    return df.select(*columns, F.coalesce(*[F.col(f"in{i}") for i, (_, slots) in enumerate(levels) if slots]).alias("bucket"))


def build_index(entries: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, list[Level], str]:
    """The index of ``entries`` (key, sha, n, keep_id), its directory and its folder, with
    one folder a bucket. ``links`` is the length of the entry's chain."""
    capacity = max(capacity, entries.count() // MAX_BUCKETS)
    levels = build_directory(entries, capacity, max_depth)
    path = scratch_path(entries.sparkSession, "extendible")
    owned = in_buckets(entries, levels).repartition("bucket")
    chains = owned.groupBy("bucket", "key").agg(F.count("*").alias("links"), F.collect_list(F.struct("sha", "n", "keep_id")).alias("chain"))
    chains.select("bucket", "key", "links", F.inline("chain")).write.mode("append").partitionBy("bucket").parquet(path)
    schema = "key long, links long, sha binary, n long, keep_id " + entries.schema["keep_id"].dataType.simpleString() + ", bucket int"
    return entries.sparkSession.read.schema(schema).parquet(path), levels, path


def mark(docs: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key: Callable[[Column], Column] = text_key, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (largest id of the equal texts),
    group_size, kept, text_sha256. Null and empty texts are equal. A null id ranks
    below every other; where rows repeat an id, each row of it is ``kept`` alike. An
    empty table gives no rows. Other columns are not read, so their names are free."""
    slim = docs.select(F.col(id_col).alias("id"), normalised(F.col("text")).alias("norm"))
    slim = slim.select("id", key(F.col("norm")).alias("key"), "norm")
    counts = [F.count("*").alias("n"), F.max("id").alias("keep_id")]
    entries = slim.groupBy("key", "norm").agg(*counts).select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "n", "keep_id")
    entries = written(entries, "entries")
    index, levels, _ = build_index(entries, capacity, max_depth)

    rows = in_buckets(slim.select("id", "key"), levels)
    bound = max(hot_rows, (entries.agg(F.sum("n")).first()[0] or 0) // 1000)
    plain = index.where("links = 1").drop("links")
    hot = F.broadcast(plain.where(F.col("n") > bound).drop("bucket"))
    out = ["id", "n", "keep_id", "sha"]
    found = rows.join(hot, "key").select(*out)
    mild = rows.join(hot.select("key"), "key", "left_anti").repartition("bucket")
    found = found.unionByName(mild.join(plain.where(F.col("n") <= bound).repartition("bucket"), ["bucket", "key"]).select(*out))
    chained = index.where("links > 1").select("key").distinct()
    if not chained.isEmpty():
        # Texts that share a key with others: their rows find their entry by the bytes.
        texts = slim.join(chained, "key", "left_semi")
        own = texts.select("id", "key", "norm").join(texts.groupBy("key", "norm").agg(*counts), ["key", "norm"])
        found = found.unionByName(own.select("id", "n", "keep_id", F.unhex(F.sha2("norm", 256)).alias("sha")))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_largest_id(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Where rows repeat an id
    that stays, all of them stay."""
    stay = mark(docs, id_col, **options).where("kept").select(F.col(id_col).alias("__stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__stay"]), "left_semi")
