"""Trees and graphs: ancestor closure, scope trees, connected components, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.session import written


def ancestors(spark: SparkSession, edges: DataFrame, child: str = "child", parent: str = "parent", levels: int = 1000) -> DataFrame:
    """(node, ancestor, depth) of a tree given as child and parent: a row for every way up.
    Only edges whose child is a parent too lead further. Their ways are written to the
    shared folder and doubled in length until none is longer; every edge then meets them
    in one join. Ways of more than ``levels`` edges (a cycle) are an error."""
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    inner = e.join(e.select(F.col("ancestor").alias("node")).distinct(), "node", "left_semi")
    ways = last = written(inner, "graph-ways")

    def onward(df: DataFrame) -> DataFrame:
        up = ways.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        return df.join(up, "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))

    length = 1
    while not last.where(F.col("depth") == length).isEmpty():
        if length >= levels:
            raise RuntimeError(f"ways of over {levels} edges: a cycle?")
        last = written(onward(last.where(F.col("depth") == length)), "graph-ways")
        ways, length = ways.unionByName(last), length * 2
    return e.unionByName(onward(e))


def components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component): smallest node reachable. Labels and the label's own label
    (pointer jumping) are taken until none changes; every round is written to the
    shared folder, so the plan stays flat and a lost executor costs one round."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph-edges")
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "graph-labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("u").alias("v"), F.col("c").alias("nc")), "v").groupBy("u").agg(F.min("nc").alias("nc"))
        low = label.join(near, "u").select("u", "c", F.least("c", "nc").alias("n"))
        jump = low.join(label.select(F.col("u").alias("n"), F.col("c").alias("j")), "n", "left").select("u", "c", F.least(F.col("n"), F.coalesce("j", "n")).alias("n"))
        new = written(jump, "graph-labels")
        if new.where("c <> n").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("n").alias("component"))
        label = new.select("u", F.col("n").alias("c"))
    raise RuntimeError("components did not settle")


def scope_nodes(rows: DataFrame, levels: list[str], seq: str) -> DataFrame:
    """One node per distinct prefix of ``levels``, at its first row: path, depth, parent
    and ordinal in order of first occurrence among siblings."""
    from pyspark.sql import Window as W

    prefixes = F.array(*[F.struct(F.concat_ws(" > ", *levels[: i + 1]).alias("path"), F.concat_ws(" > ", *levels[:i]).alias("parent"), F.lit(i + 1).alias("depth")) for i in range(len(levels))])
    nodes = rows.select(F.explode(prefixes).alias("p"), seq).groupBy("p.path", "p.parent", "p.depth").agg(F.min(seq).alias("first_seq"))
    return nodes.withColumn("ordinal", F.row_number().over(W.partitionBy("parent").orderBy("first_seq")).cast("long"))
