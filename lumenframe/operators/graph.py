"""Graphs as tables of edges: islands by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.lineage import settled


def islands(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, island) for every node: island is the smallest node that undirected edges (a, b) lead to.

    Edges lead from larger to smaller nodes. A round leads each edge on to the least node that its end leads to, and then
    links all that a node leads to with the least of them, so edges never grow in number and paths halve until all are stars.
    Both tables of a round are written to spark.checkpoint.dir, and one row a round goes to the driver.
    """
    known = settled(nodes.select("node").distinct(), "islands")
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        down = down.join(known.withColumnRenamed("node", end), end, "left_semi")
    down = settled(down.select("a", "b"), "islands")
    for _ in range(rounds):
        low = down.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("low"))
        led = down.join(low, F.col("b") == F.col("at"), "left").groupBy("a", F.coalesce("low", "b").alias("b")).agg(F.max(F.col("low").isNotNull()).alias("moved"))
        led = settled(led, "islands")
        least = led.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"), F.max("moved").alias("moved"))
        both = led.select("a", "b").join(least, "a")
        linked = both.select(F.inline(F.array(F.struct("a", F.col("low").alias("b"), (F.col("moved") | (F.col("n") > 1)).alias("moved")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"), F.lit(False).alias("moved")))))
        new = settled(linked.where("a <> b").groupBy("a", "b").agg(F.max("moved").alias("moved")), "islands")
        down = new.select("a", "b")
        if new.where("moved").isEmpty():
            return settled(known.join(down.withColumnRenamed("b", "island"), F.col("node") == F.col("a"), "left").select("node", F.coalesce("island", "node").alias("island")), "islands")
    raise RuntimeError(f"islands still change after {rounds} rounds")
