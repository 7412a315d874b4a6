"""Closures of expression graphs: trees of sums and mixes as weighted lobes, one of them picked, all of them weighed together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.lineage import settled

ROOT, SOCKET = "output", "surface"
ADD, MIX = "add_closure", "mix_closure"
#: Inner nodes above one another beyond which a graph is taken for one with a cycle.
DEEPEST = 1000


def lobes(nodes: DataFrame, edges: DataFrame, root: str = ROOT, socket: str = SOCKET) -> DataFrame:
    """(graph, node, weight) of every leaf that the root's socket leads to, through add_closure and mix_closure nodes.

    A sum passes its weight on to both sides, a mix 1 - fac of it to closure1 and fac to closure2; fac is a default of
    the node, between 0 and 1, 0.5 where it is missing. A leaf that several ways lead to has the sum of their weights; one
    of weight 0 leaves. A round takes one step down in all graphs: an aggregation by node and a join with edges, so a node
    that many share is one row. Open sockets give nothing. A graph with a cycle is an error.
    """
    fac = F.least(F.greatest(F.coalesce(F.get(F.col("defaults")["fac"], F.lit(0)), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    inner = settled(nodes.where(F.col("kind").isin(ADD, MIX)).select("graph", "node", "kind", fac.alias("fac")), "inner")
    into = edges.select("graph", F.col("to_node").alias("node"), F.col("to_socket").alias("socket"), F.col("from_node").alias("child"))
    front = settled(into.where((F.col("node") == root) & (F.col("socket") == socket)).select("graph", F.col("child").alias("node"), F.lit(1.0).alias("weight")), "front")
    out = None
    for _ in range(DEEPEST):
        known = front.groupBy("graph", "node").agg(F.sum("weight").alias("weight")).where("weight > 0").join(inner, ["graph", "node"], "left")
        known = settled(known, "known")
        ends = known.where("kind IS NULL").select("graph", "node", "weight")
        out = ends if out is None else out.unionByName(ends)
        open_ = known.where("kind IS NOT NULL")
        if open_.isEmpty():
            return out.groupBy("graph", "node").agg(F.sum("weight").alias("weight"))
        share = F.when(F.col("kind") == ADD, F.lit(1.0)).when(F.col("socket") == "closure1", 1 - F.col("fac")).otherwise(F.col("fac"))
        front = open_.join(into.where(F.col("socket").isin("closure1", "closure2")), ["graph", "node"]).select("graph", F.col("child").alias("node"), (F.col("weight") * share).alias("weight"))
    raise RuntimeError(f"closures lie more than {DEEPEST} deep: break cycles first")


def pick(points: DataFrame, found: DataFrame, rand: str) -> DataFrame:
    """points (graph and others) with the node of one lobe of their graph, chance, and left: the number stretched to [0, 1) again.

    Lobes are picked by weight in the order of their names. A graph's lobes are one row, which its points join.
    """
    lists = found.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("node", "weight"))).alias("all"), F.sum("weight").alias("total"))
    start = "named_struct('node', CAST(NULL AS STRING), 'upto', 0.0D, 'before', 0.0D, 'chance', 0.0D)"
    step = f"CASE WHEN s.node IS NOT NULL AND {rand} < s.upto THEN s ELSE named_struct('node', x.node, 'upto', s.upto + x.weight / total, 'before', s.upto, 'chance', x.weight / total) END"
    d = points.join(lists.hint("merge"), "graph").withColumn("held", F.expr(f"aggregate(all, {start}, (s, x) -> {step})"))
    left = F.least(F.greatest((F.col(rand) - F.col("held.before")) / F.col("held.chance"), F.lit(0.0)), F.lit(1 - 2.0**-53))
    return d.withColumn("node", F.col("held.node")).withColumn("chance", F.col("held.chance")).withColumn("left", left).drop("all", "total", "held")


def together(values: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, pdf) of all lobes as one, from values (keys, graph, node, value, pdf) of each: values add up by weight, densities by the chance that a lobe is picked."""
    totals = found.groupBy("graph").agg(F.sum("weight").alias("total"))
    d = values.join(found.hint("merge"), ["graph", "node"]).join(totals.hint("merge"), "graph")
    return d.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.sum(F.col("weight") / F.col("total") * F.col("pdf")).alias("pdf"))
