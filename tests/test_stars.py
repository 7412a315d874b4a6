"""Islands take few rounds and few jobs, whatever the names of their nodes."""

import random

from lumenframe.operators import graph


def least(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        if a in up and b in up:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {n: top(n) for n in nodes}


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_trees_of_any_names(spark):
    rng = random.Random(3)
    nodes = list(range(1500))
    edges = [(i, i + rng.randint(1, 25)) for i in nodes] + [(7, 7), (3, None)]  # some lead to no node
    out, n = jobs(spark, "trees", lambda: graph.islands(spark.createDataFrame([(i,) for i in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")))
    assert {r["node"]: r["island"] for r in out.collect()} == least(nodes, edges) and n < 110


def test_lone_nodes_nulls_and_a_missing_middle(spark):
    nodes = spark.createDataFrame([(1,), (3,), (5,), (None,)], "node long")
    out = graph.islands(nodes, spark.createDataFrame([(1, 2), (2, 3), (None, 5)], "a long, b long"))
    assert {r["node"]: r["island"] for r in out.collect()} == {1: 1, 3: 3, 5: 5, None: None}
