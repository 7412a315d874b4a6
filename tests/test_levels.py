"""Levels of a graph are found without moving its edges."""

from lumenframe.operators import shadergraph


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_levels_are_found_without_moving_edges(spark):
    n = 12
    nodes = spark.createDataFrame([("g", "output")] + [("g", f"n{i}") for i in range(n + 2)], "graph string, node string")
    edges = spark.createDataFrame([("g", f"n{i + 1}", "out", f"n{i}" if i >= 0 else "output", "in") for i in range(-1, n - 1)], "graph string, from_node string, from_socket string, to_node string, to_socket string")
    found, count = jobs(spark, "levels", lambda: shadergraph.reachable(nodes, edges))
    assert found.count() == n + 1 and count < 102  # 106 with edges moved at each level
