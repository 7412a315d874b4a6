"""Tables of rounds: what the planner takes them for follows their rows, and none is broadcast for the size of its files."""

from lumenframe.operators import closures, graph, shadergraph, spatial
from lumenframe.sources import scene

NODES = "graph string, node string, kind string, params map<string,string>, defaults map<string,array<double>>"
EDGES = "graph string, from_node string, from_socket string, to_node string, to_socket string"


def size(d):
    return int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_islands(spark):
    n = 300
    out = graph.islands(spark.range(n).selectExpr("id AS node"), spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b"))
    assert size(out) < 10**6 and {r["island"] for r in out.collect()} == {0}


def chain(spark, n):
    nodes = [("g", "output", "output", {}, {})] + [("g", f"n{i:03}", "math" if i else "value", {"math_type": "add"}, {"value": [1.0]} if not i else {"value2": [1.0]}) for i in range(n)]
    edges = [("g", f"n{i:03}", "value", f"n{i + 1:03}" if i < n - 1 else "output", "value1" if i < n - 1 else "surface") for i in range(n)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_graphs(spark):
    nodes, edges = chain(spark, 6)
    folded, left = shadergraph.fold(nodes, edges)
    assert size(folded) < 10**6 and size(left) < 10**6
    assert {r["node"]: r["defaults"] for r in folded.collect()}["output"] == {"surface": [6.0]}
    needed = shadergraph.reachable(nodes, edges)
    assert "Broadcast" not in plan(needed) and needed.count() == 7


def test_closures(spark):
    nodes = [("g", "m", "mix_closure", {}, {"fac": [0.25]}), ("g", "a", "a_bsdf", {}, {}), ("g", "b", "b_bsdf", {}, {}), ("g", "output", "output", {}, {})]
    edges = [("g", "m", "closure", "output", "surface"), ("g", "a", "bsdf", "m", "closure1"), ("g", "b", "bsdf", "m", "closure2")]
    found = closures.lobes(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    points = spark.createDataFrame([("g", 0.9)], "graph string, r double")
    picked = closures.pick(points, found, "r")
    values = spark.createDataFrame([("g", "a", 4.0, 1.0), ("g", "b", 8.0, 2.0)], "graph string, node string, value double, pdf double")
    both = closures.together(values, found, ["graph"])
    assert "Broadcast" not in plan(picked) + plan(both)
    assert picked.first()["node"] == "b" and both.first()["value"] == 5.0


def test_transforms(spark):
    n, unit = 40, [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    out = scene.compose(spark.createDataFrame([(i, i - 1 if i else None, unit) for i in range(n)], "node long, parent long, matrix array<double>"))
    assert size(out) < 10**6 and {r["node"]: r["matrix"][3] for r in out.collect()} == {i: i + 1.0 for i in range(n)}


def test_equal_rays_and_spheres_meet_once(spark):
    rays = spark.range(400).selectExpr("id AS ray", "double(id % 2) AS x", "0D AS y", "-5D AS z")
    balls = spark.range(300).selectExpr("id AS sphere", "double(id % 2) AS sx", "0D AS sy", "double(id % 3) AS sz", "0.6D AS r")
    every = spatial.sphere_hits(rays, balls, 2.0)
    mine, want = spatial.first_of_places(rays, balls, 2.0, 4), spatial.first_hits(every, 4)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect())) and every.count() == 400 * 150
    assert [f for f in mine.columns] == [f for f in want.columns] == ["ray", "sphere", "t", "nth"]
    # 2 places, 6 kinds of spheres and 4 copies of each: at most 48 pairs
    starts = rays.select("x", "y", "z").distinct()
    assert starts.count() == 2 and mine.count() == 1600
