"""Queries of expression graphs, meshes, transforms and scene files over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import shadergraph
from lumenframe.operators.lineage import shared_path
from lumenframe.sources import scene

EMPTY, PARAMS, DEFAULTS = "map()", "map<string,string>", "map<string,array<double>>"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(name: str, kind: str, params: str = EMPTY, defaults: str = EMPTY) -> str:
    return f"named_struct('node', {name}, 'kind', {kind}, 'params', CAST({params} AS {PARAMS}), 'defaults', CAST({defaults} AS {DEFAULTS}))"


def _edge(source: str, out: str, target: str, into: str) -> str:
    return f"named_struct('from_node', {source}, 'from_socket', {out}, 'to_node', {target}, 'to_socket', {into})"


def _rows(d: DataFrame, graph: str, structs: list[str]) -> DataFrame:
    return d.selectExpr(f"CAST({graph} AS STRING) AS graph", f"inline(array({', '.join(structs)}))")


def graph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph a part, half of size plus price and three times nothing, folded into the sockets of its output."""
    part = _table(spark, sf_dir, "part")
    op = lambda name, kind, value2: _node(f"'{name}'", "'math'", f"map('math_type', '{kind}')", f"map('value2', array({value2}))")
    nodes = [_node("'size'", "'value'", EMPTY, "map('value', array(p_size))"), op("sum", "add", "p_retailprice"), op("half", "multiply", "0.5"), _node("'seen'", "'attribute'"), op("none", "multiply", "0.0"), _node("'output'", "'output'")]
    edges = [_edge("'size'", "'value'", "'sum'", "'value1'"), _edge("'sum'", "'value'", "'half'", "'value1'"), _edge("'half'", "'value'", "'output'", "'surface'"), _edge("'seen'", "'fac'", "'none'", "'value1'"), _edge("'none'", "'value'", "'output'", "'volume'")]
    nodes, _ = shadergraph.fold(_rows(part, "p_partkey", nodes), _rows(part, "p_partkey", edges))
    return nodes.where("node = 'output'").select(F.col("graph").cast("long").alias("part"), F.round(F.col("defaults")["surface"][0], 4).alias("surface"), F.col("defaults")["volume"][0].alias("volume"))


def graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph a brand, whose parts are a node of their type that feeds one of their size: nodes merged into the first equal one."""
    part = _table(spark, sf_dir, "part").withColumn("k", F.format_string("%012d", "p_partkey"))
    nodes = _rows(part, "p_brand", [_node("concat('a', k)", "'noise'", "map('type', p_type)"), _node("concat('b', k)", "'math'", EMPTY, "map('value2', array(p_size))")])
    edges = _rows(part, "p_brand", [_edge("concat('a', k)", "'fac'", "concat('b', k)", "'value1'"), _edge("concat('b', k)", "'value'", "'output'", "concat('in', k)")])
    return shadergraph.deduplicate(nodes, edges)[2].select(F.col("graph").alias("brand"), "node", "into")


def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that customer 1 needs, each needing those twice and thrice its number."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node"), "c_custkey")
    edges = _rows(c, "0", [_edge(f"CAST(c_custkey * {n} AS STRING)", "'out'", "node", f"'in{n}'") for n in (2, 3)])
    return shadergraph.reachable(c.select(F.lit("0").alias("graph"), "node"), edges, "1").select(F.col("node").cast("long").alias("customer"))


def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, each leading to one other: the links taken out so that no cycle stays."""
    s = _table(spark, sf_dir, "supplier").select(F.format_string("%012d", "s_suppkey").alias("a"), F.format_string("%012d", F.col("s_suppkey") * F.col("s_suppkey") % 61 + 1).alias("b"))
    gone = shadergraph.break_cycles(_rows(s, "0", [_edge("a", "'out'", "b", "a")]))[1]
    return gone.select(F.col("from_node").cast("long").alias("source"), F.col("to_node").cast("long").alias("target"))


def mesh_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh a customer, a face an order, a corner a line: its triangles."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_partkey").cast("int"))).alias("corners"))
    faces = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("mesh")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "corners"))).alias("f"))
    meshes = faces.select("mesh", F.flatten("f.corners").alias("verts"), F.transform("f.corners", F.size).alias("nverts"))
    return scene.fan(meshes)


def transform_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lie in the part of half their number, each moved by its size along x and scaled by two along y."""
    own = F.expr("array(1D, 0D, 0D, CAST(p_size AS DOUBLE), 0D, IF(p_partkey < 100, 2D, 1D), 0D, 0D, 0D, 0D, 1D, 0D)")
    states = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey div 2 END").alias("parent"), own.alias("matrix"))
    return scene.compose(states).select(F.col("node").alias("part"), F.get("matrix", F.lit(3)).alias("x"), F.get("matrix", F.lit(5)).alias("y_scale"))


def scene_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as XML nodes, without sizes of 7, which are usual, and read back."""
    part = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("graph"), F.col("p_partkey").cast("string").alias("node"), F.lit("part").alias("kind"), F.expr("map('type', p_type, 'size', CAST(p_size AS STRING))").alias("params"))
    usual = spark.createDataFrame([("part", "size", "7")], "kind string, param string, value string")
    path = shared_path(spark, "scene")
    scene.write_graphs(part, path, usual)
    return scene.read_nodes(spark, path).select("graph", F.col("node").cast("long").alias("part"), "kind", F.col("params")["type"].alias("type"), F.col("params")["size"].alias("size"))


def tile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit written as pixels, a tile a nation, and all customers read back, 0 where nothing was written."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    path = shared_path(spark, "tiles")
    scene.write_tiles(c.where("c_acctbal > 0").select("c_custkey", "c_acctbal", "c_nationkey").withColumnRenamed("c_nationkey", "n"), path, F.col("n"))
    return scene.read_tiles(spark, path, c.select("c_custkey", F.col("c_nationkey").alias("tile")), ["c_custkey"]).select("c_custkey", "tile", "c_acctbal")


NATIVE = (graph_fold, graph_dedup, graph_reach, graph_cycles, mesh_fan, transform_stack, scene_roundtrip, tile_roundtrip)
SQL = {
    "graph_fold": "SELECT p_partkey AS part, round((p_size + p_retailprice) * 0.5, 4) AS surface, CAST(0 AS DOUBLE) AS volume FROM part",
    "graph_dedup": "WITH p AS (SELECT p_brand AS brand, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS k, p_type, p_size FROM part), n AS (SELECT brand, 'a' || k AS node, 'a' || min(k) OVER (PARTITION BY brand, p_type) AS into_ FROM p UNION ALL SELECT brand, 'b' || k AS node, 'b' || min(k) OVER (PARTITION BY brand, p_type, p_size) AS into_ FROM p) SELECT brand, node, into_ AS \"into\" FROM n WHERE node <> into_",
    "graph_reach": "WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS customer UNION SELECT customer * n AS customer FROM r, (VALUES (2), (3)) AS v(n) WHERE customer * n <= (SELECT max(c_custkey) FROM customer)) SELECT customer FROM r WHERE customer IN (SELECT c_custkey FROM customer)",
    "graph_cycles": "WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey * s_suppkey % 61 + 1 AS b FROM supplier), r AS (SELECT a, b AS up FROM e UNION SELECT r.a, e.b AS up FROM r JOIN e ON r.up = e.a), c AS (SELECT a FROM r WHERE a = up), low AS (SELECT c.a, min(r.up) AS low FROM c JOIN r ON r.a = c.a GROUP BY c.a) SELECT e.a AS source, e.b AS target FROM e JOIN low ON e.a = low.a AND e.b = low.low",
    "mesh_fan": "WITH l AS (SELECT l_orderkey, CAST(l_partkey AS INTEGER) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS k FROM lineitem), f AS (SELECT o_custkey AS mesh, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS face FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT mesh, CAST(face AS INTEGER) AS face, CAST(b.k - 1 AS INTEGER) AS nth, a.v AS v0, b.v AS v1, c.v AS v2 FROM f JOIN l AS a ON a.l_orderkey = o_orderkey AND a.k = 0 JOIN l AS b ON b.l_orderkey = o_orderkey AND b.k > 0 JOIN l AS c ON c.l_orderkey = o_orderkey AND c.k = b.k + 1",
    "transform_stack": "WITH RECURSIVE s AS (SELECT p_partkey, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS up, CAST(p_size AS DOUBLE) AS x, CASE WHEN p_partkey < 100 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS y FROM part), r AS (SELECT p_partkey AS part, up, x, y FROM s UNION ALL SELECT r.part, s.up, r.x + s.x AS x, r.y * s.y AS y FROM r JOIN s ON s.p_partkey = r.up) SELECT part, x, y AS y_scale FROM r WHERE up IS NULL",
    "scene_roundtrip": "SELECT p_brand AS graph, p_partkey AS part, 'part' AS kind, p_type AS type, CASE WHEN p_size <> 7 THEN CAST(p_size AS VARCHAR) END AS size FROM part",
    "tile_roundtrip": "SELECT c_custkey, c_nationkey AS tile, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS c_acctbal FROM customer",
}
