"""Scene descriptions in XML: expression graphs, meshes and nested transforms as tables, and back.

Spark's XML source splits files by element, so a table of many files or of one long file is read in parallel. One element
(a graph or a mesh) is one row and has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StructType
from pyspark.sql.window import Window

from lumenframe.operators.lineage import settled

#: Fixed names of the format: kinds that are called otherwise in a graph, and the node that every graph has.
RENAMED = {"background": "background_shader"}
ROOT = "output"
NODES = "node:string,kind:string,params:map<string,string>"


def _elements(spark: SparkSession, paths: str | list[str], tag: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, attributePrefix="_", valueTag="_text", inferSchema="false").load(paths)


def _many(d: DataFrame, name: str) -> Column:
    # a child that occurs once is a struct, one that occurs more often an array of structs
    one = not isinstance(d.schema[name].dataType, ArrayType)
    return F.when(F.col(name).isNotNull(), F.array(name)) if one else F.col(name)


def _attributes(d: DataFrame, name: str) -> list[str]:
    kind = d.schema[name].dataType
    kind = kind.elementType if isinstance(kind, ArrayType) else kind
    return [f.name for f in kind.fields if f.name.startswith("_")] if isinstance(kind, StructType) else []


def _node(kind: str, given: list[str]) -> Callable[[Column], Column]:
    # from an element to (node, kind, params); attributes that it lacks are no parameters
    def of(s: Column) -> Column:
        pairs = [x for a in given for x in (F.lit(a[1:]), s[a])]
        params = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        return F.struct(s["_name"].alias("node"), F.lit(kind).alias("kind"), params.alias("params"))

    return of


def read_graphs(spark: SparkSession, paths: str | list[str], tag: str = "shader") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejected) of all elements `tag`: nodes are (graph, node, kind, params), with an "output" for each graph.

    A child element is a node, its name the kind, and its attributes the parameters; `connect` elements are edges, "node
    socket" to "node socket", socket names in lower case. An edge of another form or with an end that its graph does not
    have is not an edge but a row of rejected, with the reason. An unnamed graph has a null name and loses its edges to
    rejected. Files without such elements give empty tables.
    """
    d = _elements(spark, paths, tag)
    if "_name" not in d.columns:
        d = d.withColumn("_name", F.lit(None).cast("string"))
    kinds = [c for c in d.columns if not c.startswith("_") and c != "connect" and "_name" in _attributes(d, c)]
    parts = [F.coalesce(F.transform(_many(d, c), _node(RENAMED.get(c, c), [a for a in _attributes(d, c) if a != "_name"])), F.array().cast(f"array<struct<{NODES}>>")) for c in kinds]
    root = F.array(F.struct(F.lit(ROOT).alias("node"), F.lit(ROOT).alias("kind"), F.create_map().cast("map<string,string>").alias("params")))
    nodes = d.select(F.col("_name").alias("graph"), F.explode(F.concat(root, *parts)).alias("n")).select("graph", "n.*")
    if "connect" not in d.columns:
        links = spark.createDataFrame([], "graph string, source string, target string")
    else:
        links = d.select(F.col("_name").alias("graph"), F.explode(_many(d, "connect")).alias("c")).select("graph", *(F.col(f"c.{a}").alias(n) if a in _attributes(d, "connect") else F.lit(None).cast("string").alias(n) for a, n in (("_from", "source"), ("_to", "target"))))
    words = lambda c: F.split(F.trim(F.col(c)), r"\s+")
    links = links.withColumn("s", words("source")).withColumn("t", words("target"))
    for end, prefix in (("s", "from"), ("t", "to")):
        links = links.withColumn(f"{prefix}_node", F.get(end, F.lit(0))).withColumn(f"{prefix}_socket", F.lower(F.get(end, F.lit(1))))
        known = nodes.select("graph", F.col("node").alias(f"{prefix}_node"), F.lit(True).alias(f"{prefix}_known")).distinct()
        links = links.join(known, ["graph", f"{prefix}_node"], "left")
    formed = (F.size("s") == 2) & (F.size("t") == 2)
    reason = F.when(~F.coalesce(formed, F.lit(False)), "not of the form node socket").when(F.col("from_known").isNull(), "unknown source").when(F.col("to_known").isNull(), "unknown target")
    links = links.withColumn("reason", reason)
    edges = links.where("reason IS NULL").select("graph", "from_node", "from_socket", "to_node", "to_socket")
    return nodes, edges, links.where("reason IS NOT NULL").select("graph", "source", "target", "reason")


def write_graphs(nodes: DataFrame, path: str, defaults: DataFrame | None = None) -> None:
    """Nodes as XML, an element `node` a row; parameters that equal the kind's own in defaults (kind, param, value) are left out."""
    flat = nodes.select("graph", "node", "kind", F.explode_outer("params").alias("param", "value"))
    if defaults is not None:
        usual = defaults.select("kind", "param", F.col("value").alias("usual"))
        flat = flat.join(usual, ["kind", "param"], "left").withColumn("param", F.when(~F.col("value").eqNullSafe(F.col("usual")) | F.col("usual").isNull(), F.col("param")))
    pair = F.struct(F.col("param").alias("_name"), F.col("value").alias("_value"))
    packed = flat.groupBy("graph", "node", "kind").agg(F.array_sort(F.collect_list(F.when(F.col("param").isNotNull(), pair))).alias("param"))
    packed.select(F.col("graph").alias("_graph"), F.col("node").alias("_name"), F.col("kind").alias("_kind"), "param").write.format("xml").options(rootTag="graphs", rowTag="node").mode("errorifexists").save(path)


def _node_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = "_graph string, _name string, _kind string, param array<struct<_name:string,_value:string>>"
    return spark.read.format("xml").schema(schema).options(rowTag="node").load(path)


def read_doubled(spark: SparkSession, path: str) -> DataFrame:
    """(graph, node, param, value): the parameters that read_nodes leaves out, since their node has one of that name before or they have none."""
    rows = _node_rows(spark, path).select(F.col("_graph").alias("graph"), F.col("_name").alias("node"), "param", F.posexplode("param").alias("at", "p"))
    earlier = F.exists(F.slice("param", F.lit(1), F.col("at")), lambda q: q["_name"] == F.col("p._name"))
    return rows.where(F.col("p._name").isNull() | F.coalesce(earlier, F.lit(False))).select("graph", "node", F.col("p._name").alias("param"), F.col("p._value").alias("value"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """What write_graphs wrote, as nodes; their types are given, so no pass over the files infers them.

    Of parameters of one name in a node the first stays, and those without a name leave; `read_doubled` has these.
    """
    d = _node_rows(spark, path)
    first = F.filter("param", lambda p, i: p["_name"].isNotNull() & (F.array_position(F.transform("param", lambda q: F.coalesce(q["_name"], F.lit(""))), p["_name"]) == i + 1))
    entries = F.transform(first, lambda p: F.struct(p["_name"].alias("key"), p["_value"].alias("value")))
    params = F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>"))
    return d.select(F.col("_graph").alias("graph"), F.col("_name").alias("node"), F.col("_kind").alias("kind"), params.alias("params"))


def read_meshes(spark: SparkSession, paths: str | list[str], tag: str = "mesh") -> DataFrame:
    """(mesh, points array<array<double>>, verts, nverts, subdivision) of all mesh elements; what a mesh lacks is an empty array or null."""
    d = spark.read.format("xml").schema("_name string, _P string, _verts string, _nverts string, _subdivision string").options(rowTag=tag).load(paths)
    split = lambda c, kind: F.coalesce(F.filter(F.split(F.col(c), r"[\s,]+"), lambda x: x != "").cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    d = d.select(F.col("_name").alias("mesh"), split("_P", "double").alias("p"), split("_verts", "int").alias("verts"), split("_nverts", "int").alias("nverts"), F.col("_subdivision").alias("subdivision"))
    points = F.expr("CASE WHEN size(p) < 3 THEN array() ELSE transform(sequence(0, size(p) div 3 - 1), i -> slice(p, 3 * i + 1, 3)) END")
    return d.select("mesh", points.alias("points"), "verts", "nverts", "subdivision")


def fan(meshes: DataFrame) -> DataFrame:
    """(mesh, face, nth, v0, v1, v2): faces of nverts corners, listed one after the other in verts, as fans of triangles.

    Faces of fewer than three corners have no triangle, but their corners count. Faces and corners are rows of their own;
    only the running totals of one mesh's faces, which came as one row, meet in a task.
    """
    faces = meshes.select("mesh", F.posexplode("nverts").alias("face", "n"))
    before = F.sum("n").over(Window.partitionBy("mesh").orderBy("face").rowsBetween(Window.unboundedPreceding, -1))
    faces = faces.withColumn("first", F.coalesce(before, F.lit(0)).cast("int")).where("n >= 3")
    corners = faces.select("mesh", "face", "first", F.explode(F.expr("sequence(0, n - 1)")).alias("k")).withColumn("at", F.col("first") + F.col("k"))
    verts = meshes.select("mesh", F.posexplode("verts").alias("at", "v"))
    rings = corners.join(verts, ["mesh", "at"]).groupBy("mesh", "face").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("ring"))
    rows = rings.where(F.size("ring") >= 3).select("mesh", "face", "ring", F.explode(F.expr("sequence(0, size(ring) - 3)")).alias("nth"))
    at = lambda i: F.get("ring", i)
    return rows.select("mesh", "face", "nth", at(F.lit(0)).alias("v0"), at(F.col("nth") + 1).alias("v1"), at(F.col("nth") + 2).alias("v2"))


#: Rounds after which a nest of 2^40 levels would be done.
ROUNDS = 40
#: Product of two transforms of three rows and four columns.
PRODUCT = "transform(sequence(0, 11), k -> {a}[k div 4 * 4] * {b}[k % 4] + {a}[k div 4 * 4 + 1] * {b}[4 + k % 4] + {a}[k div 4 * 4 + 2] * {b}[8 + k % 4] + IF(k % 4 = 3, {a}[k], 0D))"


def compose(states: DataFrame) -> DataFrame:
    """(node, matrix): each state's own matrix after those of all states that it lies in.

    states are (node, parent, matrix array<double> of 12), parent null at the top. Each round joins a state with the one
    as many levels up again, so a nest of n levels takes log n rounds; a parent that does not exist counts as the top. A
    state that lies in itself is an error: ROUNDS are enough for any nest.
    """
    at = settled(states.select("node", F.col("parent").alias("up"), "matrix"), "states")
    for _ in range(ROUNDS):
        if at.where("up IS NOT NULL").isEmpty():
            return at.select("node", "matrix")
        above = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("matrix").alias("over"))
        joined = at.join(above, "up", "left")
        at = settled(joined.select("node", F.col("next").alias("up"), F.when(F.col("over").isNull(), F.col("matrix")).otherwise(F.expr(PRODUCT.format(a="over", b="matrix"))).alias("matrix")), "states")
    raise ValueError("a state lies in itself")


def write_tiles(pixels: DataFrame, path: str, tile: Column) -> None:
    """Pixels as Parquet, a folder a tile: what a later run writes of other tiles goes beside it."""
    pixels.withColumn("tile", tile).write.partitionBy("tile").mode("append").parquet(path)


def read_tiles(spark: SparkSession, path: str, index: DataFrame, on: Iterable[str]) -> DataFrame:
    """Every pixel of the index (tile and the columns `on`); numbers of pixels that no tile file holds are 0. A null that was written stays null."""
    d = spark.read.parquet(path).withColumn("__held", F.lit(True))
    keys = [*on, "tile"]
    numbers = {f.name for f in d.schema.fields if isinstance(f.dataType, NumericType)} - set(keys)
    out = index.join(d, keys, "left")
    return out.select(*[F.when(F.col("__held").isNull(), F.lit(0).cast(out.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in numbers else F.col(c) for c in out.columns if c != "__held"])
