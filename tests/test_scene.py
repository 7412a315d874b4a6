"""Scene sources and sinks on small files."""

import numpy as np
import pytest
from lumenframe.sources import scene
from pyspark.sql import functions as F

XML = """<cycles>
<shader name="floor">
  <checker_texture name="check" scale="2.0" />
  <checker_texture name="fine" scale="8.0" color1="1 0 0" />
  <background name="bg" strength="0.5" />
  <connect from="check Color" to="bg color" />
  <connect from="bg background" to="output surface" />
  <connect from="nothing out" to="output surface" />
  <connect from="check out" to="nowhere in" />
  <connect from="check" to="output surface" />
</shader>
<shader name="lamp"><emission name="e" strength="3" /><connect from="e emission" to="output surface" /></shader>
<mesh name="m" P="0 0 0  1 0 0  1 1 0  0 1 0,  2 2 2" verts="0 1 2 3 4 0 2 1 3 4 0" nverts="4 2 5" />
<mesh name="bare" />
</cycles>"""


@pytest.fixture
def path(tmp_path):
    (tmp_path / "scene.xml").write_text(XML)
    return str(tmp_path / "scene.xml")


def test_graphs_with_rejected_edges(spark, path):
    nodes, edges, rejected = scene.read_graphs(spark, path)
    assert {(r.graph, r.node, r.kind, tuple(sorted(r.params.items()))) for r in nodes.collect()} == {
        ("floor", "output", "output", ()), ("lamp", "output", "output", ()), ("floor", "check", "checker_texture", (("scale", "2.0"),)),
        ("floor", "fine", "checker_texture", (("color1", "1 0 0"), ("scale", "8.0"))), ("floor", "bg", "background_shader", (("strength", "0.5"),)), ("lamp", "e", "emission", (("strength", "3"),)),
    }
    assert {tuple(r) for r in edges.collect()} == {("floor", "check", "color", "bg", "color"), ("floor", "bg", "background", "output", "surface"), ("lamp", "e", "emission", "output", "surface")}
    assert {(r.source, r.reason) for r in rejected.collect()} == {("nothing out", "unknown source"), ("check out", "unknown target"), ("check", "not of the form node socket")}


def test_files_without_graphs_give_empty_tables(spark, tmp_path):
    (tmp_path / "none.xml").write_text("<cycles><mesh name='m' /></cycles>")
    assert all(d.isEmpty() for d in scene.read_graphs(spark, str(tmp_path / "none.xml")))


def test_meshes_and_fans(spark, path):
    meshes = scene.read_meshes(spark, path)
    got = {r.mesh: r for r in meshes.collect()}
    assert got["m"].points == [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [2, 2, 2]] and got["bare"].points == []
    assert sorted(tuple(r) for r in scene.fan(meshes).collect()) == [("m", 0, 0, 0, 1, 2), ("m", 0, 1, 0, 2, 3), ("m", 2, 0, 2, 1, 3), ("m", 2, 1, 2, 3, 4), ("m", 2, 2, 2, 4, 0)]


def test_nested_transforms(spark):
    rnd = np.random.default_rng(3)
    own = {f"s{i}": rnd.normal(size=(3, 4)) for i in range(9)}
    rows = [(n, None if i == 0 else f"s{i - 1}", m.ravel().tolist()) for i, (n, m) in enumerate(own.items())] + [("stray", "nobody", [float(x) for x in (1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7)])]
    got = {r.node: r.matrix for r in scene.compose(spark.createDataFrame(rows, "node string, parent string, matrix array<double>")).collect()}
    whole = np.eye(4)
    for n, m in own.items():
        whole = whole @ np.vstack([m, [0, 0, 0, 1]])
        assert got[n] == pytest.approx(whole[:3].ravel().tolist())
    assert got["stray"] == [1.0, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7]


def test_written_nodes_come_back_without_what_is_usual(spark, tmp_path):
    nodes = spark.createDataFrame([("g", "a", "noise", {"scale": "2", "note": "<&\"'>"}), ("g", "b", "noise", {"scale": "5"}), ("h", "a", "mix", {})], "graph string, node string, kind string, params map<string,string>")
    usual = spark.createDataFrame([("noise", "scale", "5")], "kind string, param string, value string")
    scene.write_graphs(nodes, str(tmp_path / "out"), usual)
    got = {(r.graph, r.node): (r.kind, r.params) for r in scene.read_nodes(spark, str(tmp_path / "out")).collect()}
    assert got == {("g", "a"): ("noise", {"scale": "2", "note": "<&\"'>"}), ("g", "b"): ("noise", {}), ("h", "a"): ("mix", {})}


def test_tiles_that_are_missing_are_zero(spark, tmp_path):
    pixels = spark.range(6).select("id", (F.col("id") * 1.5).alias("value"))
    scene.write_tiles(pixels, str(tmp_path / "t"), (F.col("id") % 3).cast("int"))
    index = spark.range(8).select("id", (F.col("id") % 4).cast("int").alias("tile"))
    got = {r.id: r.value for r in scene.read_tiles(spark, str(tmp_path / "t"), index, ["id"]).collect()}
    assert got == {0: 0.0, 1: 1.5, 2: 3.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}


def test_nulls_in_tiles_stay(spark, tmp_path):
    pixels = spark.createDataFrame([(1, 0, None, "a"), (2, 0, 5.0, None)], "id long, tile int, value double, word string")
    scene.write_tiles(pixels.drop("tile"), str(tmp_path / "t"), F.lit(0))
    index = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, tile int")
    got = {r.id: (r.value, r.word) for r in scene.read_tiles(spark, str(tmp_path / "t"), index, ["id"]).collect()}
    assert got == {1: (None, "a"), 2: (5.0, None), 3: (0.0, None)}


def test_a_state_in_itself(spark, monkeypatch):
    monkeypatch.setattr(scene, "ROUNDS", 3)
    one = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    with pytest.raises(ValueError, match="itself"):
        scene.compose(spark.createDataFrame([("a", "b", one), ("b", "a", one)], "node string, parent string, matrix array<double>"))


def test_odd_parameters_come_back(spark, tmp_path):
    nodes = [("g", "n", "math", {"a": '<&>"', "b": "", "c": "it's"}), ("g", "m", "value", {})]
    scene.write_graphs(spark.createDataFrame(nodes, "graph string, node string, kind string, params map<string,string>"), str(tmp_path / "x"))
    got = {r.node: r.params for r in scene.read_nodes(spark, str(tmp_path / "x")).collect()}
    assert got["m"] == {} and got["n"]["a"] == '<&>"' and got["n"]["c"] == "it's"
    (tmp_path / "y.xml").write_text('<graphs><node _="" graph="g" name="n" kind="k"><param name="a" value="1"/><param name="b" value="2"/><param name="a" value="3"/></node></graphs>')
    assert [r.params for r in scene.read_nodes(spark, str(tmp_path / "y.xml")).collect()] == [{"a": "1", "b": "2"}]
    assert [tuple(r) for r in scene.read_doubled(spark, str(tmp_path / "y.xml")).collect()] == [("g", "n", "a", "3")]
