"""Folding by open nodes: the sockets of all nodes are written once, and chains of nodes that are passed by."""

from lumenframe.operators import shadergraph

NODES = "graph string, node string, kind string, params map<string,string>, defaults map<string,array<double>>"
EDGES = "graph string, from_node string, from_socket string, to_node string, to_socket string"


def test_chains_that_are_passed_by_and_levels(spark, monkeypatch):
    math = lambda name, kind, **d: ("g", name, "math", {"math_type": kind}, d)
    nodes = [("g", "output", "output", {}, {"keep": [7.0]}), ("g", "seen", "attribute", {}, {}), ("g", "tint", "color", {}, {"color": [1.0, 2.0, 3.0]}), math("a", "add", value2=[0.0]), math("b", "multiply", value2=[1.0]), math("c", "add", value2=[0.0]), math("zero", "multiply", value2=[0.0]), math("late", "add"), *(math(f"n{i}", "add", value2=[1.0]) for i in range(4)), ("g", "n", "value", {}, {"value": [2.0]})]
    link = lambda a, s, b, t: ("g", a, s, b, t)
    edges = [link("tint", "color", "a", "value1"), link("a", "value", "b", "value1"), link("b", "value", "output", "one"), link("seen", "fac", "c", "value1"), link("c", "value", "output", "two"), link("seen", "fac", "zero", "value1"), link("zero", "value", "late", "value1"), link("seen", "fac", "late", "value2"), link("late", "value", "output", "three"), link("tint", "other", "output", "four")]
    edges += [link("n" if not i else f"n{i - 1}", "value", f"n{i}", "value1") for i in range(4)] + [link("n3", "value", "output", "five")]
    writes, write = [], shadergraph._write
    monkeypatch.setattr(shadergraph, "_write", lambda *d: writes.append(d) or write(*d))
    folded, left = shadergraph.fold(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    got = {r["node"]: r["defaults"] for r in folded.collect()}
    assert got["output"] == {"keep": [7.0], "one": [1.0, 2.0, 3.0], "five": [6.0]} and got["late"] == {"value1": [0.0]} and len(got) == len(nodes)
    ends = {(r["from_node"], r["from_socket"], r["to_node"], r["to_socket"]) for r in left.collect()}
    assert {e for e in ends if e[2] == "output"} == {("seen", "fac", "output", "two"), ("seen", "fac", "output", "three"), ("tint", "other", "output", "four")}
    assert len(writes) == 1  # sockets of all nodes are written once, not at each level
