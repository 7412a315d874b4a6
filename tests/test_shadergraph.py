"""Graph passes on small graphs whose results are known, and on random graphs against plain Python."""

import random

import pytest
from lumenframe.operators import shadergraph as sg

NODES = "graph string, node string, kind string, params map<string,string>, defaults map<string,array<double>>"
EDGES = "graph string, from_node string, from_socket string, to_node string, to_socket string"
C = [0.3, 0.5, 0.7]


def line(start, end, steps):
    """Entries from start to end, interleaved."""
    return [a + (b - a) * i / (steps - 1) for i in range(steps) for a, b in zip(start, end, strict=True)]


CURVE = {"curves": line([0, 0.25, 1], [1, 0.75, 0], 257), "min_x": [0.1], "max_x": [0.9]}
RAMP = {"ramp": line([0, 0.25, 0.5], [0.25, 0.5, 0.75], 9), "ramp_alpha": line([0.75], [1], 9), "fac": [0.56]}
#: Graph, kind, params, defaults, result socket, result: known constants of the graph tests.
KNOWN = [
    ("invert", {}, {"fac": [0.8], "color": [0.2, 0.5, 0.8]}, "color", [0.68, 0.5, 0.32]),
    ("mix", {"mix_type": "add"}, {"fac": [0.8], "color1": C, "color2": [0.4, 0.8, 0.9]}, "color", [0.62, 1.14, 1.42]),
    ("mix", {"mix_type": "add", "use_clamp": "true"}, {"fac": [0.8], "color1": C, "color2": [0.4, 0.8, 0.9]}, "color", [0.62, 1, 1]),
    ("gamma", {}, {"color": C, "gamma": [1.5]}, "color", [0.164317, 0.353553, 0.585662]),
    ("brightness_contrast", {}, {"color": C, "bright": [0.1], "contrast": [1.2]}, "color", [0.16, 0.6, 1.04]),
    ("math", {"math_type": "add"}, {"value1": [0.7], "value2": [0.9]}, "value", [1.6]),
    ("math", {"math_type": "add", "use_clamp": "true"}, {"value1": [0.7], "value2": [0.9]}, "value", [1]),
    ("separate_color", {}, {"color": C}, "g", [0.5]),
    ("combine_color", {}, {"r": [0.3], "g": [0.5], "b": [0.7]}, "color", C),
    ("rgb_curves", {}, CURVE | {"fac": [0.5], "color": C}, "color", [0.275, 0.5, 0.475]),
    ("rgb_curves", {}, CURVE | {"fac": [0.0], "color": C}, "color", C),
    ("vector_curves", {}, CURVE | {"fac": [0.5], "vector": C}, "vector", [0.275, 0.5, 0.475]),
    ("vector_curves", {}, CURVE | {"fac": [1.0], "vector": [1.3, 0.5, -0.1]}, "vector", [1.5, 0.5, 1.25]),
    ("vector_curves", {"extrapolate": "false"}, CURVE | {"fac": [1.0], "vector": [1.3, 0.5, -0.1]}, "vector", [1, 0.5, 1]),
    ("float_curve", {}, {"curve": [0.0, 1.0, 0.0], "fac": [1.0], "value": [0.25]}, "value", [0.5]),
    ("rgb_ramp", {"interpolate": "true"}, RAMP, "color", [0.14, 0.39, 0.64]),
    ("rgb_ramp", {"interpolate": "true"}, RAMP, "alpha", [0.89]),
    ("rgb_ramp", {"interpolate": "false"}, RAMP, "color", [0.125, 0.375, 0.625]),
    ("rgb_ramp", {"interpolate": "false"}, RAMP, "alpha", [0.875]),
    ("combine_xyz", {}, {"x": [0.3], "y": [0.5], "z": [0.7]}, "vector", C),
    ("separate_xyz", {}, {"vector": C}, "z", [0.7]),
    ("clamp", {"clamp_type": "minmax"}, {"value": [1.7], "min": [0.2], "max": [0.9]}, "result", [0.9]),
    ("clamp", {"clamp_type": "range"}, {"value": [0.1], "min": [0.9], "max": [0.2]}, "result", [0.2]),
    ("vector_math", {"math_type": "cross_product"}, {"vector1": [1.0, 0.0, 0.0], "vector2": [0.0, 1.0, 0.0]}, "vector", [0, 0, 1]),
    ("vector_math", {"math_type": "dot_product"}, {"vector1": C, "vector2": [1.0, 2.0, 3.0]}, "value", [3.4]),
    ("vector_math", {"math_type": "scale"}, {"vector1": C, "scale": [2.0]}, "vector", [0.6, 1.0, 1.4]),
]


def tables(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_known_constants_fold(spark):
    nodes, edges = [], []
    for i, (kind, params, defaults, socket, _) in enumerate(KNOWN):
        nodes += [(str(i), "n", kind, params, defaults), (str(i), "output", "output", {}, {})]
        edges.append((str(i), "n", socket, "output", "surface"))
    got, left = sg.fold(*tables(spark, nodes, edges))
    assert left.isEmpty()
    found = {r.graph: r.defaults["surface"] for r in got.where("node = 'output'").collect()}
    for i, (*_, want) in enumerate(KNOWN):
        assert found[str(i)] == pytest.approx(want, abs=1e-6), KNOWN[i]


def test_chains_fold_and_partly_known_nodes_are_passed_or_set(spark):
    out = ("g", "output", "output", {}, {})
    nodes = [("g", "a", "value", {}, {"value": [2.0]}), ("g", "b", "math", {"math_type": "multiply"}, {"value2": [3.0]}), ("g", "c", "math", {"math_type": "subtract"}, {"value2": [1.0]}), out]
    nodes += [("g", "unknown", "attribute", {}, {}), ("g", "same", "math", {"math_type": "add"}, {"value2": [0.0]}), ("g", "again", "math", {"math_type": "multiply"}, {"value1": [1.0]}), ("g", "zero", "math", {"math_type": "multiply"}, {"value1": [0.0]}), ("g", "one", "math", {"math_type": "power"}, {"value1": [1.0]})]
    edges = [("g", "a", "value", "b", "value1"), ("g", "b", "value", "c", "value1"), ("g", "c", "value", "output", "x")]
    edges += [("g", "unknown", "fac", "same", "value1"), ("g", "same", "value", "again", "value2"), ("g", "again", "value", "output", "y"), ("g", "unknown", "fac", "zero", "value2"), ("g", "zero", "value", "output", "z"), ("g", "unknown", "fac", "one", "value2"), ("g", "one", "value", "output", "w")]
    got, left = sg.finalise(*tables(spark, nodes, edges))
    assert {tuple(r) for r in left.collect()} == {("g", "unknown", "fac", "output", "y")}
    assert {r.node for r in got.collect()} == {"output", "unknown"}
    assert {k: v[0] for k, v in got.where("node = 'output'").first().defaults.items()} == {"x": 5.0, "z": 0.0, "w": 1.0}


def test_equal_nodes_merge_level_by_level(spark):
    nodes = [("g", n, "noise", {"d": "3"}, {"scale": [s]}) for n, s in (("n1", 2.0), ("n2", 2.0), ("n3", 4.0))]
    nodes += [("g", f"m{i}", "math", {"math_type": "sine"}, {"value1": [float(i)]}) for i in (1, 2, 3)] + [("g", "output", "output", {}, {})]
    edges = [("g", f"n{i}", "fac", f"m{i}", "value1") for i in (1, 2, 3)] + [("g", f"m{i}", "value", "output", f"s{i}") for i in (1, 2, 3)]
    got, left, merged = sg.deduplicate(*tables(spark, nodes, edges))
    # the defaults of m1 and m2 differ, but their socket is linked
    assert {(r.node, r["into"]) for r in merged.collect()} == {("n2", "n1"), ("m2", "m1")}
    assert {(r.from_node, r.to_socket) for r in left.where("to_node = 'output'").collect()} == {("m1", "s1"), ("m1", "s2"), ("m3", "s3")}
    assert got.count() == 5


def _on_a_cycle(pairs, edge):
    seen, stack = set(), [edge[1]]
    while stack:
        x = stack.pop()
        if x == edge[0]:
            return True
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                stack.append(b)
    return False


def test_cycles_break_and_only_edges_on_cycles_go(spark):
    rnd = random.Random(5)
    pairs = {f"g{i}": sorted({(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(11)}) for i in range(4)} | {"loop": [("a", "a"), ("a", "b"), ("b", "c"), ("c", "b")], "tree": [("a", "b"), ("a", "c"), ("b", "c")]}
    edges = [(g, a, "out", b, f"in_{a}") for g, ps in pairs.items() for a, b in ps]
    left, gone = sg.break_cycles(tables(spark, [], edges)[1])
    left, gone = ({(r.graph, r.from_node, r.to_node) for r in d.collect()} for d in (left, gone))
    assert left | gone == {(g, a, b) for g, ps in pairs.items() for a, b in ps} and not left & gone
    assert {g for g, *_ in gone} and not [x for x in gone if x[0] == "tree"]
    for g, ps in pairs.items():
        kept = [(a, b) for k, a, b in left if k == g]
        assert not any(_on_a_cycle(kept, e) for e in kept)
        assert all(_on_a_cycle(ps, (a, b)) for k, a, b in gone if k == g)


def test_empty_tables_give_empty_tables(spark):
    nodes, edges = tables(spark, [], [])
    got, left = sg.finalise(nodes, edges)
    assert got.isEmpty() and left.isEmpty() and got.columns == nodes.columns and left.columns == edges.columns


def test_curves_without_a_table_or_effect(spark):
    nodes = [("0", "a", "attribute", {}, {}), ("0", "n", "rgb_curves", {}, CURVE | {"fac": [0.0]}), ("0", "output", "output", {}, {}), ("1", "n", "rgb_curves", {}, {"fac": [0.5], "color": C}), ("1", "m", "rgb_ramp", {}, RAMP | {"ramp_alpha": [1.0]}), ("1", "output", "output", {}, {})]
    edges = [("0", "a", "color", "n", "color"), ("0", "n", "color", "output", "surface"), ("1", "n", "color", "output", "surface"), ("1", "m", "color", "output", "volume")]
    _, left = sg.fold(*tables(spark, nodes, edges))
    assert sorted(map(tuple, left.collect())) == [("0", "a", "color", "n", "color"), ("0", "a", "color", "output", "surface"), ("1", "m", "color", "output", "volume"), ("1", "n", "color", "output", "surface")]
