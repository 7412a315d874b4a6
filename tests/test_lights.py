"""The tree of lights against plain Python: bounds, chances, picks and their probabilities."""

import math

import numpy as np
import pytest
from lumenframe.operators import lights

LIGHTS = "light long, x double, y double, z double, radius double, energy double, ax double, ay double, az double, theta_o double, theta_e double"
POINTS = "point long, px double, py double, pz double, nx double, ny double, nz double, r double"


def unit(v):
    return v / np.linalg.norm(v)


def merge(a, b):
    w, n = (b, a) if b["o"] > a["o"] else (a, b)
    out = {"energy": a["energy"] + b["energy"], "lo": np.minimum(a["lo"], b["lo"]), "hi": np.maximum(a["hi"], b["hi"]), "e": max(a["e"], b["e"])}
    c = min(1.0, max(-1.0, float(w["axis"] @ n["axis"])))
    d = math.acos(c)
    if w["o"] + 5e-4 >= min(math.pi, d + n["o"]):
        return out | {"axis": w["axis"], "o": w["o"]}
    o = (d + w["o"] + n["o"]) / 2
    if o >= math.pi:
        return out | {"axis": w["axis"], "o": math.pi}
    if c < -0.9995:
        k = int(np.argmin(np.abs(w["axis"])))
        return out | {"axis": unit(np.eye(3)[k] - w["axis"][k] * w["axis"]), "o": o}
    return out | {"axis": w["axis"] * math.cos(o - w["o"]) + unit(n["axis"] - w["axis"] * c) * math.sin(o - w["o"]), "o": o}


def importance(p, n, b):
    mid, half = (b["lo"] + b["hi"]) / 2, (b["hi"] - b["lo"]) / 2
    v, rr = mid - p, float(half @ half)
    dd = float(v @ v)
    if n @ v + np.abs(n) @ half <= 0:
        return 0.0, 0.0
    theta_u = math.pi if dd <= rr else math.asin(math.sqrt(rr / dd))
    theta_i, theta = math.acos(max(-1, min(1, n @ v / math.sqrt(dd)))), math.acos(max(-1, min(1, -(b["axis"] @ v) / math.sqrt(dd))))
    near = max(theta_i - theta_u, 0)
    if math.cos(near) < 0:
        return 0.0, 0.0
    out = max(theta - b["o"] - theta_u, 0)
    if out >= b["e"] and out > 0:
        return 0.0, 0.0
    far = max(dd, rr / 4)
    most = abs(math.cos(near) * b["energy"] * math.cos(out) / far)
    worst = theta + b["o"] + theta_u
    if b["e"] < b["o"] or theta > math.pi / 2 or theta_u > math.pi / 2 or worst > b["e"]:
        return most, 0.0
    return most, abs(max(math.cos(theta_i + theta_u), 0) * b["energy"] * math.cos(worst) / far)


def chances(p, n, kids):
    both = [importance(p, n, b) for b in kids]
    most, least = sum(x for x, _ in both), sum(y for x, y in both if x > 0)
    some = sum(x > 0 for x, _ in both)
    return [(x / most + (y / least if least > 0 else 1 / some)) / 2 if x > 0 else 0.0 for x, y in both] if most else [0.0] * len(kids)


@pytest.fixture(scope="module")
def scene(spark):
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(150):
        axis = rnd.standard_normal(3)
        rows.append((i, *map(float, rnd.uniform(0, 5, 3)), float(rnd.choice([0.0, 0.2])), float(rnd.uniform(0.1, 4)), *map(float, axis), float(rnd.choice([0.0, 0.4, math.pi])), float(rnd.choice([0.7, math.pi / 2]))))
    rows += [(200, *rows[0][1:4], 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0), (201, None, *rows[0][2:])]
    points = [(i, *map(float, rnd.uniform(-1, 6, 3)), *map(float, unit(rnd.standard_normal(3))), float(rnd.random())) for i in range(60)]
    levels, ranks = lights.build(spark.createDataFrame(rows, LIGHTS))
    return rows[:150], points, levels, ranks


def bounds(rows):
    return {r[0]: {"energy": r[5], "lo": np.array(r[1:4]) - r[4], "hi": np.array(r[1:4]) + r[4], "axis": unit(np.array(r[6:9])), "o": r[9], "e": r[10]} for r in rows}


def test_levels(scene):
    rows, _, levels, ranks = scene
    rank = {r["light"]: r["rank"] for r in ranks.collect()}
    assert sorted(rank.values()) == list(range(150)) and len(levels) == 3
    below = {rank[i]: b for i, b in bounds(rows).items()}
    for level in levels:
        got, mine = {r["node"]: r for r in level.collect()}, {}
        for k in sorted(below):
            mine[k >> 3] = merge(mine[k >> 3], below[k]) if k >> 3 in mine else below[k]
        assert got.keys() == mine.keys()
        for k, b in mine.items():
            r = got[k]
            assert np.allclose([r["energy"], r["lx"], r["hy"], r["ax"], r["ay"], r["az"], r["o"], r["e"]], [b["energy"], b["lo"][0], b["hi"][1], *b["axis"], b["o"], b["e"]], atol=1e-7)
        below = mine


def all_pdfs(spark, scene):
    _, points, levels, ranks = scene
    d = spark.createDataFrame([(*p, i) for p in points for i in [*range(150), 200]], POINTS + ", light long")
    return {(r["point"], r["light"]): r["pdf"] for r in lights.pdf(d, levels, ranks).collect()}


def test_probabilities(spark, scene):
    rows, points, levels, ranks = scene
    rank = {r["light"]: r["rank"] for r in ranks.collect()}
    tree = [{rank[i]: b for i, b in bounds(rows).items()}]
    for _ in levels:
        up = {}
        for k in sorted(tree[-1]):
            up[k >> 3] = merge(up[k >> 3], tree[-1][k]) if k >> 3 in up else tree[-1][k]
        tree.append(up)
    pdfs = all_pdfs(spark, scene)
    for p in points:
        at, n = np.array(p[1:4]), np.array(p[4:7])
        mine = {0: 1.0}
        for level in reversed(tree[:-1]):
            mine = {k: mine.get(node, 0) * c for node in {k >> 3 for k in level} for kids in [[k for k in sorted(level) if k >> 3 == node]] for k, c in zip(kids, chances(at, n, [level[k] for k in kids]), strict=True)}
        assert all(abs(pdfs[p[0], i] - mine[k]) < 1e-6 for i, k in rank.items()) and pdfs[p[0], 200] == 0
        total = sum(pdfs[p[0], i] for i in range(150))
        assert total < 1 + 1e-9


def test_picks(spark, scene):
    rows, points, levels, ranks = scene
    pdfs = all_pdfs(spark, scene)
    n = 400
    d = spark.createDataFrame([(p[0] * 1000 + k, *p[1:7], (k + 0.5) / n) for p in points[:6] for k in range(n)], POINTS)
    got = lights.pick(d, levels, "r").collect()
    seen: dict = {}
    for r in got:
        key = r["point"] // 1000, r["light"]
        assert abs(r["pdf"] - pdfs[key]) < 1e-9
        seen[key] = seen.get(key, 0) + 1 / n
    assert all(abs(seen.get(k, 0) - v) < 2.5 / n + 0.02 for k, v in pdfs.items() if k[0] < 6)


def test_every_light_counts_once_where_all_reach(spark):
    rows = [(i, float(i % 5), float(i // 5), 5.0, 0.0, 1.0 + i, 0.0, 0.0, -1.0, math.pi, math.pi / 2) for i in range(20)]
    levels, ranks = lights.build(spark.createDataFrame(rows, LIGHTS))
    d = spark.createDataFrame([(0, 2.0, 2.0, 0.0, 0.0, 0.0, 1.0, 0.3, i) for i in range(20)], POINTS + ", light long")
    assert abs(sum(r["pdf"] for r in lights.pdf(d, levels, ranks).collect()) - 1) < 1e-9


def test_nothing(spark):
    levels, ranks = lights.build(spark.createDataFrame([], LIGHTS))
    d = spark.createDataFrame([(0, 2.0, 2.0, 0.0, 0.0, 0.0, 1.0, 0.3)], POINTS)
    assert levels == [] and lights.pick(d, levels, "r").count() == 0
    one = spark.createDataFrame([(3, 0.0, 0.0, 5.0, 0.0, 2.0, 0.0, 0.0, -1.0, 0.0, math.pi / 2)], LIGHTS)
    levels, ranks = lights.build(one)
    assert [(r["light"], r["pdf"]) for r in lights.pick(d, levels, "r").collect()] == [(3, 1.0)]


def test_chances_are_computed_once(spark, scene):
    _, points, levels, _ = scene
    d = lights.pick(spark.createDataFrame(points, POINTS), levels, "r")
    text = d._jdf.queryExecution().optimizedPlan().toString()
    # a filter that is pushed below a projection holds what the projection computes a second time
    assert all("aggregate" not in line for line in text.splitlines() if "Filter" in line)
    assert len([line for line in text.splitlines() if "Generate" in line]) == 2 * len(levels)
