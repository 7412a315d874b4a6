"""Cellular features of the plane against plain Python."""

import math
import random
from itertools import product

import pytest
from lumenframe.functions import cells
from pyspark.sql import functions as F

M = (1 << 32) - 1


def cell_hash(x, y):
    signed = lambda v: v - (1 << 32) if v & 0x80000000 else v
    x, y = (x * 1664525 + 1013904223) & M, (y * 1664525 + 1013904223) & M
    x = (x + y * 1664525) & M
    y = (y + x * 1664525) & M
    x, y = x ^ (signed(x) >> 16) & M, y ^ (signed(y) >> 16) & M
    x = (x + y * 1664525) & M
    y = (y + x * 1664525) & M
    return (x & 0x7FFFFFFF) / 0x7FFFFFFF, (y & 0x7FFFFFFF) / 0x7FFFFFFF


def ways(x, y, reach, about=(0, 0), r=0.9):
    """Offset and way of each cell's point, the second axis outermost."""
    for j, i in product(range(-reach, reach + 1), repeat=2):
        a, b = i + about[0], j + about[1]
        hx, hy = cell_hash(math.floor(x) + a & M, math.floor(y) + b & M)
        yield (a, b), (a + r * hx - (x - math.floor(x)), b + r * hy - (y - math.floor(y)))


def smooth(x, y, s, far):
    d = None
    for _, w in ways(x, y, 2):
        v = far(w)
        t = 1.0 if d is None else min(1.0, max(0.0, 0.5 + 0.5 * (d - v) / s))
        h = 1.0 if d is None else t * t * (3 - 2 * t)
        d = (d or 0.0) + (v - (d or 0.0)) * h - s * h * (1 - h)
    return d


def edge(x, y):
    near = min((w for _, w in ways(x, y, 1)), key=lambda w: w[0] ** 2 + w[1] ** 2)
    out = []
    for _, w in ways(x, y, 1):
        a = w[0] - near[0], w[1] - near[1]
        if a[0] ** 2 + a[1] ** 2 > 0.0001:
            out.append(((near[0] + w[0]) / 2 * a[0] + (near[1] + w[1]) / 2 * a[1]) / math.hypot(*a))
    return min(out)


def radius(x, y):
    at, near = min(ways(x, y, 1), key=lambda p: p[1][0] ** 2 + p[1][1] ** 2)
    return min(math.dist(w, near) for o, w in ways(x, y, 1, at) if o != at) / 2


def test_features(spark):
    rnd = random.Random(1)
    rows = [(rnd.uniform(-40, 40), rnd.uniform(-40, 40)) for _ in range(80)]
    at = ("x", "y")
    d = spark.createDataFrame(rows, "x double, y double").select("x", "y", F.expr(cells.smooth(at, "euclidean", "0.9D", "0.3D")).alias("s"), F.expr(cells.smooth(at, "manhattan", "0.9D", "0.7D")).alias("m"), F.expr(cells.edge(at, "0.9D")).alias("e"), F.expr(cells.radius(at, "0.9D")).alias("r"))
    for r in d.collect():
        want = smooth(r["x"], r["y"], 0.3, lambda w: math.hypot(*w)), smooth(r["x"], r["y"], 0.7, lambda w: abs(w[0]) + abs(w[1])), edge(r["x"], r["y"]), radius(r["x"], r["y"])
        assert (r["s"], r["m"], r["e"], r["r"]) == pytest.approx(want, abs=1e-9)
