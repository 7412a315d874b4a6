"""Hashes, textures, running totals and islands against plain Python."""

import random

import pytest
from lumenframe.functions import color, hashing, texture
from lumenframe.operators import distribution, graph
from pyspark.sql import functions as F

M = 0xFFFFFFFF
PAIRS = [(0, 0), (1, 0), (5, 9), (123456789, 987654321), (M, M), (1 << 31, 77)]


def rot(x, k):
    return (x << k | x >> (32 - k)) & M


def jenkins(*keys):
    a = b = c = (0xDEADBEEF + (len(keys) << 2) + 13) & M
    a, b, c = ((x + k) & M for x, k in zip((a, b, c), (*keys, 0, 0, 0), strict=False))
    for turn, name in zip((14, 11, 25, 16, 4, 14, 24), "cabcabc", strict=True):
        if name == "c":
            c = ((c ^ b) - rot(b, turn)) & M
        elif name == "a":
            a = ((a ^ c) - rot(c, turn)) & M
        else:
            b = ((b ^ a) - rot(a, turn)) & M
    return c


def pcg2d(x, y):
    signed = lambda v: v - (1 << 32) if v & 1 << 31 else v
    x, y = (x * 1664525 + 1013904223) & M, (y * 1664525 + 1013904223) & M
    x = (x + y * 1664525) & M
    y = (y + x * 1664525) & M
    x, y = (x ^ signed(x) >> 16) & M, (y ^ signed(y) >> 16) & M
    x = (x + y * 1664525) & M
    y = (y + x * 1664525) & M
    return x & 0x7FFFFFFF, y & 0x7FFFFFFF


def prospector(i):
    i = (i ^ i >> 16) * 0x21F0AAAD & M
    i = (i ^ i >> 15) * 0xD35A2D97 & M
    return i ^ i >> 15 ^ 0xE6FE3BEB


def wang(i, seed):
    i = (i ^ 61) ^ seed
    i = i * 9 & M
    return (i ^ i >> 4) * 0x27D4EB2D & M


def lattice(x, y):
    f = 1103515245
    return f * ((f * (x >> 1 ^ y) & M) ^ (f * (y >> 1 ^ x) & M) >> 3) & M


def test_hashes(spark):
    spark.createDataFrame(PAIRS, "x long, y long").createOrReplaceTempView("pairs")
    chains = [
        (hashing.jenkins("h", "x"), lambda x, y: (jenkins(x),)),
        (hashing.jenkins("h", "x", "y"), lambda x, y: (jenkins(x, y),)),
        (hashing.jenkins("h", "x", "y", "17"), lambda x, y: (jenkins(x, y, 17),)),
        (hashing.pcg2d("h", "x", "y"), pcg2d),
        (hashing.prospector("h", "x"), lambda x, y: (prospector(x),)),
        (hashing.wang("h", "x", 12345), lambda x, y: (wang(x, 12345),)),
        (hashing.lattice("h", "x", "y"), lambda x, y: (lattice(x, y),)),
    ]
    for steps, want in chains:
        names = [n for n in ("h", "h_x", "h_y") if n in dict(steps)]
        names = names[:1] if "h" in names else names
        for r in spark.sql(hashing.staged("pairs", "x, y", steps)).collect():
            assert tuple(r[n] for n in names) == tuple(want(r["x"], r["y"]))


def value(spark, text):
    return spark.range(1).select(F.expr(f"CAST({text} AS DOUBLE)")).first()[0]


def test_colour_golden(spark):
    c = ("0.3D", "0.5D", "0.7D")
    got = lambda v: [value(spark, x) for x in v]
    assert got(color.gamma(c, "1.5D")) == pytest.approx([0.164317, 0.353553, 0.585662], abs=1e-6)
    assert got(color.gamma(c, "0.0D")) == [1, 1, 1]
    assert got(color.bright_contrast(c, "0.1D", "1.2D")) == pytest.approx([0.16, 0.6, 1.04])
    assert got(color.invert(c, "0.8D")) == pytest.approx([0.62, 0.5, 0.38])
    assert got(color.hsl_to_rgb(tuple(f"{x}D" for x in got(color.rgb_to_hsl(c))))) == pytest.approx([0.3, 0.5, 0.7])
    assert got(color.adjust_hsv(c, "0.5D", "1.0D", "1.0D", "1.0D")) == pytest.approx([0.3, 0.5, 0.7])
    assert got(color.mix_hsv("value", c, ("0.2D", "0.9D", "0.1D"), "1.0D")) == pytest.approx([0.3 * 9 / 7, 0.5 * 9 / 7, 0.9])
    assert got(color.mix_hsv("hue", c, ("0.4D", "0.4D", "0.4D"), "1.0D")) == pytest.approx([0.3, 0.5, 0.7])
    assert got(color.xyy_to_xyz("0.3D", "0.0D", "0.7D")) == pytest.approx([0, 0.7, 0])


def test_textures(spark):
    assert value(spark, texture.brick_mortar("0.6D", "0.3D", soft="0.0")) == 0
    assert value(spark, texture.brick_mortar("0.6D", "0.251D", soft="0.0")) == 1
    assert value(spark, texture.wave(("0.0D", "0.0D", "0.0D"), False, "x", "tri")) == pytest.approx(0, abs=1e-4)


def test_running(spark):
    keys = random.Random(4).sample(range(10_000), 500)
    rows = spark.createDataFrame([(k, k % 7) for k in keys], "k long, w long")
    got = {r["k"]: (r["lo"], r["hi"]) for r in distribution.cdf(rows, "k", F.col("w"), 700).collect()}
    at = 0
    for k in sorted(keys):
        assert got[k] == (at, at + k % 7)
        at += k % 7
    points = spark.range(at + 5).withColumnRenamed("id", "p")
    found = distribution.pick(points, "p", distribution.cdf(rows, "k", F.col("w"), 700), F.lit(2.5)).collect()
    assert sorted(r["p"] for r in found) == list(range(at))
    assert all(r["lo"] <= r["p"] < r["hi"] for r in found)
    assert [r["index"] for r in distribution.compact(rows, "k", F.col("w") > 3, 700).orderBy("k").collect()] == list(range(sum(k % 7 > 3 for k in keys)))
    none = rows.where("false")
    assert distribution.cdf(none, "k", F.col("w"), 700).count() == 0


def test_islands(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    chain = [(i, i + 1) for i in range(20, 40)] + [(50, 3), (3, 3), (59, 50)]
    got = {r["node"]: r["island"] for r in graph.islands(nodes, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 20 if 20 <= i <= 40 else 3 if i in (3, 50, 59) else i for i in range(60)}
