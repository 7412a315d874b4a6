"""Sample sequences against plain integers, their strata, and maps of the surroundings against numpy."""

import math

import numpy as np
import pytest
from lumenframe.functions import sequences
from lumenframe.operators import environment
from pyspark.sql import functions as F

M = (1 << 32) - 1


def turn(x):
    return int(f"{x:032b}"[::-1], 2)


def prospect(x):
    x ^= x >> 16
    x = x * 0x21F0AAAD & M
    x ^= x >> 15
    x = x * 0xD35A2D97 & M
    return x ^ x >> 15 ^ 0xE6FE3BEB


def scramble(x, seed):
    x ^= x * 0x3D20ADEA & M
    x = (x + seed & M) * (seed >> 16 | 1) & M
    x ^= x * 0x05526C56 & M
    return x ^ x * 0x53A22864 & M


def sample(index, n, number, seed, count):
    own = seed ^ prospect(number)
    index = scramble(turn(index), own ^ sequences.ORDER_SEEDS[n]) & sequences.index_mask(count)
    out = []
    for d, key in enumerate(sequences.VALUE_SEEDS[n]):
        x = 0
        for k, v in enumerate(sequences.directions(d)):
            if index >> (31 - k) & 1:
                x ^= v
        out.append(turn(scramble(x, own ^ key)) / 4294967808)
    return out


def test_directions():
    assert [sequences.directions(d)[:8] for d in (1, 2, 3)] == [[1, 3, 5, 15, 17, 51, 85, 255], [1, 3, 6, 9, 0x17, 0x3A, 0x71, 0xA3], [1, 3, 4, 10, 0x1F, 0x2E, 0x45, 0xC9]]
    assert [sequences.directions(d)[31] for d in (0, 1, 2, 3)] == [0x80000000, 0xFFFFFFFF, 0xAAAA00A3, 0xC900A00A]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_values_and_strata(spark, n):
    count = 4096
    d = spark.range(count).select("id", sequences.samples(F.col("id"), n, F.lit(3).cast("long"), F.lit(0xDEADBEEF), count).alias("p"))
    got = [r["p"] for r in d.orderBy("id").collect()]
    assert got[::97] == [sample(i, n, 3, 0xDEADBEEF, count) for i in range(0, count, 97)]
    x = np.array(got)
    assert (x >= 0).all() and (x < 1).all()
    x *= 4294967808 / 2**32  # the divisor is a little above the number of values
    for k in range(13):  # every run of a power of two has one sample in each stratum of each dimension
        run = x[: 1 << k]
        assert all(len(np.unique(np.floor(run[:, j] * (1 << k)))) == 1 << k for j in range(n))
    if n > 1:  # and in each cell of the first two dimensions, whatever its proportions
        for a in range(13):
            cells = np.floor(x[:, 0] * (1 << a)) * 8192 + np.floor(x[:, 1] * (1 << (12 - a)))
            assert len(np.unique(cells)) == count


def test_sets_and_seeds_differ(spark):
    d = spark.range(64).select(*[sequences.samples(F.col("id"), 1, F.lit(a).cast("long"), F.lit(b).cast("long"), 64).alias(f"p{a}{b}") for a, b in ((0, 1), (1, 1), (0, 2))]).collect()
    assert len({tuple(r[c][0] for r in d) for c in ("p01", "p11", "p02")}) == 3


@pytest.fixture(scope="module")
def maps(spark):
    rnd = np.random.default_rng(3)
    light = rnd.uniform(0, 1, (6, 8)) ** 4
    light[2] = 0
    light[4, 3:] = 0
    rows = [(0, x, y, float(light[y, x])) for y in range(6) for x in range(8) if light[y, x] > 0.01 or y == 4]
    light[light <= 0.01] = 0
    for i, x, y, v in rows:
        light[y, x] = v
    d = spark.createDataFrame([*rows, (None, 1, 1, 5.0), (0, None, 1, 5.0), (0, 9, 1, 5.0), (0, 0, 6, 5.0), (7, 1, 1, 0.0)], "image long, x long, y long, light double")
    return light, *environment.distributions(d, 8, 6)


def test_distributions(maps):
    light, conditional, marginal = maps
    value = light * np.sin((np.arange(6) + 0.5) * math.pi / 6)[:, None]
    for r in marginal.where("image = 0").collect():
        means = value.mean(axis=1)
        assert math.isclose(r["lo"], means[: r["y"]].sum() / means.sum(), abs_tol=1e-12) and math.isclose(r["total"], means.mean(), abs_tol=1e-12)
    for r in conditional.where("image = 0").collect():
        row = value[r["y"]]
        if row.sum():
            assert math.isclose(r["lo"], row[: r["x"]].sum() / row.sum(), abs_tol=1e-12)
    assert [(r["lo"], r["hi"]) for r in conditional.where("image = 7").collect()] == [(0.0, 1.0)]


def test_samples_follow_their_density(spark, maps):
    light, conditional, marginal = maps
    n = 64
    grid = [(0, (i + 0.5) / n, (j + 0.5) / n) for i in range(n) for j in range(n)]
    points = spark.createDataFrame([*grid, (0, 0.0, 0.0), (5, 0.5, 0.5)], "image long, ru double, rv double")
    out = environment.sample(points, conditional, marginal, 8, 6)
    rows = out.collect()
    assert len(rows) == len(grid) + 1 and all(0 <= r["u"] <= 1 and 0 <= r["v"] <= 1 for r in rows)
    value = light * np.sin((np.arange(6) + 0.5) * math.pi / 6)[:, None]
    share = np.zeros((6, 8))
    for r in rows:
        share[min(5, int(r["v"] * 6)), min(7, int(r["u"] * 8))] += 1 / len(rows)
    assert np.abs(share - value / value.sum()).max() < 0.02
    # the density of the place is the one that the sample came with, and that of the way there
    again = environment.pdf(out.drop("x", "y").withColumnRenamed("pdf", "was"), conditional, marginal, 8, 6).collect()
    assert len(again) == len(rows) and all(math.isclose(r["pdf"], r["was"], rel_tol=1e-9) for r in again)


def test_density_integrates_to_one(spark, maps):
    light, conditional, marginal = maps
    n = 240
    places = spark.range(n * n).selectExpr("0L AS image", f"(id % {n} + 0.5) / {n} AS u", f"(id DIV {n} + 0.5) / {n} AS v").selectExpr("image", "double(u) AS u", "double(v) AS v")
    d = environment.pdf(places, conditional, marginal, 8, 6)
    total = d.agg(F.sum(F.col("pdf") * F.sin(F.col("v") * math.pi)) * (2 * math.pi * math.pi / (n * n))).first()[0]
    assert abs(total - 1) < 1e-3


def test_empty(spark):
    none = spark.createDataFrame([], "image long, x long, y long, light double")
    conditional, marginal = environment.distributions(none, 4, 4)
    points = spark.createDataFrame([(0, 0.5, 0.5)], "image long, ru double, rv double")
    assert environment.sample(points, conditional, marginal, 4, 4).count() == 0
    places = points.withColumnsRenamed({"ru": "u", "rv": "v"})
    assert [r["pdf"] for r in environment.pdf(places, conditional, marginal, 4, 4).collect()] == [0.0]
