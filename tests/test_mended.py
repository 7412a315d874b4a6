"""Convergence, dilation, filtering, merging, overlaps, places, streams and hashes against plain Python."""

import math
import random

import pytest
from lumenframe.functions import hashing, scalar
from lumenframe.operators import distribution, film, spatial
from lumenframe.plans import catalog
from lumenframe.streaming import progressive
from pyspark.sql import functions as F


def value(spark, text):
    return spark.range(1).select(F.expr(text)).first()[0]


@pytest.mark.parametrize(("full", "half", "n", "exposure", "want"), [((0.3, 0.2, 0.1), (0.2, 0.2, 0.3), 1, 1.0, 0.3 / (0.0001 + math.sqrt(0.6))), ((3.0, 2.0, 1.0), (3.0, 2.5, 1.0), 2, 1.5, 0.375 / (0.0001 + 4.5)), ((0.0, 0.0, 0.0), (0.0, 0.0, 0.0), 4, 1.0, 0.0)])
def test_sampling_error(spark, full, half, n, exposure, want):
    lit = lambda v: [F.lit(float(x)) for x in v]
    got = spark.range(1).select(film.sampling_error(lit(full), lit(half), F.lit(n), exposure), film.converged(lit(full), lit(half), F.lit(n), 0.1, exposure), film.converged(lit(full), lit(half), F.lit(n), 0.1, exposure, F.lit(True))).first()
    assert got[0] == pytest.approx(want) and got[1] == (want < 0.1) and got[2]


def test_map_range(spark):
    assert value(spark, f"CAST({scalar.map_range('linear', '3.0D', '1.0D', '1.0D', '5.0D', '7.0D')} AS DOUBLE)") == 0
    assert value(spark, f"CAST({scalar.map_range('stepped', '3.0D', '1.0D', '5.0D', '5.0D', '7.0D')} AS DOUBLE)") == 6
    assert value(spark, f"CAST({scalar.clamp_range('3.0D', '2.0D', '1.0D')} AS DOUBLE)") == 2


def test_string_hash(spark):
    for text in ("", "a", "plain name", "größe 日本", "x" * 300):
        want = 0
        for b in text.encode():
            want = (want * 37 + b) % (1 << 32)
        assert spark.createDataFrame([(text,)], "t string").select(F.expr(hashing.string_hash("t"))).first()[0] == want


def events(seed):
    rnd = random.Random(seed)
    return [(rnd.choice((1, 2, 3, 5, 6, 9)), rnd.choice((0, 1, 2, 4, 5, 9)), rnd.random()) for _ in range(90)]


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    where, rows = tmp_path_factory.mktemp("grid"), events(3)
    d = spark.createDataFrame([(i, u, h, v) for i, (u, h, v) in enumerate(rows)], "event_id long, user_id long, h int, value double")
    d = d.select("event_id", "user_id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h, 0, event_id)").alias("ts"), F.lit("e").alias("event_type"), "value")
    d.write.parquet(f"{where}/events.parquet")
    return str(where), rows


def test_dilation_follows_coordinates(spark, grid):
    where, rows = grid
    done = {}
    for u, h, _ in rows:
        done[u, h] = done.get((u, h), 0) + 1
    done = {k: int(n >= 2) for k, n in done.items()}
    x = {(u, h): min(done.get((u, h + k), 1) for k in (-1, 0, 1)) for u, h in done}
    y = {(u, h): min(x.get((u + k, h), 1) for k in (-1, 0, 1)) for u, h in done}
    run = lambda name: {(r["user_id"], r["h"]): r["low"] for r in catalog.queries()[name](spark, where).collect()}
    assert run("dilate_x") == x and run("dilate_y") == y and x != y != done


def test_guided_filter(spark, grid):
    where, rows = grid
    v, c = {}, {}
    for u, h, w in rows:
        v[u, h], c[u, h] = v.get((u, h), 0) + w, c.get((u, h), 0) + 1
    w = {k: math.exp(-k * k / 4.5) for k in range(-5, 6)}
    for axis in (1, 0):
        step = lambda p, k, axis=axis: (p[0] + (k if axis == 0 else 0), p[1] + (k if axis else 0))
        v, c = ({p: sum(w[k] * t[step(p, k)] for k in w if step(p, k) in t) for p in t} for t in (v, c))
    got = {(r["user_id"], r["h"]): r["smooth"] for r in catalog.queries()["gaussian_taps"](spark, where).collect()}
    assert got == {p: pytest.approx(v[p] / c[p], abs=1e-4) for p in v}


def test_streams_give_the_same_result_each_time(spark, grid):
    where, rows = grid
    got = [[tuple(r) for r in progressive.accumulate(spark, f"{where}/events.parquet").collect()] for _ in range(2)]
    assert got[0] == got[1] and got[0][0][:2] == ("e", len(rows))


def test_merge_modes(spark):
    parts = spark.createDataFrame([("k", "b", 3, 1.0, 5, 9), ("k", "a", 1, 5.0, 7, 4), ("j", "z", 2, 0.5, 1, 1)], "key string, file string, n int, m double, s int, c int")
    got = {r["key"]: (r["n"], r["m"], r["s"], r["c"]) for r in film.merge(parts, "key", ["m"], sums=("s",), copies=("c",), order="file").collect()}
    assert got == {"k": (4, 2.0, 12, 4), "j": (2, 0.5, 1, 1)}


def test_overlaps(spark):
    rnd = random.Random(5)
    boxes = lambda n: [(i, x, x + rnd.choice((0, 0.5, 9)), y, y + rnd.choice((0, 1, 6))) for i in range(n) for x, y in [(rnd.choice((-4.0, 0.0, 2.0)) + rnd.randrange(9), rnd.uniform(-9, 9))]]
    a, b = boxes(40), boxes(40)
    names = "long, lo0 double, hi0 double, lo1 double, hi1 double"
    got = spatial.overlaps(spark.createDataFrame(a, f"a {names}"), spark.createDataFrame(b, f"b {names}"), 2.0).collect()
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_places_in_buckets(spark):
    rows = [(k, "hot" if k % 5 else "cold") for k in random.Random(2).sample(range(5000), 400)]
    got = {r["k"]: r["place"] for r in distribution.ranked(spark.createDataFrame(rows, "k long, g string"), "g", "k", 300).collect()}
    for g in ("hot", "cold"):
        assert [got[k] for k, b in sorted(rows) if b == g] == list(range(1, 1 + sum(b == g for _, b in rows)))
