"""Ball k-means against plain Python: ties, empty clusters, odd vectors, stale homes, the query and its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from lumenframe.llm import ball_kmeans as module
from lumenframe.llm.ball_kmeans import OP11_SQL, ball_kmeans, nearest, op11_ball_kmeans, reassigned, squared

SCHEMA = "vec_id long, embedding array<double>, cluster string, inertia int"


def brute(rows, k=8, rounds=10, dims=64):
    """Rows of (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), in plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    if not centres:
        return []

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        where = assigned()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, at) in zip(kept, where, strict=True) if at == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    where = assigned()
    own = [sum(d for d, at in where if at == j) for j in range(len(centres))]
    return sorted(((i, j, d, own[j], sum(own), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, where, strict=True)), key=str)


def result(spark, rows, **kw):
    d = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in ball_kmeans(d, **kw).collect()), key=str)


def near_centres(rnd, n, dims, spread):
    centres = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.4])
def test_against_brute_force(spark, spread):
    rows = near_centres(random.Random(spread), 300, 6, spread)
    assert result(spark, rows, dims=6) == brute(rows, dims=6)


def test_homes_that_stay_stale(spark, monkeypatch):
    monkeypatch.setattr(module, "STRAYED", 2.0)
    rows = near_centres(random.Random(5), 250, 4, 0.8)
    assert result(spark, rows, dims=4) == brute(rows, dims=4)


def test_balls_settle_most_and_give_what_all_distances_give():
    rnd = np.random.default_rng(2)
    centres = rnd.integers(-900, 900, (12, 8))
    x = centres[rnd.integers(0, 12, 4000)] + rnd.integers(-150, 150, (4000, 8))
    home = nearest(x + rnd.integers(-200, 200, x.shape), centres)[0]
    between = np.stack([squared(centres, c) for c in centres])
    for got, want in zip(reassigned(x, home, centres, between), nearest(x, centres), strict=True):
        assert (got == want).all()
    # points half way between two centroids go to the smaller number, from either ball
    pair = np.array([[0, 0], [10, 0]])
    for start in (0, 1):
        which, best = reassigned(np.array([[5, 3]]), np.array([start]), pair, np.stack([squared(pair, c) for c in pair]))
        assert which.tolist() == [0] and best.tolist() == [34]


def test_odd_rows(spark):
    good = [0.5, -0.25]
    rows = [(1, good), (1, good), (1, [0.1, 0.1]), (2, None), (3, []), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [1.0]), (8, [-1e-9, 0.0]), (-9, [0.0, -0.0]), (None, [3.0, 3.0]), (10, good)]
    assert result(spark, rows, dims=2, k=3) == brute(rows, dims=2, k=3)
    assert result(spark, rows, dims=2, k=50) == brute(rows, dims=2, k=50)  # more centroids than vectors, and equal ones
    assert result(spark, [], dims=2) == [] and result(spark, [(None, good), (2, None)], dims=2) == []


def test_components_too_large(spark):
    with pytest.raises(Exception, match="or more"):
        result(spark, [(1, [1e9, 0.0])], dims=2)


def test_query_and_its_sql(spark, tmp_path):
    rows = near_centres(random.Random(8), 120, 64, 0.5)
    rows += [(500, rows[0][1]), (501, [1.0] * 63), (502, None), (503, [math.nan] * 64)]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in op11_ball_kmeans(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == brute(kept) == sorted(con.sql(OP11_SQL).fetchall(), key=str)
