"""Noise and cells over batches against the texts that DuckDB reads, and no projection a level."""

import duckdb
import numpy as np
import pytest
from lumenframe.functions import lattice, noise
from lumenframe.plans import textures

SOURCE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(textures.NATIVE))
def test_batches_equal_the_texts(spark, name):
    mine = textures.NATIVE[name](spark, SOURCE)
    assert mine._jdf.queryExecution().optimizedPlan().toString().count("Project") < 5
    want = duckdb.sql(textures.QUERIES[name].replace("FROM lineitem", f"FROM '{SOURCE}/lineitem.parquet'"))
    assert mine.columns == want.columns and sorted(map(tuple, mine.collect())) == sorted(want.fetchall())


def test_far_points_and_nulls(spark):
    points = [(0.0, 0.0), (-1.0, 2.0), (1234567.25, -2e6), (-99999.5, 3e8), (None, 1.0)]
    d = spark.createDataFrame(points, "x double, y double").select("x", "y", lattice.column(lambda x, y: (lattice.perlin(x, y), *lattice.voronoi(x, y)), ("n", "f1", "f2", "px", "py"), "x", "y").alias("m")).select("x", "y", "m.*")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", points)
    levels = noise.abreast([noise.perlin("n", ("px", "py")), noise.voronoi("v", "px", "py")])
    want = con.execute(noise.leveled("t", ("x", "y"), {"px": "x", "py": "y"}, levels, {"a": "n", "b": "v_f1", "c": "v_f2", "d": "v_x", "e": "v_y"})).fetchall()
    key = lambda r: (r[0] is None, r)
    mine, want = sorted(map(tuple, d.collect()), key=key), sorted(want, key=key)
    assert mine[-1][2:] == want[-1][2:] == (None,) * 5
    assert np.allclose(np.array([r[2:] for r in mine[:-1]]), np.array([r[2:] for r in want[:-1]]), rtol=1e-12, atol=1e-9)
