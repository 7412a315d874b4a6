"""Bricks at points where an edge falls on the bound of the mortar: Spark and DuckDB agree."""

import duckdb
from lumenframe.functions import texture

POINTS = "SELECT CAST(CAST(i AS DOUBLE) / 1000.0 - 3.0 AS DOUBLE) AS x, CAST(CAST(j AS DOUBLE) / 10.0 - 2.0183 AS DOUBLE) AS y FROM"


def test_edges(spark):
    hard = texture.brick_mortar("x", "y", soft="0.0", squash="0.7", every=3)
    text = f"SELECT i, j, CAST({hard} AS DOUBLE) AS hard FROM (SELECT i, j, {POINTS.removeprefix('SELECT ').removesuffix(' FROM')} FROM {{}}) AS p"
    mine = spark.sql(text.format("(SELECT id AS i FROM range(3000)) AS a CROSS JOIN (SELECT id AS j FROM range(20)) AS b")).collect()
    want = duckdb.connect().execute(text.format("range(3000) AS a(i) CROSS JOIN range(20) AS b(j)")).fetchall()
    assert len(mine) == 60_000 and {tuple(r) for r in mine} == set(want)
