"""Queries of cellular features over lines of orders; DuckDB makes a row of each cell and aggregates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import cells, hashing, noise
from lumenframe.plans.textures import KEYS, POINT

RANDOM, SMOOTH = "0.9D", "0.4D"


def _lines(spark: SparkSession, sf_dir: str, dims: int, **columns: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*KEYS, *[f"CAST({x} AS DOUBLE) AS {n}" for n, x in list(POINT.items())[:dims]])
    return d.select(*KEYS, *[F.round(F.expr(sql), 6).alias(n) for n, sql in columns.items()])


def voronoi_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smooth nearest distance in the plane, by two metrics."""
    return _lines(spark, sf_dir, 2, **{m: cells.smooth(("px", "py"), m, RANDOM, SMOOTH) for m in ("euclidean", "manhattan")})


def voronoi_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance to the edge between cells, and the room about the nearest point."""
    return _lines(spark, sf_dir, 2, edge=cells.edge(("px", "py"), RANDOM), radius=cells.radius(("px", "py"), RANDOM))


def _cells(dims: int, reach: int) -> str:
    """A row a line and cell: way w0 .., place among the cells."""
    axes = list(POINT.items())[:dims]
    lines = f"SELECT row_number() OVER () AS rid, {', '.join(KEYS)}, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in axes)} FROM lineitem"
    sides = " ".join(f"CROSS JOIN range({-reach}, {reach + 1}) AS g{k}(o{k})" for k in range(dims))
    hashed = hashing.pcg2d("h", *[hashing.cut(f"CAST(floor({n}) AS BIGINT) + o{k}") for k, (n, _) in enumerate(axes)])
    source = f"(SELECT * FROM ({lines}) AS l {sides}) AS c"
    ways = ", ".join(f"o{k} + h_{c} / {noise.TOP}::DOUBLE * 0.9 - ({n} - floor({n})) AS w{k}" for k, (c, (n, _)) in enumerate(zip("xyz", axes, strict=False)))
    place = " + ".join(f"o{k} * {10**k}" for k in range(dims))
    return f"SELECT rid, {', '.join(KEYS)}, {ways}, {', '.join(f'o{k}' for k in range(dims))}, {place} AS place FROM ({hashing.staged(source, '*', hashed)}) AS h"


def _sum(dims: int, a: str, b: str = "") -> str:
    return " + ".join(f"({a}w{k}{f' - {b}w{k}' if b else ''}) ** 2" for k in range(dims))


def _edge_sql(dims: int) -> str:
    half = " + ".join(f"(m.w{k} + p.w{k}) / 2 * (p.w{k} - m.w{k})" for k in range(dims))
    return f"p AS MATERIALIZED ({_cells(dims, 1)}), m AS MATERIALIZED (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY rid ORDER BY {_sum(dims, '')}, place) = 1), e AS (SELECT rid, min(({half}) / sqrt({_sum(dims, 'p.', 'm.')})) AS edge FROM p JOIN m USING (rid) WHERE {_sum(dims, 'p.', 'm.')} > {cells.SAME} GROUP BY rid)"


_FOLD = "list_reduce(list_prepend(NULL::DOUBLE, list({far} ORDER BY place)), lambda s, x: CASE WHEN s IS NULL THEN x ELSE list_transform([least(greatest(0.5 + 0.5 * (s - x) / 0.4, 0), 1)], lambda t: list_transform([t * t * (3 - 2 * t)], lambda h: s + (x - s) * h - 0.4 * h * (1 - h))[1])[1] END)"
_GROUP = f"GROUP BY rid, {', '.join(KEYS)}"
SQL = {
    "voronoi_smooth": f"SELECT {', '.join(KEYS)}, round({_FOLD.format(far='sqrt(w0 ** 2 + w1 ** 2)')}, 6) AS euclidean, round({_FOLD.format(far='abs(w0) + abs(w1)')}, 6) AS manhattan FROM ({_cells(2, 2)}) AS c {_GROUP}",
    # the nearest point's own neighbours lie within two cells
    "voronoi_edge": f"WITH {_edge_sql(2)}, q AS MATERIALIZED ({_cells(2, 2)}), r AS (SELECT rid, min(sqrt({_sum(2, 'q.', 'm.')})) / 2 AS radius FROM q JOIN m USING (rid) WHERE abs(q.o0 - m.o0) <= 1 AND abs(q.o1 - m.o1) <= 1 AND q.place <> m.place GROUP BY rid) SELECT {', '.join(f'm.{k}' for k in KEYS)}, round(edge, 6) AS edge, round(radius, 6) AS radius FROM m JOIN e USING (rid) JOIN r USING (rid)",
}
NATIVE = (voronoi_smooth, voronoi_edge)
