"""Queries of curves, ramps and lookup tables that the parts give; DuckDB holds the entries as rows and joins neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import tables

#: Entries of the tables by dimension.
SHAPE = (6, 5, 4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(rows: DataFrame, size: int) -> DataFrame:
    """Rows (i, v) as one array of `size` entries; missing ones are 0. One row, which is broadcast."""
    known = rows.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return F.broadcast(known.select(F.expr(f"transform(sequence(0, {size - 1}), i -> coalesce(m[i], 0.0D))").alias("entries")))


def _prices(spark: SparkSession, sf_dir: str, index: str, size: int) -> DataFrame:
    return _held(_table(spark, sf_dir, "part").groupBy(F.expr(index).cast("int").alias("i")).agg((F.sum("p_retailprice") / F.count("*") / 1000).alias("v")), size)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return _table(spark, sf_dir, "lineitem").selectExpr(*keys, "double(l_discount) * 15 - 0.2D AS x", "double(l_tax) * 11 AS y", "double(l_quantity) / 45 AS z")


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _with(spark: SparkSession, sf_dir: str, table: DataFrame, **columns: str) -> DataFrame:
    d = _lines(spark, sf_dir).join(table)
    return d.select(*KEYS, *[F.round(F.expr(sql), 6).alias(name) for name, sql in columns.items()])


def curve_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices of parts by size as a ramp: linear, in steps, and drawn out beyond its ends."""
    made = {"smooth": tables.ramp("entries", "x"), "steps": tables.ramp("entries", "x", "false"), "drawn": tables.ramp("entries", "x", "true", "true")}
    return _with(spark, sf_dir, _prices(spark, sf_dir, "p_size % 17", 17), **made)


def curve_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three interleaved curves over 0.1 to 0.9, by which a colour is bent half way."""
    bent = tables.curves("entries", ("x", "y", "z"), "0.5D", "0.1D", "0.9D")
    return _with(spark, sf_dir, _prices(spark, sf_dir, "p_size % 27", 27), **dict(zip("rgb", bent, strict=True)))


def curve_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve, by which a number is bent, flat beyond its ends."""
    return _with(spark, sf_dir, _prices(spark, sf_dir, "p_size % 9", 9), value=tables.curves("entries", ("x",), "y", "0D", "1D", "false")[0])


def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries as tables of one, two and three dimensions."""
    a, b, c = SHAPE
    made = {"one": tables.lookup("entries", (a,), "x"), "two": tables.lookup("entries", (a, b), "x", "y"), "three": tables.lookup("entries", (a, b, c), "x", "y", "z")}
    return _with(spark, sf_dir, _prices(spark, sf_dir, f"p_partkey % {a * b * c}", a * b * c), **made)


_ROWS = lambda index, size: f"e AS MATERIALIZED (SELECT g.i, coalesce(v, 0) AS v FROM range({size}) AS g(i) LEFT JOIN (SELECT {index} AS i, sum(p_retailprice)::DOUBLE / count(*) / 1000 AS v FROM part GROUP BY 1) AS p USING (i))"
_LINES = f"l AS MATERIALIZED (SELECT {', '.join(KEYS)}, l_discount::DOUBLE * 15 - 0.2 AS x, l_tax::DOUBLE * 11 AS y, l_quantity::DOUBLE / 45 AS z FROM lineitem)"


def _at(i: str) -> str:
    return f"(SELECT v FROM e WHERE e.i = {i})"


def _near(x: str, n: int, index: str = "{}", steps: bool = False) -> str:
    pos = f"(least(greatest({x}, 0), 1) * {n - 1})"
    low, high = _at(index.format(f"floor({pos})")), _at(index.format(f"least(floor({pos}) + 1, {n - 1})"))
    return low if steps else f"({low} * (1 - ({pos} - floor({pos}))) + {high} * ({pos} - floor({pos})))"


def _drawn(x: str, n: int, index: str = "{}") -> str:
    first, second, last, before = (_at(index.format(k)) for k in (0, 1, n - 1, n - 2))
    return f"CASE WHEN {x} < 0 THEN {first} + ({second} - {first}) * {x} * {n - 1} WHEN {x} > 1 THEN {last} + ({last} - {before}) * ({x} - 1) * {n - 1} ELSE {_near(x, n, index)} END"


def _grid(dims: int) -> str:
    """The mean of all corners, each weighted by how near it is: a sum over rows."""
    pos = [f"(least(greatest({x}, 0), 1) * {n - 1})" for x, n in zip("xyz", SHAPE, strict=True)][:dims]
    place = ["e.i % 6", "e.i // 6 % 5", "e.i // 30"][:dims]
    weight = " * ".join(f"greatest(0, 1 - abs({p} - {i}))" for p, i in zip(pos, place, strict=True))
    size = (6, 30, 120)[dims - 1]
    return f"(SELECT sum(v * {weight}) FROM e WHERE e.i < {size})"


_OUT = lambda columns: f"SELECT {', '.join(KEYS)}, {', '.join(f'round({sql}, 6) AS {name}' for name, sql in columns.items())} FROM l"
_BENT = lambda k, x: f"(0.5 * {x} + 0.5 * ({_drawn(f'(({x} - 0.1) / (0.9 - 0.1))', 9, f'(({{}}) * 3 + {k})')}))"
SQL = {
    "curve_ramp": f"WITH {_ROWS('p_size % 17', 17)}, {_LINES} " + _OUT({"smooth": _near("x", 17), "steps": _near("x", 17, steps=True), "drawn": _drawn("x", 17)}),
    "curve_rgb": f"WITH {_ROWS('p_size % 27', 27)}, {_LINES} " + _OUT({c: _BENT(k, x) for k, (c, x) in enumerate(zip("rgb", "xyz", strict=True))}),
    "curve_float": f"WITH {_ROWS('p_size % 9', 9)}, {_LINES} " + _OUT({"value": f"((1 - y) * x + y * {_near('x', 9)})"}),
    "table_lookup": f"WITH {_ROWS('p_partkey % 120', 120)}, {_LINES} " + _OUT({"one": _grid(1), "two": _grid(2), "three": _grid(3)}),
}
NATIVE = (curve_ramp, curve_rgb, curve_float, table_lookup)
