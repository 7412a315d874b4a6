"""Queries of a tree of lights, one a part; DuckDB numbers the lights by their cells and sums them up by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import lights
from lumenframe.plans.casting import _AT, _AXES, _OFF, _read

BOX = ("lx", "ly", "lz", "hx", "hy", "hz")
LIGHTS = "SELECT p_partkey AS light, " + ", ".join(f"{_AT('p_partkey', n)} AS {k}" for k, n in _AXES) + ", 0.05E0 AS radius, p_retailprice / 1E3 AS energy, " + ", ".join(f"{_OFF('p_partkey', n + 31)} AS a{k}" for k, n in _AXES) + ", (p_size % 4) * 0.5E0 AS theta_o, 1.5E0 AS theta_e FROM part"
POINTS = "SELECT c_custkey AS point, " + ", ".join(f"{_AT('c_custkey', n + 86)} AS p{k}" for k, n in _AXES) + ", 0E0 AS nx, 0.6E0 AS ny, 0.8E0 AS nz, (c_custkey * 7919 % 10007) / 10007E0 AS r FROM customer"


def _built(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    return lights.build(_read(spark, sf_dir, LIGHTS))


def light_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy and box of every node of the tree, by level from the leaves up."""
    levels = [d.select(F.lit(n).alias("level"), "node", F.size("children").alias("children"), F.round("energy", 4).alias("energy"), *[F.round(c, 6).alias(c) for c in BOX]) for n, d in enumerate(_built(spark, sf_dir)[0])]
    return reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], "level int, node long, children int, energy double, " + ", ".join(f"{c} double" for c in BOX))


def light_tree_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light that each customer's number picks, and with what probability."""
    levels, _ = _built(spark, sf_dir)
    return lights.pick(_read(spark, sf_dir, POINTS), levels, "r").select("point", "light", F.round("pdf", 8).alias("pdf"))


_CELL = lambda k: f"least(floor(({k} - min({k}) OVER ()) / greatest(max({k}) OVER () - min({k}) OVER (), 1e-300) * 1024), 1023)::BIGINT AS c{k}"
_BITS = " + ".join(f"(((c{k} >> b) & 1) << (3 * b + {i}))" for i, k in enumerate("xyz"))
_RANKED = f"SELECT *, row_number() OVER (ORDER BY list_sum(list_transform(range(10), lambda b: {_BITS})), light) - 1 AS rank, count(*) OVER () AS n FROM (SELECT *, {', '.join(_CELL(k) for k in 'xyz')} FROM ({LIGHTS}) AS l) AS c"
SQL = {
    "light_tree_nodes": f"SELECT level::INTEGER AS level, (rank // 8 ** (level + 1))::BIGINT AS node, count(DISTINCT rank // (8 ** level)::BIGINT)::INTEGER AS children, round(sum(energy), 4) AS energy, {', '.join(f'round(min({k} - radius), 6) AS l{k}' for k in 'xyz')}, {', '.join(f'round(max({k} + radius), 6) AS h{k}' for k in 'xyz')} FROM (SELECT r.*, level FROM ({_RANKED}) AS r, range(12) AS g(level) WHERE level = 0 OR n > 8 ** level) AS x GROUP BY 1, 2".replace("(rank // 8 ** (level + 1))", "(rank // (8 ** (level + 1))::BIGINT)"),
}
NATIVE = (light_tree_nodes, light_tree_pick)
