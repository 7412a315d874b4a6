"""Queries of closures over graphs of parts, with DuckDB SQL of their own, and of microfacets, whose text both engines read.

tests/test_closures.py holds the microfacets' texts against sums over the sphere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import microfacet
from lumenframe.operators import closures
from lumenframe.plans.rendering import all_of, chain
from lumenframe.plans.scenes import _edge, _node, _rows

#: Directions of length 1 above the surface from the numbers of a line, and a roughness.
_DIRECTIONS = [("it", "acos(u * 0.98 + 0.01)"), ("ix", "(sin(it) * cos(w))"), ("iy", "(sin(it) * sin(w))"), ("iz", "cos(it)"), ("ot", "acos(v * 0.98 + 0.01)"), ("ox", "(sin(ot) * cos(c * 3.0))"), ("oy", "(sin(ot) * sin(c * 3.0))"), ("oz", "cos(ot)"), ("alpha", "(0.3 + 0.1 * c)")]
I, O = ("ix", "iy", "iz"), ("ox", "oy", "oz")
QUERIES = {f"microfacet_{kind}": chain([*_DIRECTIONS, *microfacet.reflection("m", kind, I, O, "alpha")], "m_value", "m_pdf") for kind in ("ggx", "beckmann")} | {
    "microfacet_sample": chain([*_DIRECTIONS, *microfacet.sampled("s", I, "alpha", "v", "(0.5 + 0.49 * c)")], *all_of("s")),
}


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A mix by a part's size of a sum (glossy and diffuse) and a mix by a quarter (glossy and glass): glossy is reached twice."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    nodes = [_node("'m'", "'mix_closure'", defaults="map('fac', array(p_size / 50.0D))"), _node("'s'", "'add_closure'"), _node("'q'", "'mix_closure'", defaults="map('fac', array(0.25D))"), *[_node(f"'{k}'", f"'{k}_bsdf'") for k in ("glossy", "diffuse", "glass")], _node("'output'", "'output'")]
    edges = [_edge("'m'", "'closure'", "'output'", "'surface'"), _edge("'s'", "'closure'", "'m'", "'closure1'"), _edge("'q'", "'closure'", "'m'", "'closure2'"), _edge("'glossy'", "'bsdf'", "'s'", "'closure1'"), _edge("'diffuse'", "'bsdf'", "'s'", "'closure2'"), _edge("'glossy'", "'bsdf'", "'q'", "'closure1'"), _edge("'glass'", "'bsdf'", "'q'", "'closure2'")]
    return _rows(part, "p_partkey", nodes), _rows(part, "p_partkey", edges)


def _lobes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closures.lobes(*_graphs(spark, sf_dir))


def closure_lobes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lobes of each part's graph and their weights."""
    return _lobes(spark, sf_dir).select(F.col("graph").cast("long").alias("part"), "node", F.round("weight", 6).alias("weight"))


def closure_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lobe that a number picks for each part, with which chance, and what is left of the number."""
    points = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("graph"), (F.col("p_partkey") * 7919 % 1009 / 1009.0).alias("r"))
    out = closures.pick(points, _lobes(spark, sf_dir), "r")
    return out.select(F.col("graph").cast("long").alias("part"), "node", F.round("chance", 6).alias("chance"), F.round("left", 6).alias("left_over"))


def closure_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and density of all lobes of each part as one, from one of each that its price gives."""
    found = _lobes(spark, sf_dir)
    each = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("graph"), F.explode(F.array(*[F.struct(F.lit(n).alias("node"), (F.col("p_retailprice") / (1000 + k)).alias("value"), (F.col("p_retailprice") / (2000 + k)).alias("pdf")) for n, k in (("diffuse", 1), ("glass", 2), ("glossy", 3))])).alias("x"))
    out = closures.together(each.select("graph", "x.*"), found, ["graph"])
    return out.select(F.col("graph").cast("long").alias("part"), F.round("value", 6).alias("value"), F.round("pdf", 6).alias("pdf"))


_LOBES = "SELECT p_partkey AS part, p_retailprice, unnest(['diffuse', 'glass', 'glossy']) AS node, unnest([1 - p_size / 50.0::DOUBLE, p_size / 200.0::DOUBLE, 1 - p_size / 200.0::DOUBLE]) AS weight, unnest([1, 2, 3]) AS k FROM part"
_SOME = f"SELECT *, sum(weight) OVER (PARTITION BY part) AS total, sum(weight) OVER (PARTITION BY part ORDER BY node) AS upto FROM ({_LOBES}) AS l WHERE weight > 0"
SQL = {
    "closure_lobes": f"SELECT part, node, round(weight, 6) AS weight FROM ({_SOME}) AS s",
    "closure_pick": f"SELECT part, node, round(weight / total, 6) AS chance, round((r - (upto - weight) / total) / (weight / total), 6) AS left_over FROM (SELECT *, part * 7919 % 1009 / 1009.0::DOUBLE AS r FROM ({_SOME}) AS s) AS t WHERE r < upto / total AND r >= (upto - weight) / total",
    "closure_together": f"SELECT part, round(sum(weight * p_retailprice / (1000 + k)), 6) AS value, round(sum(weight / total * p_retailprice / (2000 + k)), 6) AS pdf FROM ({_SOME}) AS s GROUP BY part",
}
NATIVE = (closure_lobes, closure_pick, closure_together)
