"""Queries of photometric files, one a supplier, whose text is made of its numbers; DuckDB starts from the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources import photometric

#: A quadrant of three horizontal and five vertical angles; some files have a table of tilts, some no line TILT= at all.
TEXT = """concat('IESNA:LM-63\\n[TEST] ', s_name, CASE WHEN s_suppkey % 11 = 5 THEN '\\nTILTED ' WHEN s_suppkey % 7 = 3 THEN '\\nTILT=INCLUDE\\n1\\n2\\n0 90\\n1.0,0.8' ELSE '\\nTILT=NONE' END,
 '\\n1 1000 2.0 5 3 1 1 0 0 0\\n1.0, 0.5 50\\n0 22.5 45 67.5 90\\n0 45 90\\n', array_join(transform(sequence(0, CASE WHEN s_suppkey % 13 = 6 THEN 13 ELSE 14 END), k -> (s_suppkey * 31 + k * 17) % 97 + 1), ' '))"""
TURN = "6.283185307179586"


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.expr(TEXT).alias("text"))
    good, bad = photometric.parse(made, "s_suppkey")
    return photometric.whole(good, "s_suppkey"), bad


def ies_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size, the last angles and the sum of each distribution over the whole turn."""
    total = F.expr("aggregate(values, 0.0D, (s, r) -> s + aggregate(r, 0.0D, (t, x) -> t + x))")
    return _files(spark, sf_dir)[0].select("s_suppkey", F.size("h").alias("across"), F.size("v").alias("down"), F.round(F.element_at("h", -1), 6).alias("last_h"), F.round(F.element_at("v", -1), 6).alias("last_v"), F.round(total, 6).alias("total"))


def ies_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are none, and why."""
    return _files(spark, sf_dir)[1]


def ies_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly the lamp of an order shines into the order's direction."""
    key = F.col("o_orderkey")
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (key % 120).alias("s_suppkey"), (key * 37 % 1009 / 1000.0 * float(TURN)).alias("to_h"), (key * 53 % 1013 / 1013.0 * float(TURN) * 0.3).alias("to_v"))
    return photometric.look_up(d, _files(spark, sf_dir)[0], "to_h", "to_v", "s_suppkey").select("o_orderkey", F.round("strength", 6).alias("strength"))


_GOOD = "s_suppkey % 11 <> 5 AND s_suppkey % 13 <> 6"
_VALUE = lambda j, i: f"(((k * 31 + ([0, 1, 2, 1, 0, 1, 2, 1, 0][({j})::INT + 1] * 5 + ({i})) * 17) % 97 + 1) * {photometric.TO_WATTS})"
_CURVE = lambda a, b, c, d, x: f"(0.5 * ({c} - {a}) * {x} + ({a} - 2.5 * {b} + 2 * {c} - 0.5 * {d}) * {x} ** 2 + 0.5 * ({d} - 3 * {c} + 3 * {b} - {a}) * {x} ** 3 + {b})"
_DOWN = lambda j: _CURVE(_VALUE(j, "CASE WHEN i > 0 THEN i - 1 ELSE 1 END"), _VALUE(j, "i"), _VALUE(j, "i + 1"), _VALUE(j, "least(i + 2, 4)"), "y")
SQL = {
    "ies_profiles": f"SELECT s_suppkey, 9 AS across, 5 AS down, round(2 * pi(), 6) AS last_h, round(pi() / 2, 6) AS last_v, round(list_sum(list_transform(range(15), lambda n: CASE WHEN n < 5 THEN 3 WHEN n < 10 THEN 4 ELSE 2 END * ((s_suppkey * 31 + n * 17) % 97 + 1))) * {photometric.TO_WATTS}, 6) AS total FROM supplier WHERE {_GOOD}",
    "ies_rejects": "SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 5 THEN 'no line TILT=' ELSE 'too few numbers' END AS reason FROM supplier WHERE s_suppkey % 11 = 5 OR s_suppkey % 13 = 6",
    "ies_lookup": f"WITH q AS (SELECT o_orderkey, o_orderkey % 120 AS k, o_orderkey * 37 % 1009 / 1000.0 * {TURN} AS h, o_orderkey * 53 % 1013 / 1013.0 * {TURN} * 0.3 AS v FROM orders), p AS (SELECT *, greatest(ceil(h / (pi() / 4)) - 1, 0)::INT AS j, greatest(ceil(v / (pi() / 8)) - 1, 0)::INT AS i FROM q), r AS (SELECT *, h / (pi() / 4) - j AS x, v / (pi() / 8) - i AS y FROM p) SELECT o_orderkey, CASE WHEN k NOT IN (SELECT s_suppkey FROM supplier WHERE {_GOOD}) THEN 100.0 WHEN h >= 2 * pi() OR v >= pi() / 2 THEN 0 ELSE round(greatest({_CURVE(_DOWN('CASE WHEN j > 0 THEN j - 1 ELSE 7 END'), _DOWN('j'), _DOWN('j + 1'), _DOWN('CASE WHEN j < 7 THEN j + 2 ELSE 1 END'), 'x')}, 0), 6) END::DOUBLE AS strength FROM r",
}
NATIVE = (ies_profiles, ies_rejects, ies_lookup)
