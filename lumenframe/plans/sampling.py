"""Queries of sample sequences and maps of the surroundings over the sample tables, with DuckDB SQL of their own."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import sequences
from lumenframe.operators import environment

WIDTH, HEIGHT, COUNT = 64, 32, 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sobol(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    d = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("seed"), (F.col("o_orderkey") % 5).cast("long").alias("number"))
    d = d.withColumn("p", sequences.samples(F.col("i") % COUNT, n, F.col("number"), F.col("seed"), COUNT))
    return d.select("o_orderkey", *[F.round(F.get("p", F.lit(k)), 9).alias(f"x{k}") for k in range(n)])


def sobol_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number an order, by its place in a run of 4096 samples under its customer's seed."""
    return _sobol(spark, sf_dir, 1)


def sobol_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbers an order."""
    return _sobol(spark, sf_dir, 2)


def sobol_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers an order."""
    return _sobol(spark, sf_dir, 3)


def sobol_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers an order."""
    return _sobol(spark, sf_dir, 4)


def _maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2).alias("image"), (F.col("l_partkey") % WIDTH).alias("x"), (F.col("l_suppkey") * 7 % HEIGHT).alias("y"), (F.col("l_quantity") * F.col("l_linenumber")).cast("double").alias("light"))
    return environment.distributions(d, WIDTH, HEIGHT)


def background_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of each row in the running total of its map, of which there are two, made of all lines."""
    return _maps(spark, sf_dir)[1].select("image", "y", *[F.round(c, 4).alias(c) for c in ("value", "total")], *[F.round(c, 7).alias(c) for c in ("lo", "hi")])


def background_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of each pixel in the running total of its row."""
    return _maps(spark, sf_dir)[0].select("image", "y", "x", F.round("value", 4).alias("value"), *[F.round(c, 7).alias(c) for c in ("lo", "hi")])


def _points(spark: SparkSession, sf_dir: str, a: str, b: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", (key % 2).alias("image"), (key * 7919 % 100003 / 100003.0).alias(a), (key * 5737 % 100003 / 100003.0).alias(b))


def background_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two numbers an order fall on its map, and with what density."""
    out = environment.sample(_points(spark, sf_dir, "ru", "rv"), *_maps(spark, sf_dir), WIDTH, HEIGHT)
    return out.select("o_orderkey", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), F.round("pdf", 6).alias("pdf"))


def background_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density with which a place an order is sampled."""
    out = environment.pdf(_points(spark, sf_dir, "u", "v"), *_maps(spark, sf_dir), WIDTH, HEIGHT)
    return out.select("o_orderkey", F.round("pdf", 6).alias("pdf"))


def _scramble(x: str, seed: str) -> str:
    """Nested selects over a list of one value, so that each step is written once."""
    steps = ["xor(x, x * 1025551850 % 4294967296)", f"(x + {seed}) % 4294967296 * (({seed}) >> 16 | 1) % 4294967296", "xor(x, x * 89287766 % 4294967296)", "xor(x, x * 1403136100 % 4294967296)"]
    for s in steps:
        x = f"list_transform([{x}], lambda x: {s})[1]"
    return x


def _turn(x: str) -> str:
    """Bits in opposite order, through text."""
    return f"list_sum(list_transform(range(32), lambda b: ((({x}) >> b) & 1) << (31 - b)))::BIGINT"


def _hashed(x: str) -> str:
    for s in ("xor(x, x >> 16)", "(x::HUGEINT * 569420461 % 4294967296)::BIGINT", "xor(x, x >> 15)", "(x::HUGEINT * 3545902487 % 4294967296)::BIGINT", "xor(xor(x, x >> 15), 3875421163)"):
        x = f"list_transform([{x}], lambda x: {s})[1]"
    return x


def _sobol_sql(n: int) -> str:
    order, values = sequences.ORDER_SEEDS[n], sequences.VALUE_SEEDS[n]
    own = f"SELECT o_orderkey, {_turn('o_orderkey % 4096')} AS rev, xor(o_custkey::BIGINT, {_hashed('(o_orderkey % 5)::BIGINT')}) AS own FROM orders"
    placed = f"SELECT o_orderkey, own, {_scramble('rev::HUGEINT', f'xor(own, {order})::HUGEINT')}::BIGINT & {sequences.index_mask(COUNT)} AS place FROM ({own}) AS a"
    picked = lambda d: f"list_reduce(list_transform({sequences.directions(d)}, lambda v, i: ((place >> (32 - i)) & 1) * v::BIGINT), lambda a, b: xor(a, b))"
    value = lambda d: f"round({_turn(_scramble(f'({picked(d)})::HUGEINT', f'xor(own, {values[d]})::HUGEINT') + '::BIGINT')} / 4294967808::DOUBLE, 9) AS x{d}"
    return f"SELECT o_orderkey, {', '.join(value(d) for d in range(n))} FROM ({placed}) AS b"


_PIXELS = f"SELECT l_orderkey % 2 AS image, l_suppkey * 7 % {HEIGHT} AS y, l_partkey % {WIDTH} AS x, sum(l_quantity * l_linenumber)::DOUBLE * sin((l_suppkey * 7 % {HEIGHT} + 0.5) * pi() / {HEIGHT}) AS value FROM lineitem GROUP BY 1, 2, 3, l_suppkey * 7 % {HEIGHT}"
_COND = f"SELECT image, y, x, value, coalesce(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(value) OVER p AS lo, CASE WHEN x = max(x) OVER p THEN 1 ELSE sum(value) OVER w / sum(value) OVER p END AS hi FROM ({_PIXELS}) AS v WINDOW w AS (PARTITION BY image, y ORDER BY x), p AS (PARTITION BY image, y)"
_ROWS = f"SELECT image, y, sum(value) / {WIDTH} AS value FROM ({_PIXELS}) AS v GROUP BY image, y"
_MARG = f"SELECT image, y, value, sum(value) OVER p / {HEIGHT} AS total, coalesce(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(value) OVER p AS lo, CASE WHEN y = max(y) OVER p THEN 1 ELSE sum(value) OVER w / sum(value) OVER p END AS hi FROM ({_ROWS}) AS r WINDOW w AS (PARTITION BY image ORDER BY y), p AS (PARTITION BY image)"
_AT = lambda a, b: f"SELECT o_orderkey, o_orderkey % 2 AS image, o_orderkey * 7919 % 100003 / 100003.0 AS {a}, o_orderkey * 5737 % 100003 / 100003.0 AS {b} FROM orders"
_PDF = f"value / ({2 * math.pi * math.pi} * sin(v * pi()) * total)"
SQL = {f"sobol_{n}d": _sobol_sql(n) for n in (1, 2, 3, 4)} | {
    "background_rows": f"SELECT image, y, round(value, 4) AS value, round(total, 4) AS total, round(lo, 7) AS lo, round(hi, 7) AS hi FROM ({_MARG}) AS m",
    "background_pixels": f"SELECT image, y, x, round(value, 4) AS value, round(lo, 7) AS lo, round(hi, 7) AS hi FROM ({_COND}) AS c",
    "background_sample": f"WITH c AS MATERIALIZED ({_COND}), m AS MATERIALIZED ({_MARG}), q AS (SELECT q.*, m.y, total, (m.y + (rv - lo) / (hi - lo)) / {HEIGHT} AS v FROM ({_AT('ru', 'rv')}) AS q JOIN m ON q.image = m.image AND (rv > lo OR rv = 0 AND lo = 0) AND rv <= hi AND lo < hi) SELECT o_orderkey, round((x + (ru - lo) / (hi - lo)) / {WIDTH}, 6) AS u, round(v, 6) AS v, CASE WHEN sin(v * pi()) > 0 THEN round({_PDF}, 6) ELSE 0 END AS pdf FROM q JOIN c ON q.image = c.image AND q.y = c.y AND (ru > lo OR ru = 0 AND lo = 0) AND ru <= hi AND lo < hi",
    "background_pdf": f"WITH c AS MATERIALIZED ({_COND}), m AS MATERIALIZED ({_MARG}) SELECT o_orderkey, coalesce(CASE WHEN sin(v * pi()) > 0 THEN round(c.value / ({2 * math.pi * math.pi} * sin(v * pi()) * total), 6) ELSE 0 END, 0) AS pdf FROM ({_AT('u', 'v')}) AS q LEFT JOIN m ON q.image = m.image AND floor(v * {HEIGHT}) = m.y LEFT JOIN c ON q.image = c.image AND m.y = c.y AND floor(u * {WIDTH}) = c.x",
}
NATIVE = (sobol_1d, sobol_2d, sobol_3d, sobol_4d, background_rows, background_pixels, background_sample, background_pdf)
