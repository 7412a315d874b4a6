"""Exponents of codecs by logarithm, as Spark runs them, against the count of powers."""

import math

from lumenframe.functions import codecs, hashing
from lumenframe.plans import helpers


def test_logged_exponents_equal_counted_ones(spark):
    xs = [None, 0.0, 1e-300, 1e300, math.inf, math.nan, *(f(2.0**e) for e in range(-30, 40) for f in (float, lambda x: math.nextafter(x, 0.0), lambda x: math.nextafter(x, math.inf)))]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    sql = hashing.staged("{d}", "x", [(f"{n}{i}", v) for i, (low, high) in enumerate(((-14, 15), (-16, 15))) for n, v in [("w", codecs.exponent("x", low, high))]])
    for i, (low, high) in enumerate(((-14, 15), (-16, 15))):
        sql = hashing.staged(f"({sql}) AS s", "*", codecs.logged(f"e{i}", "x", low, high))
    rows = spark.sql(sql, d=d).collect()
    assert len(rows) == len(xs) and all((r.e0, r.e1) == (r.w0, r.w1) for r in rows)


def test_spark_needs_few_branches():
    for name in ("codec_half", "codec_shared_exponent"):
        assert helpers.SPARK[name].count("CASE WHEN") < helpers.QUERIES[name].count("CASE WHEN") / 2
