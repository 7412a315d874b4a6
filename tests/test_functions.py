"""Golden values of the expression library."""

import pytest
from lumenframe.functions import color, scalar, vector
from pyspark.sql import functions as F


def value(spark, text):
    return spark.range(1).select(F.expr(f"CAST({text} AS DOUBLE)")).first()[0]


@pytest.mark.parametrize(
    ("op", "args", "want"),
    [
        ("divide", ("3.0D", "0.0D"), 0),
        ("power", ("-8.0D", "0.5D"), 0),
        ("power", ("0.0D", "0.0D"), 1),
        ("logarithm", ("-1.0D", "2.0D"), 0),
        ("round", ("-0.5D",), 0),
        ("sqrt", ("-4.0D",), 0),
        ("modulo", ("-5.1D", "3.0D"), -2.1),
        ("floored_modulo", ("-5.0D", "3.0D"), 1),
        ("trunc", ("-1.7D",), -1),
        ("snap", ("7.3D", "2.0D"), 6),
        ("wrap", ("7.0D", "3.0D", "1.0D"), 1),
        ("pingpong", ("2.5D", "2.0D"), 1.5),
        ("compare", ("1.0D", "1.05D", "0.1D"), 1),
        ("smooth_min", ("1.0D", "2.0D", "0.0D"), 1),
    ],
)
def test_scalar(spark, op, args, want):
    assert value(spark, scalar.math(op, *args)) == pytest.approx(want)


def test_vector(spark):
    a, b, zero = ("1.0D", "2.0D", "3.0D"), ("4.0D", "5.0D", "6.0D"), ("0.0D", "0.0D", "0.0D")
    assert [value(spark, x) for x in vector.cross(a, b)] == [-3, 6, -3]
    assert [value(spark, x) for x in vector.normalize(zero)] == [0, 0, 0]
    assert [value(spark, x) for x in vector.project(a, zero)] == [0, 0, 0]


def test_color(spark):
    got = [value(spark, x) for x in color.rgb_to_hsv(("0.3D", "0.5D", "0.7D"))]
    assert got == pytest.approx([0.583333, 0.571429, 0.7], abs=1e-5)
    back = [value(spark, x) for x in color.hsv_to_rgb(tuple(f"{x}D" for x in got))]
    assert back == pytest.approx([0.3, 0.5, 0.7])
    assert [value(spark, x) for x in color.mix("add", ("0.3D", "0.5D", "0.7D"), ("0.4D", "0.8D", "0.9D"), "0.8D")] == pytest.approx([0.62, 1.14, 1.42])
