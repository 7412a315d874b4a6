"""Importance sampling of maps of the surroundings: two-dimensional cumulative distributions, their inversion and density.

A map is rows of (image, x, y, light) on a grid of width by height pixels; missing pixels are dark, equal ones add up.
Rows of a map are weighted by the sine of their height, since they cover less of the sphere near its poles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distributions(pixels: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Conditional (image, y, x, value, lo, hi) and marginal (image, y, value, total, lo, hi) distributions.

    lo to hi is a pixel's range in the running total of its row, and a row's in that of its map, as shares of the whole;
    value is what it is a share of, total the map's mean value. A pixel or row takes up to the next one that is there, and
    the last one up to 1, as if the dark ones in between were listed. Windows hold one row of a map, or one value a row.
    """
    known = pixels.where("image is not null and x is not null and y is not null").where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    values = known.groupBy("image", "y", "x").agg((F.sum("light") * F.sin((F.col("y") + 0.5) * math.pi / height)).alias("value"))
    row = Window.partitionBy("image", "y")
    part = F.col("value") / width
    upto = F.sum(part).over(row.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = values.select("image", "y", "x", "value", F.sum(part).over(row).alias("whole"), upto.alias("upto"), F.max("x").over(row).alias("last"))
    shares = lambda d, last: d.withColumn("lo", F.when(F.col("whole") > 0, (F.col("upto") - F.col("part")) / F.col("whole")).otherwise(F.lit(0.0))).withColumn("hi", F.when(last, F.lit(1.0)).when(F.col("whole") > 0, F.col("upto") / F.col("whole")).otherwise(F.lit(0.0)))
    conditional = shares(d.withColumn("part", F.col("value") / width), F.col("x") == F.col("last")).select("image", "y", "x", "value", "lo", "hi")
    rows = values.groupBy("image", "y").agg((F.sum("value") / width).alias("value"))
    whole = Window.partitionBy("image")
    part = F.col("value") / height
    upto = F.sum(part).over(whole.orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = rows.select("image", "y", "value", part.alias("part"), F.sum(part).over(whole).alias("whole"), upto.alias("upto"), F.max("y").over(whole).alias("last"))
    marginal = shares(d, F.col("y") == F.col("last")).select("image", "y", "value", F.col("whole").alias("total"), "lo", "hi")
    return conditional, marginal


def _located(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, cells: int) -> DataFrame:
    """points joined with the one range, lo < at <= hi, that holds each; at 0 the first that is not empty.

    An equal join on as many cells as there are ranges: numbers drawn evenly meet two ranges each on the average, however
    uneven these are.
    """
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))
    held = ranges.where("lo < hi").withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
    inside = (F.col(at) > F.col("lo")) & (F.col(at) <= F.col("hi")) | ((F.col(at) <= 0) & (F.col("lo") == 0))
    return points.withColumn("cell", cell(at)).join(held, [*keys, "cell"]).where(inside).drop("cell")


def density(value: str, row: str, total: str, v: str) -> Column:
    """The density over directions: the pixel's share of the map per solid angle; 0 at the poles and on a dark map."""
    sine = F.sin(F.col(v) * math.pi)
    below = 2 * math.pi * math.pi * sine * F.col(total)
    return F.when((sine > 0) & (F.col(total) > 0) & (F.col(row) > 0), F.col(value) / below).otherwise(F.lit(0.0))


def sample(points: DataFrame, conditional: DataFrame, marginal: DataFrame, width: int, height: int) -> DataFrame:
    """points (image, ru, rv and others, two numbers in [0, 1)) with the place u, v that they fall on and pdf.

    A number is carried to the place within its range that it has in the running total. Points of maps that are not there
    have no row.
    """
    rows = _located(points, marginal.withColumnRenamed("value", "row_value"), ["image"], "rv", height)
    rows = rows.withColumn("v", (F.col("y") + (F.col("rv") - F.col("lo")) / (F.col("hi") - F.col("lo"))) / height).drop("lo", "hi")
    out = _located(rows, conditional, ["image", "y"], "ru", width)
    out = out.withColumn("u", (F.col("x") + (F.col("ru") - F.col("lo")) / (F.col("hi") - F.col("lo"))) / width).drop("lo", "hi")
    return out.withColumn("pdf", density("value", "row_value", "total", "v")).drop("value", "row_value", "total")


def pdf(places: DataFrame, conditional: DataFrame, marginal: DataFrame, width: int, height: int) -> DataFrame:
    """places (image, u, v and others) with pdf, the density with which `sample` falls there; 0 on dark pixels."""
    at = lambda c, n: F.least(F.greatest(F.floor(F.col(c) * n), F.lit(0)), F.lit(n - 1))
    d = places.withColumn("x", at("u", width)).withColumn("y", at("v", height))
    d = d.join(marginal.select("image", "y", F.col("value").alias("row_value"), "total"), ["image", "y"], "left").join(conditional.select("image", "y", "x", "value"), ["image", "y", "x"], "left")
    return d.withColumn("pdf", F.coalesce(density("value", "row_value", "total", "v"), F.lit(0.0))).drop("x", "y", "value", "row_value", "total")
