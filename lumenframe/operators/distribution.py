"""Running totals, ranks and cumulative distributions over whole tables, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, key: str, amount: Column, width: int, name: str = "before") -> DataFrame:
    """rows with name, the sum of amounts of all rows with a smaller key; keys are whole numbers that occur once.

    Rows are scanned within ranges of `width` keys, in parallel; the ranges' totals, one row each, are scanned in turn
    and joined back. At a width of a million keys, a million million rows leave a million totals. Sums are exact for
    whole amounts, whatever the order of arrival.
    """
    part = rows.withColumn("__part", F.floor(F.col(key) / width)).withColumn("__amount", amount)
    sums = part.groupBy("__part").agg(F.sum("__amount").alias("__sum"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__part", F.coalesce(F.sum("__sum").over(upto(Window.orderBy("__part"))), F.lit(0)).alias("__base"))
    local = F.coalesce(F.sum("__amount").over(upto(Window.partitionBy("__part").orderBy(key))), F.lit(0))
    return part.withColumn("__local", local).join(bases, "__part").withColumn(name, F.col("__base") + F.col("__local")).drop("__part", "__amount", "__base", "__local")


def cdf(rows: DataFrame, key: str, weight: Column, width: int) -> DataFrame:
    """rows with lo and hi, the range of each in the running total of whole weights, in the order of key."""
    out = running(rows.withColumn("__weight", weight), key, F.col("__weight"), width, "lo")
    return out.withColumn("hi", F.col("lo") + F.col("__weight")).drop("__weight")


def pick(points: DataFrame, at: str, ranges: DataFrame, width: Column) -> DataFrame:
    """points joined with the one range (lo, hi) that holds each, lo <= at < hi; points outside all ranges go.

    An equal join on cells of the given width: a range stands in each cell it touches, so with a width of the mean
    range there are at most two cells a range on average.
    """
    wide = ranges.where("lo < hi").withColumn("__width", width)
    held = wide.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / F.col("__width")), F.floor((F.col("hi") - 1) / F.col("__width")))))
    return points.withColumn("__width", width).withColumn("__cell", F.floor(F.col(at) / F.col("__width"))).drop("__width").join(held.drop("__width"), "__cell").where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("__cell")


def compact(rows: DataFrame, key: str, alive: Column, width: int) -> DataFrame:
    """The rows that are alive, numbered from 0 without gaps in the order of key."""
    return running(rows.where(alive), key, F.lit(1), width, "index")


def ranked(rows: DataFrame, bucket: str, key: str, width: int, name: str = "place") -> DataFrame:
    """rows with their place from 1 within their bucket in the order of key; keys are whole numbers that occur once.

    Places are counted within ranges of `width` keys of a bucket, in parallel, and the ranges' counts are scanned, so a
    bucket of most rows is no window in one task.
    """
    part = rows.withColumn("__part", F.floor(F.col(key) / width))
    counts = part.groupBy(bucket, "__part").count()
    before = Window.partitionBy(bucket).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(bucket, "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy(bucket, "__part").orderBy(key))
    return part.withColumn("__local", local).join(bases, [bucket, "__part"]).withColumn(name, F.col("__base") + F.col("__local")).drop("__part", "__base", "__local")
