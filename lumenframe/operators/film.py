"""Accumulation of samples into measures by key, their merging, and convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accumulate(samples: DataFrame, key: str, sums: dict[str, Column], first: dict[str, Column], order: list[str]) -> DataFrame:
    """One row a key: the number of samples, sums, and the values of the first sample in a total order.

    All measures are partial aggregates, so samples shrink to one row a key and task before the only shuffle.
    """
    rank = F.struct(*[F.col(c) for c in order])
    return samples.groupBy(key).agg(
        F.count("*").alias("n"),
        *[F.sum(v).alias(k) for k, v in sums.items()],
        *[F.min_by(v, rank).alias(k) for k, v in first.items()],
    )


def merge(parts: DataFrame, key: str, means: list[str], count: str = "n", sums: tuple[str, ...] = (), copies: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Partial results of one key as one: counts and sums add up, means weigh by their counts, copies are those of the first part by `order`."""
    weighted = [(F.sum(F.col(m) * F.col(count)) / F.sum(count)).alias(m) for m in means]
    first = [F.min_by(c, F.struct(order, c)).alias(c) for c in copies]
    return parts.groupBy(key).agg(F.sum(count).alias(count), *weighted, *[F.sum(c).alias(c) for c in sums], *first)


def sampling_error(full: list[Column], half: list[Column], n: Column, exposure: float = 1.0) -> Column:
    """The error of a pixel: how far the sums of all samples are from twice those of every other one, over all channels.

    Both are scaled by exposure / n. The difference is divided by 0.0001 plus the root of the intensity, or plus the
    intensity itself from 1 on.
    """
    scale = F.lit(float(exposure)) / n
    apart = sum((F.abs(x - y) for x, y in zip(full, half, strict=True)), F.lit(0.0)) * scale
    light = sum(full, F.lit(0.0)) * scale
    return apart / (F.lit(0.0001) + F.when(light < 1, F.sqrt(light)).otherwise(light))


def converged(full: list[Column], half: list[Column], n: Column, threshold: float, exposure: float = 1.0, before: Column | None = None) -> Column:
    """Whether a pixel's sampling error is under the threshold, or was before: without a reset it stays converged."""
    now = sampling_error(full, half, n, exposure) < threshold
    return now if before is None else before | now


def top_weights(samples: DataFrame, key: str, item: str, weight: Column, k: int) -> DataFrame:
    """The k items with most weight of each key, by falling weight and then by item.

    Weights are summed by key and item first. Each of 16 salts of a key keeps its k best, and a window over those, 16 k rows
    a key, keeps the k best of all, so a key with many items is 16 smaller windows.
    """
    from pyspark.sql import Window

    by = samples.groupBy(key, item).agg(F.sum(weight).alias("weight"))
    salted = by.withColumn("__salt", F.pmod(F.xxhash64(item), F.lit(16)))
    order = [F.col("weight").desc(), F.col(item)]
    local = salted.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order))).where(F.col("__r") <= k)
    return local.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("slot") <= k).select(key, "slot", item, "weight")
