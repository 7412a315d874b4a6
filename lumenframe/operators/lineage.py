"""The folder that executors share, where lineage is cut by written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses in spark.checkpoint.dir; where that is unset, local mode makes a folder and a cluster fails."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if place is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        place = tempfile.mkdtemp(prefix="lumenframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and its size is known to the planner."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """df cut, a round's table that is joined by sorting.

    A checkpoint would keep the planner's estimate of what made it; estimates of joins are products, so they grow to numbers
    of millions of digits within some rounds. Files tell the size, but columns of few values are small there and large in
    memory, so a broadcast by that size would fill the driver.
    """
    return cut(df, name).hint("merge")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns, each computed once a row: a filter above a projection would compute them again, above a generator it does not."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with its rows numbered from 0 in the order of some columns, and their count.

    Rows are dealt by range, so no task holds them all. They are written with their place within their task; one count a
    task goes to the driver. Rows that agree in all columns of order are numbered in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("__at", 33).cast("int")
    starts, total = {}, 0
    for r in sorted(placed.groupBy(task.alias("task")).count().collect()):
        starts[r["task"]], total = total, total + r["count"]
    first = F.get(F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts, default=0) + 1)]), task)
    return placed.withColumn(name, first + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at"), total
