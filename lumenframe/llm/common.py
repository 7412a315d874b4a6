"""What several operators share: the shared folder, words, row numbers, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset in local mode one is made; on a cluster that is an error."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again.

    Its lineage ends there, so a lost executor costs no recomputation, and its size is known to the planner: a
    checkpoint would keep the guess made for its plan, which multiplies from join to join in a loop.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df written once to the shared folder, dealt to buckets by keys and read again.

    Joins on the same keys then read it without a shuffle, however many follow. Its name leaves the catalog at once; the
    files stay like those of cut.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lumenframe_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", shared_path(spark, "bucketed")).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


#: What a worker keeps from task to task, by operator.
KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What this worker keeps for an operator. What it keeps for others goes: a worker lives on from stage to stage."""
    for other in KEPT.keys() - {name}:
        KEPT.pop(other)
    return KEPT.setdefault(name, {})


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, by a worker that first drops what other operators keep in it and gives freed memory back at the end."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(name)
        try:
            yield from run(parts)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return task


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has."""
    return F.size(words(text)).cast("long")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column without null elements as its values and each row's offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(lengths)])


#: A key of more than 1 in HOT of all rows is dealt to SALTS places.
HOT, SALTS = 1000, 32


def hot_keys(counts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """The keys that hold more than one in HOT of all rows, so HOT keys at most; none in small tables."""
    return counts.where(F.col(count) > max(10_000, total // HOT)).select(*keys)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, by: str) -> DataFrame:
    """big joined with small, of which a key has few rows, on equal keys.

    Rows of big with a key in hot (a table of HOT rows at most, which is broadcast) are dealt to SALTS places by the hash
    of column `by`, and such rows of small stand in each place. So no key is one task, however many rows have it.
    """
    mark = F.broadcast(hot.distinct().withColumn("__hot", F.lit(True)))
    left = big.join(mark, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    right = small.join(mark, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("__hot")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """df with its rows numbered from 0 in a total order, and their count.

    Rows are dealt by range, so no task holds them all. What goes to the driver is one count a partition. The ordered
    rows are checkpointed first: the counts and the numbers then come from the same partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = "__tie"
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *order, F.col(tie))
    shared_dir(spark)
    fixed = ranged.sortWithinPartitions(*order, F.col(tie)).drop(tie).checkpoint()
    per = dict(fixed.groupBy(F.spark_partition_id().alias("p")).count().collect())
    starts, total = {}, 0
    for p in sorted(per):
        starts[p] = total
        total += per[p]
    if not per:
        return fixed.withColumn(name, F.lit(0).cast("long")), 0
    # monotonically_increasing_id counts from 2^33 times the partition's number
    first = F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(per) + 1)])
    at = F.monotonically_increasing_id()
    row = F.get(first, F.shiftright(at, 33).cast("int")) + at.bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.withColumn(name, row), total


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b): root is the smallest node that edges lead to.

    Alternating large-star and small-star rounds: each is one aggregation and one join over the edges, so nothing is
    gathered on the driver but two sums that tell when the edges stand still. Needs about log(longest chain) rounds.
    Nulls link nothing. An empty input gives an empty result.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        d = both(e)
        low = d.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = d.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        kept = e.join(low, "a")
        e = cut(
            kept.select("a", F.col("m").alias("b"))
            .unionByName(kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
