"""Reproducible shuffling and sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import numbered

#: Increment and multipliers of the splitmix64 mixer, fixed values.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class FeistelPermutation:
    """A keyed permutation of 0 .. n-1 that anyone can compute from (n, key) alone, in either direction.

    The network permutes a domain of 2^bits >= n values; a value that lands outside 0 .. n-1 is walked along its
    cycle until it is inside, which keeps the map one to one. The domain is under 2 n, so a walk takes two steps on
    average, and it always ends since the start of its cycle is inside.
    """

    def __init__(self, n: int, key: int = 0, rounds: int = 6) -> None:
        self.n, bits = n, max(2, (max(n, 2) - 1).bit_length())
        self.left, self.right = bits // 2, bits - bits // 2
        with np.errstate(over="ignore"):
            self.keys = [_mix(np.array([key * 1_000_003 + i & (1 << 64) - 1], dtype=np.uint64))[0] for i in range(rounds)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        widths = [(self.left, self.right) if i % 2 == 0 else (self.right, self.left) for i in range(len(self.keys))]
        for i in reversed(range(len(self.keys))) if back else range(len(self.keys)):
            a, b = widths[i]  # before the round the high half has a bits, the low half b
            if back:
                low, high = x >> np.uint64(a), x & np.uint64((1 << a) - 1)
                high = high ^ (_mix(low ^ self.keys[i]) & np.uint64((1 << a) - 1))
                x = high << np.uint64(b) | low
            else:
                high, low = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
                high = high ^ (_mix(low ^ self.keys[i]) & np.uint64((1 << a) - 1))
                x = low << np.uint64(a) | high
        return x

    def _walk(self, rows: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(rows).astype(np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The places of row numbers in the shuffled order."""
        return self._walk(rows, False)

    def row(self, places: np.ndarray) -> np.ndarray:
        """The row numbers at places: place() undone."""
        return self._walk(places, True)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(MIX[0])
        x = (x ^ x >> np.uint64(30)) * np.uint64(MIX[1])
        x = (x ^ x >> np.uint64(27)) * np.uint64(MIX[2])
        return x ^ x >> np.uint64(31)


def shard_rows(df: DataFrame, order_by: list[str], n_shards: int, key: int = 0) -> DataFrame:
    """df with row_number, shard and slot: a shuffle of all rows, dealt to n_shards shards.

    Rows are numbered in the order of order_by (nulls first; rows equal there differ in nothing that counts and may
    swap). A row at place p of the permutation goes to shard p mod n_shards, slot p div n_shards, so that shards'
    counts differ by one at most, slots have no gaps, and shard and slot follow from the row number, the number of
    rows and the key. An empty table gives no rows. Columns of df named row_number, shard or slot are an error.
    """
    if clash := {"row_number", "shard", "slot"} & set(df.columns):
        raise ValueError(f"the table already has {sorted(clash)}")
    rows, n = numbered(df, [F.col(c).asc_nulls_first() for c in order_by], "row_number")

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = FeistelPermutation(n, key)
        for part in parts:
            yield pd.Series(p.place(part.to_numpy()))

    at = rows.withColumn("__place", place("row_number"))
    return at.select(
        *rows.columns,
        F.expr(f"cast(__place % {n_shards} as int)").alias("shard"),
        F.expr(f"__place div {n_shards}").alias("slot"),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """The rows of shard_rows() as one folder a shard, each in order of slot; a folder's files follow one another."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`. A null text has size 1 and the checksum of no bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    return shard_rows(docs, ["doc_id", "text_crc32", "size"], 8, key=17).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
