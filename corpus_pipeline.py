"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.byte_bpe import digest_columns, encode_column
from lumenframe.llm.common import shared_path, word_count
from lumenframe.llm.mixing import mix
from lumenframe.llm.order_minhash import near_duplicates
from lumenframe.llm.quality_rules import judge
from lumenframe.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The few rejected rows are what the documents are joined with.

    Null and empty texts go; rows that repeat stay or go together; further columns are dropped; no rows give none.
    """
    marked = docs.select(*COLUMNS).withColumn("__mark", F.xxhash64("text"))
    gone = judge(marked).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("__mark").alias("__m")).distinct()
    return marked.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m")), "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id; of rows that repeat one stays.

    Texts without words and rows without an id are like nothing else and stay. No rows give none.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # ids and hashes tell which rows repeat, so that only those are compared as a whole
    mark = F.xxhash64("text")
    twice = docs.groupBy(F.col("doc_id").alias("__id"), mark.alias("__m")).count().where("count > 1").drop("count")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (mark == F.col("__m"))
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that an earlier one has; documents of nothing else go.

    Texts without words and rows without an id stay as they are. No rows give none.
    """
    out = remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its taken words make up its size, to the nearest whole number.

    Texts without words are in no mix; a null source is a source of its own. No rows give none.
    """
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    taken = mix(marked.select("doc_id", "source", "__mark", word_count(F.col("text")).alias("size")))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    uses = taken.groupBy(F.col("doc_id").alias("__id"), F.col("__mark").alias("__m")).agg(F.max(times).alias("__n")).where("__n > 0")
    out = marked.join(uses, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__m")))
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1), "__n"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' byte-level BPE ids, as little-endian unsigned 32-bit integers, and a digest of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = encode_column(docs.select("doc_id", "text", "lang", "source"), path, pattern)
    return digest_columns(out, path, pattern).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mixture), ("byte BPE", tokens)]

#: Alignment of k-mers, tokenizing and hashed order are beyond SQL; tests/llm holds the stages' operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
