"""Queries of mattes over the sample tables; DuckDB hashes by lists of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import mattes
from lumenframe.operators import film


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_murmur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of part names and of documents' sources, and the numbers with their bits."""
    named = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    d = named.unionByName(_table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("key"), F.concat_ws("/", "lang", "source").alias("name")))
    d = d.select("key", mattes.murmur(F.col("name")).alias("id"))
    return d.select("key", "id", mattes.scientific(mattes.as_number(F.col("id"))).alias("number"))


def matte_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each brand, by name, with their ids."""
    return mattes.manifest(_table(spark, sf_dir, "part"), "p_brand", "p_name")


def matte_finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four parts with most quantity of each supplier as two layers of ids and shares."""
    lines = _table(spark, sf_dir, "lineitem")
    top = film.top_weights(lines, "l_suppkey", "l_partkey", F.col("l_quantity"), 4)
    counts = lines.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("samples"))
    d = top.join(counts, "l_suppkey").select("l_suppkey", "slot", "weight", "samples", mattes.as_number(mattes.murmur(F.col("l_partkey").cast("string"))).alias("ident"))
    out = mattes.finalise(d, "l_suppkey", "slot", "ident", "weight", F.col("samples"))
    return out.select("l_suppkey", "layer", *[mattes.scientific(F.col(f"id_{k}")).alias(f"id_{k}") for k in (0, 1)], *[F.round(f"weight_{k}", 6).alias(f"weight_{k}") for k in (0, 1)])


def _murmur(text: str) -> str:
    """The hash over a list of byte values, in 128-bit integers."""
    m = 4294967296
    let = lambda x, *steps: _let(x, steps)

    def _let(x: str, steps: tuple[str, ...]) -> str:
        for s in steps:
            x = f"list_transform([{x}], lambda x: {s})[1]"
        return x

    turn = lambda b: f"x * {1 << b} % {m} + x // {1 << (32 - b)}"
    block = lambda k: let(k, f"x * 3432918353 % {m}", turn(15), f"x * 461845907 % {m}")
    number = lambda i, n: " + ".join(f"b[{i} + {k + 1}] * {1 << 8 * k}" for k in range(n))
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::HUGEINT)"
    body = f"list_reduce(list_transform(range(len(b) // 4), lambda i: {block(number('4 * i', 4))}), lambda h, k: {let('xor(h, k)', turn(13), f'(x * 5 + 3864292196) % {m}')}, 0::HUGEINT)"
    tail = f"CASE len(b) % 4 WHEN 1 THEN {block(number('len(b) // 4 * 4', 1))} WHEN 2 THEN {block(number('len(b) // 4 * 4', 2))} WHEN 3 THEN {block(number('len(b) // 4 * 4', 3))} ELSE 0 END"
    end = let(f"xor(xor({body}, {tail}), len(b)::HUGEINT)", "xor(x, x // 65536)", f"x * 2246822507 % {m}", "xor(x, x // 8192)", f"x * 3266489909 % {m}", "xor(x, x // 65536)")
    return f"list_transform([{data}], lambda b: {end})[1]::BIGINT"


_NUMBER = lambda h: f"(CASE WHEN {h} >= 2147483648 THEN -1 ELSE 1 END * (1 + ({h} % 8388608) / 8388608.0::DOUBLE) * 2.0::DOUBLE ** (least(greatest({h} // 8388608 % 256, 1), 254) - 127))"
_SLOTS = "SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_partkey) AS slot, sum(w) OVER (PARTITION BY l_suppkey) AS samples FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) AS g"
_PICK = lambda k, x: f"coalesce(max(CASE WHEN slot % 2 = {1 - k} THEN {x} END), 0)"
SQL = {
    "hash_murmur": f"SELECT key, id, format('{{:.6e}}', {_NUMBER('id')}) AS number FROM (SELECT key, {_murmur('name')} AS id FROM (SELECT p_partkey AS key, p_name AS name FROM part UNION ALL SELECT -1 - doc_id, concat_ws('/', lang, source) FROM documents) AS n) AS h",
    "matte_manifest": f"SELECT p_brand, '{{' || string_agg('\"' || p_name || '\":\"' || lpad(format('{{:x}}', {_murmur('p_name')}), 8, '0') || '\"', ',' ORDER BY p_name) || '}}' AS manifest FROM (SELECT DISTINCT p_brand, p_name FROM part) AS p GROUP BY p_brand",
    "matte_finalise": f"SELECT l_suppkey, CAST((slot - 1) // 2 AS INTEGER) AS layer, " + ", ".join(f"format('{{:.6e}}', {_PICK(k, _NUMBER('id'))}::DOUBLE) AS id_{k}, round({_PICK(k, 'w / samples')}::DOUBLE, 6) AS weight_{k}" for k in (0, 1)) + f" FROM (SELECT *, {_murmur('l_partkey::VARCHAR')} AS id FROM ({_SLOTS}) AS s WHERE slot <= 4) AS t GROUP BY ALL",
}
NATIVE = (hash_murmur, matte_manifest, matte_finalise)
