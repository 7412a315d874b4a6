"""Mattes against known hashes, plain Python and the bits of single precision."""

import json
import random
import struct

from lumenframe.functions import mattes
from pyspark.sql import functions as F

M = (1 << 32) - 1


def murmur(data, seed=0):
    turn = lambda x, b: (x << b | x >> 32 - b) & M
    block = lambda k: turn(k * 0xCC9E2D51 & M, 15) * 0x1B873593 & M
    h, n = seed, len(data) - len(data) % 4
    for i in range(0, n, 4):
        h = (turn(h ^ block(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & M
    if data[n:]:
        h ^= block(int.from_bytes(data[n:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & M
    h = (h ^ h >> 13) * 0xC2B2AE35 & M
    return h ^ h >> 16


def test_known_hashes():
    assert murmur(b"") == 0 and murmur(b"hello") == 0x248BFA47 and murmur(b"The quick brown fox jumps over the lazy dog") == 0x2E4FF723


def test_hashes_and_numbers(spark):
    rnd = random.Random(4)
    texts = ["", "hello", "The quick brown fox jumps over the lazy dog", "é漢字", *["".join(chr(rnd.choice((97, 233, 0x6F22, 0x1F600))) for _ in range(rnd.randrange(40))) for _ in range(60)]]
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", mattes.murmur(F.col("t")).alias("h"), mattes.murmur(F.col("t"), 7).alias("s"))
    rows = d.withColumn("x", mattes.as_number(F.col("h"))).collect()
    for r in rows:
        if r["t"] is None:
            assert r["h"] is None
            continue
        assert r["h"] == murmur(r["t"].encode()) and r["s"] == murmur(r["t"].encode(), 7)
        bits = r["h"] & ~(255 << 23) | min(254, max(1, r["h"] >> 23 & 255)) << 23
        assert r["x"] == struct.unpack("<f", struct.pack("<I", bits))[0]


def test_manifest(spark):
    rows = [("a", 'x "y" \\ z'), ("a", "b"), ("a", "b"), ("b", "é"), ("b", None), ("c", None)]
    got = {r["s"]: json.loads(r["manifest"]) for r in mattes.manifest(spark.createDataFrame(rows, "s string, n string"), "s", "n").collect()}
    want = {"a": ['x "y" \\ z', "b"], "b": ["é"]}
    assert got == {s: {n: f"{murmur(n.encode()):08x}" for n in names} for s, names in want.items()}


def test_finalise(spark):
    d = spark.createDataFrame([(1, 1, 0.5, 6.0), (1, 2, -2.0, 3.0), (1, 3, 7.0, 1.0), (2, 1, 4.0, 5.0)], "p long, slot int, i double, w double")
    got = sorted(map(tuple, mattes.finalise(d, "p", "slot", "i", "w", F.lit(10.0)).collect()))
    assert got == [(1, 0, 0.5, 0.6, -2.0, 0.3), (1, 1, 7.0, 0.1, 0.0, 0.0), (2, 0, 4.0, 0.5, 0.0, 0.0)]


def test_ties_print_as_in_c(spark):
    values = [16683065.0, 16683075.0, -16683065.0, 1234562.5, 123456.25, 12345.125, -4125372.5, 0.0, 1.0, 1.5e-30, 3.780662e4]
    d = spark.createDataFrame([(x,) for x in values], "x double").select("x", mattes.scientific(F.col("x")).alias("text"))
    assert all(r["text"] == f"{r['x']:.6e}" for r in d.collect())
