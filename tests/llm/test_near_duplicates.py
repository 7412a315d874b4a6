"""Near-duplicate classes against brute force, in small buckets and large ones."""

import random
import re

import pytest
from lumenframe.llm import common, order_minhash
from lumenframe.llm.order_minhash import near_duplicates

SCHEMA = "doc_id long, text string, kept string, bucket int"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 0))} or ({tuple(w)} if w else set())


def brute(rows, similarity=0.8):
    """doc_id -> smallest id that links of Jaccard similarity over five-word shingles lead to."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) > 0:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def families(seed, n, size):
    """n texts, each with variants that differ from the one before by a few words, ids shuffled."""
    rnd, texts = random.Random(seed), []
    for _ in range(n):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 160))]
        for _ in range(rnd.randint(1, size)):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(5000)}"
    rnd.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows):
    got = near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got if r["doc_id"] is not None)
    return {r["doc_id"]: r["class_id"] for r in got}


def test_families(spark):
    rows = families(1, 60, 8)
    want = brute(rows)
    assert len(set(want.values())) < len(rows) * 0.6
    assert result(spark, rows) == want


def test_large_buckets(spark, monkeypatch):
    # every bucket is compared by tiles of a few documents, and every document in several pairs counts as hot
    monkeypatch.setattr(order_minhash, "SMALL", 1)
    monkeypatch.setattr(order_minhash, "TILE", 3)
    monkeypatch.setattr(order_minhash, "hot_keys", lambda counts, keys, count, total: counts.where(f"{count} > 2").select(*keys))
    rows = families(2, 25, 14)
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(4, "a b c"), (2, "a b c"), (3, ""), (9, None), (7, long), (8, long + " end"), (1, "same line\n" * 50), (6, "same line\n" * 400)]
    assert result(spark, rows) == brute(rows)
    got = near_duplicates(spark.createDataFrame([(None, "a b c", "x", 1), (5, "a b c", "x", 1), (5, "a b c", "x", 1)], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["class_id"], r["kept"]) for r in got) == [("5", 5, True), ("5", 5, True), ("None", None, True)]


def test_hot_keys_are_few(spark):
    counts = spark.createDataFrame([(k, 10 if k else 2_000_000) for k in range(500)], "k long, n long")
    assert [r["k"] for r in common.hot_keys(counts, ["k"], "n", 3_000_000).collect()] == [0]


@pytest.mark.parametrize("hot", [[], [1], [1, 2, 3]])
def test_spread_join(spark, hot):
    big = spark.createDataFrame([(k % 4, k) for k in range(40)], "k long, v long")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d")], "k long, s string")
    got = common.spread_join(big, small, ["k"], spark.createDataFrame([(h,) for h in hot], "k long"), "v").select("k", "v", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_query(spark, tmp_path):
    rows = families(5, 12, 5)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.op5_order_minhash(spark, str(tmp_path)).collect()} == brute(rows)
