"""Multiprobe search against brute force: order of probes, recall, ties, hot copies, odd vectors, the query."""

import itertools
import math

import numpy as np
import pytest
from lumenframe.llm import probe_search as module
from lumenframe.llm.probe_search import SLABS, _best_first, best_of, nearest_products, op12_multiprobe_products

SCHEMA = "vec_id long, embedding array<double>, score string, q int"


def brute(rows, k=20, every=20):
    """Rows of (query_id, rank, vec_id, score); rows are (vec_id, vector)."""
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is not None and i % every == 0:
            near = sorted((-float(sum(x * y for x, y in zip(v, w, strict=True))), j is None, j or 0, j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v))
            out += [(i, r, x[3], -x[0]) for r, x in enumerate(near[:k], 1)]
    return sorted(out, key=str)


def result(spark, rows, **kw):
    d = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in nearest_products(d, **kw).collect()), key=str)


def test_buckets_come_best_first():
    rnd = np.random.default_rng(4)
    chance = rnd.dirichlet(np.full(SLABS, 0.3), 3)
    got = _best_first(chance, 0.9)
    all_ = {a * SLABS**2 + b * SLABS + c: chance[0, a] * chance[1, b] * chance[2, c] for a, b, c in itertools.product(range(SLABS), repeat=3)}
    want = sorted(all_.values(), reverse=True)
    assert len(got) == len(set(got))
    assert np.allclose([all_[x] for x in got], want[: len(got)])
    assert sum(want[: len(got)]) >= 0.9 - 1e-9 > sum(want[: len(got) - 1]) - 1e-9


def test_tiles_give_the_best_of_all(monkeypatch):
    monkeypatch.setattr(module, "WIDE", 50)
    rnd = np.random.default_rng(1)
    q, x = rnd.integers(-2, 3, (6, 4)).astype(float), rnd.integers(-2, 3, (200, 4)).astype(float)
    ids, lows = np.arange(200), rnd.permutation(200).astype(float)
    tiles = [(np.arange(6), ids[a : a + 30], lows[a : a + 30], x[a : a + 30]) for a in range(0, 200, 30)]
    i, cls, _, score = best_of(q, iter(tiles), 7)
    for k in range(6):
        want = sorted((-float(q[k] @ x[j]), lows[j], j) for j in range(200))[:7]
        assert [(-s, lows[c], c) for s, c in zip(score[i == k], cls[i == k], strict=True)] == want


def test_few_vectors_are_all_compared(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.integers(-1, 2, 4).tolist()) for i in range(50)]  # many ties and copies
    assert result(spark, rows, every=5, k=6) == brute(rows, every=5, k=6)


def test_odd_rows(spark):
    good = [1.0, 0.5]
    rows = [(0, good), (0, good), (20, None), (40, []), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [math.nan, 1.0]), (120, [math.inf, 1.0]), (140, [1.0]), (160, [2.0]), (-20, [-1.0, -0.0]), (None, [3.0, 0.0]), (7, [1e200, 1e200]), (180, [1.0, 2.0, 3.0])]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == [] and result(spark, rows[2:8]) == []


def test_hot_copies_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(module, "hot_keys", lambda counts, keys, count, total: counts.where("many > 20").select(*keys))
    rnd = np.random.default_rng(5)
    rows = [(i, [0.6, 0.8, 0.0]) for i in range(100)] + [(100 + i, rnd.standard_normal(3).round(2).tolist()) for i in range(100)]
    assert [r[:3] for r in result(spark, rows, k=5)] == [r[:3] for r in brute(rows, k=5)]


@pytest.mark.parametrize("kind", ["even", "clustered", "lengths"])
def test_recall(spark, kind):
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((4000, 16))
    if kind == "clustered":
        x = rnd.standard_normal((40, 16))[rnd.integers(0, 40, 4000)] + 0.2 * x
    if kind != "lengths":
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, found = result(spark, rows), 0
    for i in range(0, 4000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        mine = [r for r in got if r[0] == i]
        assert len(mine) == 20 and all(abs(s[r[2]] - r[3]) < 1e-12 for r in mine)
        found += len({r[2] for r in mine} & set(np.argsort(-s)[:20].tolist()))
    assert found >= 0.9 * 200 * 20


def test_query(spark, tmp_path):
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.standard_normal(8).tolist()) for i in range(60)]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in op12_multiprobe_products(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(kept)
