"""Near-duplicate vectors against brute force: several tiles and cells, early stops, odd vectors, mixed lengths."""

import numpy as np
import pytest
from lumenframe.llm import embedding_dedup
from lumenframe.llm.embedding_dedup import link_vectors

SCHEMA = "vec_id long, embedding array<double>, label string, node string, lead int"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id) of rows of (vec_id, vector, label)."""
    ok = [v is not None and g is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, g in rows]
    groups: dict = {}
    for k, (_, v, g) in enumerate(rows):
        if ok[k]:
            groups.setdefault((g, len(v)), []).append(k)
    links, root = [0] * len(rows), list(range(len(rows)))
    for held in groups.values():
        x = np.array([rows[k][1] for k in held], dtype=float)
        u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        hit = u @ u.T >= threshold
        np.fill_diagonal(hit, False)
        label = np.arange(len(held))
        while True:
            new = np.minimum(label, np.where(hit, label[None, :], len(held)).min(axis=1))
            if (new == label).all():
                break
            label = new
        for i, k in enumerate(held):
            links[k] = int(hit[i].sum())
            root[k] = held[label[i]]
    least: dict = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], links[k], least[root[k]]) for k in range(len(rows)))


def result(spark, rows):
    d = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], g, "x", 1) for i, v, g in rows], SCHEMA)
    got = link_vectors(d).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 128)


def clustered(n, dims, rnd, spread):
    """Unit vectors about some centres, with variances that fall from axis to axis."""
    centres = rnd.normal(size=(40, dims)) * np.geomspace(4, 0.1, dims)
    return centres[rnd.integers(0, 40, n)] + rnd.normal(size=(n, dims)) * spread


def test_many_vectors(spark, small_tiles):
    rnd = np.random.default_rng(6)
    x = clustered(3000, 64, rnd, 0.22)
    x[100:160] = x[7]  # copies
    rows = [(int(i), v.tolist(), "ab"[int(i % 7 > 4)]) for i, v in zip(rnd.permutation(3000), x, strict=True)]
    want = brute(rows)
    assert 2000 < sum(n for _, n, _ in want) < 2_000_000 and len({r for *_, r in want}) > 50
    assert result(spark, rows) == want


def test_links_at_the_threshold(spark):
    c = 0.93
    rows = [(1, [1, 0, 0, 0], "a"), (2, [0.93, (1 - c * c) ** 0.5, 0, 0], "a"), (3, [0.9299999, (1 - 0.9299999**2) ** 0.5, 0, 0], "a"), (4, [93.0, 0, (100**2 - 93.0**2) ** 0.5, 0], "b"), (5, [7.0, 0, 0, 0], "b")]
    assert result(spark, rows) == brute(rows)


def test_odd_vectors_and_mixed_lengths(spark):
    rows = [(0, [1, 0], "a"), (1, [1, 0.01], "a"), (2, [1, 0, 0], "a"), (3, [1, 0, 0.01], "a"), (4, [2, 0], "b"), (5, None, "a"), (6, [0, 0], "a"), (7, [float("nan"), 1], "a"), (8, [1, None], "a"), (9, [1, 0], None), (10, [], "a"), (11, [float("inf"), 1], "a"), (12, [5], "a"), (13, [3], "a"), (14, [-3], "a"), (15, [-0.0, 1], "a"), (16, [0.0, 2], "a"), (17, list(range(1, 1500)), "a"), (18, list(range(2, 1501)), "a")]
    assert result(spark, rows) == brute(rows)


def test_repeated_rows(spark):
    rows = [(1, [1, 0], "a"), (1, [1, 0], "a"), (1, [0, 1], "a"), (2, [0, 1], "a")]
    assert result(spark, rows) == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_empty_table(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    rnd = np.random.default_rng(3)
    x = clustered(400, 16, rnd, 0.2)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute([(i, np.array(v, dtype=np.float32).astype(float).tolist(), g) for i, v, g in rows])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.op3_pca_tiles(spark, str(tmp_path)).collect()) == want
