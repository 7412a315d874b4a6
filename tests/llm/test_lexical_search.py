"""WAND over shards against plain Python: ties, many shards, blocks of queries, odd rows, the query and its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from lumenframe.llm import lexical_search as module
from lumenframe.llm.lexical_search import OP13_SQL, op13_wand_shards, search, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    """Rows of (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, size in counted:
            m = 10 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in search(d, q, **kw).collect()), key=str)


def texts(seed, n, words):
    rnd = random.Random(seed)
    pool = ["wé", "Straße", "x1", "B", *[f"t{int(rnd.paretovariate(0.5))}" for _ in range(400)]]
    return [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(words))) for _ in range(n)]


def test_terms():
    for t in ("Aa_b-C1 Ünï,x\x7fy\x00z", "", " ,.", "漢字かな ABC", "ÀÉ naïve"):
        counts, n = term_counts(t.encode())
        assert {k.decode(): v for k, v in counts.items()} == Counter(terms(t)) and n == len(terms(t))


def test_long_texts_go_piece_by_piece(monkeypatch):
    monkeypatch.setattr(module, "PIECE", 5)
    t = " ".join(texts(4, 20, 30))
    counts, n = term_counts(t.encode())
    assert {k.decode(): v for k, v in counts.items()} == Counter(terms(t)) and n == len(terms(t))


@pytest.mark.parametrize("k", [1, 10])
def test_against_brute_force(spark, k):
    docs, items = list(enumerate(texts(1, 300, 60))), list(enumerate(texts(2, 25, 40)))
    docs += [(1000 + i, t) for i, t in docs[:40]] + [(-5, docs[3][1])]  # ties
    assert result(spark, docs, items, k=k) == brute(docs, items, k)


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "POSTINGS", 50)
    monkeypatch.setattr(module, "BLOCK", 200)
    docs, items = list(enumerate(texts(6, 200, 50))), list(enumerate(texts(7, 12, 30)))
    shard, block = module._searched, module._blocks  # the workers read POSTINGS by the function's module
    assert len(list(block(spark.createDataFrame(items, "item long, text string")))) > 1
    count, total = len([1 for _, t in docs if terms(t)]), sum(len(terms(t)) for _, t in docs)
    vocabulary = {t: i for i, t in enumerate(sorted({x.encode() for _, t in items for x in terms(t)}))}
    df = Counter(x.encode() for _, t in docs for x in set(terms(t)))
    import numpy as np
    import pyarrow as pa

    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) for t in vocabulary])
    parts = [pa.RecordBatch.from_pydict({"doc": [i for i, _ in docs[a : a + 30]], "text": [t for _, t in docs[a : a + 30]]}) for a in range(0, 200, 30)]
    queries = [(i, sorted({vocabulary[x.encode()] for x in terms(t)})) for i, t in items]
    out = list(shard(queries, weights, count, total, 10)(module._postings(vocabulary)(iter(parts))))[0].to_pylist()
    best = {q: sorted(((-r["score"], r["doc"]) for r in out if r["q"] == q)) for q, _ in queries}
    assert sorted(((q, n, d, -s) for q, rows in best.items() for n, (s, d) in enumerate(rows, 1)), key=str) == brute(docs, items)
    assert result(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " ,."), (4, "a b"), (4, "a b"), (None, "a b"), (-7, "a b c"), (9, "word " * 5000)]
    items = [(1, "a"), (1, "A b"), (None, "c word"), (5, None), (6, "nothing"), (7, "")]
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, [], items) == [] and result(spark, docs, []) == [] and result(spark, docs[:3], items) == []


def test_query_and_its_sql(spark, tmp_path):
    docs, items = [*enumerate(texts(11, 150, 80)), (900, None)], list(enumerate(texts(12, 20, 40)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in op13_wand_shards(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == brute(docs, items) == sorted(con.sql(OP13_SQL).fetchall(), key=str)
