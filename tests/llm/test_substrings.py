"""Substring removal against brute force: every level, hot passages, repeated rows, odd rows, the query."""

import hashlib
import os
import random
import re

import pytest
from lumenframe.llm import common, substring_dedup
from lumenframe.llm.substring_dedup import levels, remove_repeats

SCHEMA = "doc_id long, text string, doc string, low int"
GIVEN = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, length=50):
    """(doc_id, n_words, n_removed, words left) of rows of (doc_id, text)."""
    first: dict = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for j in range(length)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def texts(seed, n):
    """Texts that share stretches of 5 to 120 words, cut out of one another and joined anew."""
    rnd = random.Random(seed)
    pool = [" ".join(f"w{rnd.randrange(60 if k % 5 == 0 else 4000)}" for _ in range(rnd.choice((5, 8, 14, 27, 49, 50, 51, 60, 120)))) for k in range(40)]
    return [rnd.choice((" ", "\n", "\t ")).join(rnd.choice(pool) for _ in range(rnd.randrange(0, 6))) for _ in range(n)]


def result(spark, rows, **kw):
    return remove_repeats(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), **kw).collect()


def test_levels():
    assert levels(50) == [7, 13, 25, 50] and levels(20) == [5, 10, 20]


@pytest.mark.parametrize("length", [50, 20])
def test_shared_stretches(spark, length):
    rows = list(enumerate(texts(length, 150)))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], " ".join(words(r["kept"]))) for r in result(spark, rows, length=length)), key=str)
    want = brute(rows, length)
    assert got == want and sum(n for _, _, n, _ in want) > 1000


def test_hot_passages_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "hot_keys", lambda counts, keys, count, total: counts.where("n > 3").select(*keys))
    monkeypatch.setattr(substring_dedup, "hot_keys", common.hot_keys)
    rows = list(enumerate(texts(3, 80)))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], " ".join(words(r["kept"]))) for r in result(spark, rows)), key=str)
    assert got == brute(rows)


def test_odd_rows(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(5, passage), (5, passage), (5, "other " + passage), (None, passage), (9, None), (3, ""), (8, passage + " end"), (8, passage + " end"), (-2, " \t\n"), (12, " ".join(f"q{k}" for k in range(49)))]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], " ".join(words(r["kept"]))) for r in result(spark, rows)), key=str)
    assert got == brute(rows)
    assert all(r["doc"] == "x" and r["low"] == 1 for r in result(spark, rows))


def test_nothing_is_shared(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(200))) for k in range(5)]
    assert all(r["n_removed"] == 0 for r in result(spark, rows))


def test_names_that_clash(spark):
    with pytest.raises(ValueError, match="n_words"):
        remove_repeats(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, n_words int"))


def test_query(spark, tmp_path):
    rows = [*enumerate(texts(9, 60)), (100, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = substring_dedup.op9_doubling_windows(spark, str(tmp_path)).collect()
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows)]
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got), key=str) == want


def test_given_documents(spark):
    """All documents of the given small table, whole."""
    if not os.path.exists(GIVEN):
        pytest.skip("the given tables are not here")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect()]
    got = substring_dedup.op9_doubling_windows(spark, GIVEN).collect()
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows)]
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got), key=str) == want
