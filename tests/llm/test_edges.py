"""Odd keys, clashing names, repeated rows and the contract's columns of the queries that no other module calls."""

import hashlib
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from lumenframe.llm import byte_bpe, chat_format, mixing, quality_model, sharding

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_preference_keys_and_nulls(spark, tmp_path):
    big = 9007199254740994
    rows = [(k, 0, "user", "hi") for k in (-2, -1, big, big + 1, 7)] + [(-1, 1, "assistant", "no"), (big, 1, "assistant", None), (big + 1, 1, None, "x"), (None, 0, "user", "lost")]
    spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, chat_format.op7_preference_pairs(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.sql(chat_format.OP7_SQL).fetchall())
    assert [r[:3] for r in got] == [(-1, -2, -1), (3, None, 7), (big // 2, big, big + 1)]


def test_preference_turns_without_text(spark):
    pairs = spark.createDataFrame([(1, [("user", None), ("assistant", None), None], [("user", ""), ("assistant", "b")])], "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    r = chat_format.preference_pairs(pairs).first()
    assert (r["n_common"], r["chosen_completion"], r["rejected_completion"]) == (1, "<|assistant|>\n\n<||>\n\n", "<|assistant|>\nb\n")
    assert [tuple(s) for s in r["chosen_mask"]] == [(14, 14)] and [r["rejected_completion"][s["start"] : s["end"]] for s in r["rejected_mask"]] == ["b"]
    with pytest.raises(ValueError, match="prompt"):
        chat_format.preference_pairs(pairs.selectExpr("*", "1 AS prompt"))
    assert chat_format.preference_pairs(pairs.where("false")).count() == 0


def test_names_that_clash(spark):
    with pytest.raises(ValueError, match="taken"):
        mixing.mix(spark.createDataFrame([(1, "a", 3, 1)], "doc_id long, source string, size long, taken int"))
    with pytest.raises(ValueError, match="n_tokens"):
        byte_bpe.digest_columns(spark.createDataFrame([(b"", 1)], "ids binary, n_tokens int"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def documents(n=120):
    rnd = np.random.default_rng(4)
    rows = [(int(i) - 3, " ".join(f"{'clean' if i % 3 else 'JUNK$$'}{rnd.integers(50)}" for _ in range(int(rnd.integers(1, 60)))), "en", ["a", "b", "ü", None][i % 4], 0) for i in rnd.permutation(n)]
    return [*rows, (1000, None, "en", "a", None), (1001, "", "en", None, 0), (1002, " \t", "en", "b", 2)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where, rows = tmp_path_factory.mktemp("tables"), documents()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if "JUNK" in (r[1] or "") else 1) for r in rows], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows


def test_sharding_query(spark, tables):
    where, rows = tables
    got = {r["doc_id"]: r for r in sharding.op1_feistel_shards(spark, where).collect()}
    assert {i: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for i, r in got.items()} == {r[0]: (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "rows", None) for r in rows}
    places = sharding.FeistelPermutation(len(rows), 17).place(np.arange(len(rows)))
    for n, i in enumerate(sorted(got)):
        assert (got[i]["row_number"], got[i]["shard"], got[i]["slot"]) == (n, places[n] % 8, places[n] // 8)


def test_mix_query(spark, tables):
    where, rows = tables
    got = {r["doc_id"]: r for r in mixing.op6_golden_mix(spark, where).collect()}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert {i: r["size"] for i, r in got.items()} == size
    by = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in ("a", "b", "ü", None)}
    weight, left, free, target = dict(zip(("a", "b", "ü", None), (5, 2, 1, 5), strict=True)), 1.5 * sum(by.values()), set(by), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by[s]}
        for s in over or free:
            target[s] = min(share[s], 2.0 * by[s])
            left -= target[s]
        free -= over or free
    for r in rows:
        g = got[r[0]]
        assert g["source_size"] == by[r[3]] and g["target"] == pytest.approx(target[r[3]]) and 0 <= g["taken"] <= 2 * g["size"]
    for s in by:
        assert sum(got[r[0]]["taken"] for r in rows if r[3] == s) == pytest.approx(target[s], abs=1)
    again = {r["doc_id"]: r["taken"] for r in mixing.op6_golden_mix(spark, where).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_quality_query(spark, tables):
    where, rows = tables
    got = {r["doc_id"]: r for r in quality_model.op8_random_indexing(spark, where).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    told = [(("JUNK" not in r[1]), got[r[0]]["predicted"]) for r in rows if r[1] and r[1].strip() and got[r[0]]["held_out"]]
    assert sum(a == b for a, b in told) >= 0.9 * len(told) > 9


def test_byte_query(spark, tables):
    where, rows = tables
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    want = []
    for r in rows:
        ids = np.array(known.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()
        want.append((r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = byte_bpe.op10_ranked_merges(spark, where).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline_with_extra_columns_and_repeated_rows(spark, tmp_path):
    rnd = np.random.default_rng(2)
    common = "the of and to in is that it was for on with as at by from".split()
    text = lambda: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice(list("etaoinshrdlu"), 5)) for _ in range(80))
    rows = [(i, text(), "en", "a", 1, 7, "x") for i in range(12)]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame(rows, DOCS + ", kept int, n_words string")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == 14
    left = corpus_pipeline.near_dedup(spark, kept, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(12))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {hashlib.sha256(r[1].encode()).hexdigest() for r in rows}
    assert out and all(r["decoded_sha256"] in texts for r in out)
