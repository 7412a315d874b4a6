"""The operators against brute force, on rows with every oddity at once."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from lumenframe.llm import byte_bpe, chat_format, quality_model, sharding, token_codes
from lumenframe.llm.embedding_dedup import link_vectors
from lumenframe.llm.mixing import mix
from lumenframe.llm.order_minhash import near_duplicates
from lumenframe.llm.quality_rules import judge
from lumenframe.llm.substring_dedup import remove_repeats
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label int"
BASE = [f"w{i * 7919 % 1009}" for i in range(300)]
TEXTS = ["", None, "a b", " ".join(BASE), " ".join(BASE), " ".join(BASE[:150] + ["odd"] + BASE[150:]), " ".join(BASE[100:180] + [f"x{i}" for i in range(200)]), "the same line\n" * 40, "x" * 5000, "\t\n \r", "É n'est  pas\n\n日本 don't 12"]
ROWS = [(i, t, "en" if i % 2 else None, ["s1", None, "s0"][i % 3], None, len((t or "").split()), 1) for i, t in enumerate(TEXTS)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_sharding(docs, empty):
    got = sorted(sharding.shard_rows(docs, ["doc_id"], 3, 5).select("shard", "slot").collect())
    assert got == [(s, k) for s, n in ((0, 4), (1, 4), (2, 3)) for k in range(n)]
    assert sharding.shard_rows(empty, ["doc_id"], 3).count() == 0
    p = sharding.FeistelPermutation(1000, 9)
    assert sorted(p.place(np.arange(1000)).tolist()) == list(range(1000))
    assert (p.row(p.place(np.arange(1000))) == np.arange(1000)).all()


def test_tokens(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = f"file://{tmp_path}/ids"
    token_codes.write_tokens(docs, out, path)
    t, start = Tokenizer.from_file(path), 0
    want = []
    for i, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted((r["key"], r["start"], zlib.crc32(r["ids"])) for r in token_codes.read_tokens(spark, out).collect())
    assert got == want
    first = [*t.encode(TEXTS[2], add_special_tokens=False).ids, 1]
    assert token_codes.token_at(spark, out, want[2][1]) == first[0]


def test_codes():
    ids = np.random.default_rng(3).integers(0, 1 << 20, 5000).astype("<u4")
    c = token_codes.DirectlyAddressable(*token_codes.DirectlyAddressable.encode(ids), len(ids))
    assert (c.all() == ids).all()
    assert all(c[i] == ids[i] for i in range(0, 5000, 37))


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.99, 0.05], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0)} | {i: (0, i) for i in range(3, 10)}


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in judge(docs.drop("size", "label")).collect()}
    assert judge(empty.drop("size", "label")).count() == 0
    for i, t in enumerate(TEXTS):
        w = words(t)
        seen = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {k + j for k, x in enumerate(seen) if seen.count(x) > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == {i: 3 if i in (3, 4, 5) else i for i in range(len(TEXTS))}
    assert near_duplicates(empty).count() == 0


def test_mix(docs, empty):
    rows = mix(docs.select("doc_id", "source", "size")).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.05, abs=5)
    assert mix(empty.select("doc_id", "source", "size")).count() == 0


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c = {r["conv_id"]: r["turns"] for r in chat_format.conversations(turns).collect()}
    pairs = spark.createDataFrame([(1, c[0], c[1]), (2, c[2], None)], "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    a, b = chat_format.preference_pairs(pairs).orderBy("id").collect()
    assert (a["n_common"], a["prompt"], a["chosen_completion"]) == (1, "<|user|>\nhi\n", "<|assistant|>\nyes\n")
    assert [a["chosen_completion"][s["start"] : s["end"]] for s in a["chosen_mask"]] == ["yes"]
    assert (b["n_common"], b["rejected_completion"]) == (0, "")


def test_classifier(spark, empty):
    good = [(i, f"plain words number {i} stand here in a row", 1) for i in range(60)]
    bad = [(100 + i, f"BUY!! {i}$$$ NOW*** ###", 0) for i in range(60)]
    d = spark.createDataFrame(good + bad + [(300, None, None), (301, "", None)], "doc_id long, text string, label int")
    got = {r["doc_id"]: r["score"] for r in quality_model.score(d.select("doc_id", "text"), d.where("doc_id % 3 <> 0").select("doc_id", "label")).collect()}
    assert len(got) == 122 and all(0 <= x <= 1 for x in got.values())
    assert min(got[i] for i in range(0, 60, 3)) > max(got[i] for i in range(102, 160, 3))
    assert quality_model.score(empty.select("doc_id", "text"), empty.select("doc_id", "label")).count() == 0


def test_substrings(docs, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(docs).collect()}
    seen: dict = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if seen.setdefault(tuple(w[k : k + 50]), i) < i for j in range(50)}
        assert got[i] == (len(w), len(gone))
    assert remove_repeats(empty).count() == 0


def test_byte_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    rows = byte_bpe.encode_column(docs, path, public_tokenizers.PATTERN).collect()
    assert [np.frombuffer(r["ids"], dtype="<u4").tolist() for r in sorted(rows)] == [e.encode_ordinary(t or "") for t in TEXTS]
    own = byte_bpe.ByteEncoder(path, public_tokenizers.PATTERN)
    assert [own.decode(r["ids"]) for r in sorted(rows)] == [(t or "").encode() for t in TEXTS]
    assert byte_bpe.encode_column(empty, path, public_tokenizers.PATTERN).count() == 0


