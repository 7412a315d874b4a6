"""Token ids against the library, on texts of more distinct words than a worker keeps and on odd ones."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from lumenframe.llm import token_codes
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, start string"


def many_words(n):
    """n distinct words of letters."""
    return " ".join("".join(chr(97 + k // 26**j % 26) for j in range(5)) for k in range(n))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(library, rows):
    out, start = [], 0
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()))):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_more_distinct_words_than_are_kept(spark, library, tmp_path):
    rows = [(0, "aaaaa baaaa zz", None), (1, many_words(600_000), None), (2, "baaaa other zz", None), (3, many_words(10), None)]
    token_codes.write_tokens(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/ids", public_tokenizers.path("word_bpe_49k.json"))
    got = token_codes.read_tokens(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    assert [(r["key"], r["start"], zlib.crc32(r["ids"])) for r in got] == expected(library, rows)


def test_a_small_cache_changes_nothing(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_codes, "CACHE", 20)
    encode = token_codes.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for texts in (["one two", "zwei drei"], [many_words(50), None], ["one two zwei", "日本 one", ""]):
        ids, lengths = encode(pa.array(texts))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_odd_texts(spark, library, tmp_path):
    texts = ["", None, " ", "\n\n", "a\tb", "don't can't I'LL", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "É é ﬁ ſs İi ıI", "½ ² ١٢٣ x2y", "日本語のテキスト", " a b", "a" * 3000, "!!! ... #$%", "Ünïcödé-ÄÖ'S", "🙂🙂 ok", "\x00a\x07b", "- -- —"]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(5, "again", ""), (5, "again", ""), (None, "no key", ""), (-3, "below", "")]
    token_codes.write_tokens(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/ids", public_tokenizers.path("word_bpe_49k.json"))
    got = token_codes.read_tokens(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    assert [(r["key"], r["start"], zlib.crc32(r["ids"])) for r in got] == expected(library, rows)


def test_empty_table(spark, tmp_path):
    token_codes.write_tokens(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/ids", public_tokenizers.path("word_bpe_49k.json"))
    assert token_codes.read_tokens(spark, f"file://{tmp_path}/ids").count() == 0


def test_query(spark, library, tmp_path):
    rows = [(7, "b c", None), (1, "ä", None), (3, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = token_codes.op2_addressable_ids(spark, str(tmp_path)).orderBy("start").collect()
    assert [tuple(r[c] for c in ("doc_id", "start", "ids_crc32")) for r in got] == expected(library, rows)
    assert [r["n_tokens"] for r in got] == [len(library.encode(t or "").ids) + 1 for t in ("ä", "", "b c")]
