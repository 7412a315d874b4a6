"""Byte-level BPE: a fold of ranked merges over the bytes of distinct words, and its undoing.

The fold was first written with Spark's higher-order functions over a literal rank map. Its results were right, but it
took some hundreds of microseconds a word, and the map made plans of tens of megabytes of text; README has the figures.
So the fold runs in Python, over the same distinct words' bytes and ranks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import kept

#: White space by the Unicode property, which is what the pattern's class means to the tokenizer: fixed values.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most words that a worker keeps encoded. A full cache starts anew, so its memory does not follow the input.
CACHE = 500_000
#: Characters of text that are worked on at once.
BLOCK = 1 << 21


@lru_cache(1)
def ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a line a token, base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def fold(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The ids of one word: its bytes, of which the adjacent pair of least rank is merged, the first such first, until
    no pair has a rank. Ranks of pairs are kept from step to step; a merge changes two."""
    if word in known:
        return [known[word]]
    if len(word) > 256:
        return _fold_long(word, known)
    get, none = known.get, 1 << 60
    parts = [word[i : i + 1] for i in range(len(word))]
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
    while pair:
        least = min(pair)
        if least == none:
            break
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return [known[p] for p in parts]


def _fold_long(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The same for a long word, by a heap of pairs over a linked list: n log n instead of n * n steps."""
    import heapq

    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := known.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[i] != middle or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := known.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[after[i]]))
        if before[i] >= 0 and (r := known.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], i, stop))
    return [known[word[i : end[i]]] for i in range(n) if alive[i]]


class ByteEncoder:
    """Ids of whole texts by ranks, each match of the pattern separately; each distinct word is folded once.

    Where no blank stands next to other white space, a blank begins a match and nothing reaches across it, so texts are
    cut there and the pieces' ids are kept. Other texts are matched as a whole.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = ranks(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        own = pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.match = regex.compile(own).findall
        self.near = re.compile(rf" [{WHITE}]|[{WHITE}] ")
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        words = self.words
        out = []
        for w in self.match(text):
            if (ids := words.get(w)) is None:
                ids = words[w] = np.array(fold(w.encode(), self.ranks), dtype="<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        text = text or ""
        if len(self.known) > CACHE or len(self.words) > CACHE:
            self.known, self.words = {}, {}
        if self.near.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        known = self.known
        for w in set(rest).difference(known):
            known[w] = self._ids(" " + w)
        return self._ids(first) + b"".join([known[w] for w in rest])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for: their tokens, one after the other."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def _encoder(path: str, pattern: str) -> ByteEncoder:
    held = kept("byte_bpe")
    if (path, pattern) not in held:
        held[path, pattern] = ByteEncoder(path, pattern)
    return held[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs without text_col but with ids_col, the ids of each whole text as little-endian unsigned 32-bit integers in a binary.

    Null and empty texts give an empty one. Rows stay where they are: nothing is shuffled, each task keeps the ids of
    words it has met, and a lost executor's tasks are simply run again. An empty table gives no rows. A column of docs
    named ids_col is an error.
    """
    if ids_col in docs.columns:
        raise ValueError(f"the table already has {ids_col}")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern)
        for part in parts:
            texts, at = part.column(0), 0
            while at < len(texts):
                held, size, start = [], 0, at
                while at < len(texts) and size < BLOCK:
                    text = texts[at].as_py()
                    held.append(encode(text))
                    size += len(text or "")
                    at += 1
                rest = [part.column(k)[start:at] for k in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), *rest], names=[ids_col, *part.schema.names[1:]])

    others = [c for c in docs.columns if c != text_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{ids_col}` binary", *[f"`{c}` {kinds[c]}" for c in others]])
    return docs.select(text_col, *others).mapInArrow(run, schema)


def digest_columns(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """encoded with n_tokens, ids_sha256 and decoded_sha256: the ids' number and digest, and that of the bytes they decode to.

    A null ids_col counts as empty. Columns of encoded named like the results are an error.
    """
    if clash := {"n_tokens", "ids_sha256", "decoded_sha256"} & set(encoded.columns):
        raise ValueError(f"the table already has {sorted(clash)}")
    place = encoded.columns.index(ids_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern)
        for part in parts:
            ids = [x or b"" for x in part.column(place).to_pylist()]
            out = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(encode.decode(x)).hexdigest()) for x in ids]
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[*part.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_ranked_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of all documents' ids and of what they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest_columns(encode_column(docs, path, pattern), path, pattern).drop("ids")
