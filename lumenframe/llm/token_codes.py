"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import flat, shared_path
from lumenframe.llm.wordhash import ranges

#: Widths in bits of the chunk levels: an id's low 8 bits, then the next 8, then 16 for larger vocabularies.
WIDTHS = (8, 8, 16)
#: A rank directory entry counts the continuation bits before each block of this many.
RANK_BLOCK = 512
#: Ids after which a segment is closed; one document never spans segments.
SEGMENT = 1 << 20
#: Most pieces that a worker keeps encoded. A full cache starts anew, so its memory does not follow the input.
CACHE = 300_000
#: Bytes of text that are encoded at once; a longer text is encoded alone.
BLOCK = 1 << 21


class DirectlyAddressable:
    """Ids split into chunks: level 0 has each id's low bits, and a bit tells whether the id goes on in the next level.

    Where it goes on, its place there is the number of set bits before it: a directory entry plus at most RANK_BLOCK
    bits to count. So any id is read by a few lookups, without decoding what stands around it.
    """

    def __init__(self, chunks: list[bytes], bits: list[bytes], ranks: list[bytes], n: int) -> None:
        self.n = n
        self.chunks = [np.frombuffer(c, dtype=f"<u{WIDTHS[k] // 8}") for k, c in enumerate(chunks)]
        self.bits = [np.frombuffer(b, dtype=np.uint8) for b in bits]
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    @staticmethod
    def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """The chunks, continuation bitmaps and rank directories of ids, one of each a level."""
        chunks, bits, ranks, rest = [], [], [], ids.astype(np.uint32)
        for width in WIDTHS:
            chunks.append((rest & np.uint32((1 << width) - 1)).astype(f"<u{width // 8}").tobytes())
            rest = rest >> np.uint32(width)
            more = rest > 0
            counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.int64) if len(more) else np.zeros(0, dtype=np.int64)
            bits.append(np.packbits(more, bitorder="little").tobytes())
            ranks.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
            rest = rest[more]
            if not len(rest):
                break
        return chunks, bits, ranks

    def __getitem__(self, i: int) -> int:
        """Id i, from its chunks alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, shift = 0, 0
        for level, chunk in enumerate(self.chunks):
            out |= int(chunk[i]) << shift
            if not self.bits[level][i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            span = np.unpackbits(self.bits[level][block * RANK_BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            shift += WIDTHS[level]
            i = int(self.ranks[level][block]) + int(span[: i - block * RANK_BLOCK].sum())
        return out

    def all(self) -> np.ndarray:
        """All ids in order, level by level from the last."""
        above = np.zeros(0, dtype=np.uint32)
        for level in reversed(range(len(self.chunks))):
            here = self.chunks[level].astype(np.uint32)
            more = np.unpackbits(self.bits[level], count=len(here), bitorder="little").astype(bool)
            here[more] |= above << np.uint32(WIDTHS[level])
            above = here
        return above


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which is asked for each distinct piece of a word once.

    The tokenizer drops white space and neither its normaliser nor its pieces reach across a blank or a line end, so a
    text's ids are those of what stands between them, one after the other. A word of common letters, digits and marks
    is further cut as the tokenizer cuts it, and the library's model is given the pieces; any other word is given to the
    whole tokenizer as it is. Words, pieces and ids of some megabytes of text are columns; Python sees distinct pieces.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the model's alphabet: a character for each byte; printable bytes stand for themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        letter = [chr(b) if b in shown else chr(next(other)) for b in range(256)]
        self.alphabet = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}
        # apostrophes begin contractions; "<|" begins the strings of special tokens
        self.plain = "^(?:[!-&(-;=-~]|[À-ÖØ-öø-įı-ſ])+$"
        self.cut = re.compile(r"[a-zà-öø-ſß]+|[0-9]|[^a-z0-9à-öø-ſß\n]+|\n")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"\n": 0}
        self.ids, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self, pieces: list[str], whole: bool) -> None:
        """Ids of new pieces, which are put behind those already known."""
        if whole:
            found = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in pieces]
        else:
            tokenize, alphabet = self.model.tokenize, self.alphabet
            found = [[t.id for t in tokenize(x if x.isascii() else x.translate(alphabet))] for x in pieces]
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), dtype=np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) for f in found], dtype=np.int64)])

    def _places(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's number among the known ones, after the new ones are learned.

        The bound on what is kept is looked at before anything is learned, so nothing that these texts need is lost:
        texts of more distinct pieces than CACHE go beyond it until they are done.
        """
        new = [set(part).difference(self.known) for part in (plain, odd)]
        if len(self.known) > 1 and len(self.known) + sum(map(len, new)) > CACHE:
            self._forget()
            new = [set(part).difference(self.known) for part in (plain, odd)]
        for part, whole in zip(new, (False, True), strict=True):
            if part:
                self._learn(sorted(part), whole)
        get = self.known.__getitem__
        return tuple(np.fromiter(map(get, part), dtype=np.int64, count=len(part)) for part in (plain, odd))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has. Null texts are empty."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary
        plain = pc.match_substring_regex(distinct, self.plain)
        odd = distinct.filter(pc.invert(plain)).to_pylist()
        # the pieces of all plain words, with a line end between words
        some = distinct.filter(plain)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), pa.scalar("\n", pa.large_string()))[0].as_py()
        at, own = self._places(self.cut.findall(joined.lower()), odd)
        size = np.diff(self.ends, prepend=0)
        n_plain, by_piece = len(distinct) - len(odd), size[at]
        piece_ids = self.ids[ranges(self.ends[at] - by_piece, by_piece)]
        # ids and sizes of the distinct words: plain ones first
        sizes = np.concatenate([np.bincount(np.cumsum(at == 0), weights=by_piece, minlength=n_plain)[:n_plain].astype(np.int64), size[own]])
        ids = np.concatenate([piece_ids, self.ids[ranges(self.ends[own] - size[own], size[own])]])
        ends = np.cumsum(sizes)
        mask = np.asarray(plain)
        place = np.empty(len(distinct), dtype=np.int64)
        place[mask], place[~mask] = np.arange(n_plain), np.arange(n_plain, len(distinct))
        at = place[words.indices.to_numpy()]
        counts = sizes[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        stops = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))])
        return ids[ranges(ends[at] - counts, counts)], np.diff(total[stops])


ENCODERS: dict[str, WordEncoder] = {}

#: first counts the ids of the part's segments before this one.
SEGMENTS = "part int, seq int, first long, n_tokens long, keys array<long>, null_keys array<boolean>, lengths array<long>, chunks array<binary>, bits array<binary>, ranks array<binary>"


def _encoded(parts: Iterator[pa.RecordBatch], encode: WordEncoder, end_id: int | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, ids and numbers of ids, some megabytes of text at a time."""
    for part in parts:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(part.column("text")), 0), dtype=np.int64))
        row = 0
        while row < part.num_rows:
            stop = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + BLOCK, side="right")))
            ids, lengths = encode(part.column("text")[row:stop])
            if end_id is not None:
                out = np.full(len(ids) + len(lengths), end_id, dtype=np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
                ids, lengths = out, lengths + 1
            yield part.column("key")[row:stop], ids, lengths
            row = stop


def _segments(parts: Iterator[pa.RecordBatch], path: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    where, seq, first = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    kinds = {"part": pa.int32(), "seq": pa.int32(), "first": pa.int64(), "n_tokens": pa.int64(), "keys": pa.list_(pa.int64()), "null_keys": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64())}

    def close() -> pa.RecordBatch:
        keys, ids, lengths = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        chunks, bits, ranks = DirectlyAddressable.encode(ids)
        row = {"part": where, "seq": seq, "first": first, "n_tokens": len(ids), "keys": keys.fill_null(0).to_numpy(), "null_keys": np.asarray(keys.is_null()), "lengths": lengths, "chunks": chunks, "bits": bits, "ranks": ranks}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.list_(pa.binary()))) for k, v in row.items()], names=list(row))

    size = 0
    for keys, ids, lengths in _encoded(parts, ENCODERS[path], end_id):
        ends, doc, at = np.cumsum(lengths), 0, 0
        while doc < len(lengths):
            # up to the document with which the segment has enough
            stop = min(len(lengths), int(np.searchsorted(ends, at + SEGMENT - size)) + 1)
            held.append((keys[doc:stop], ids[at : ends[stop - 1]], lengths[doc:stop]))
            size += int(ends[stop - 1]) - at
            doc, at = stop, int(ends[stop - 1])
            if size >= SEGMENT:
                yield close()
                seq, first, held, size = seq + 1, first + size, [], 0
    if held:
        yield close()


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the ids to `out`, in ascending order of id_col (null first, then by text).

    The file format: Parquet as the container, a row a segment of some SEGMENT ids of whole documents, with the
    documents' keys and lengths and the levels of DirectlyAddressable. Segments follow one another by (part, seq).
    A null text is an empty one; with end_id, each document ends with it. An empty table writes no segment. Texts are
    dealt by range once, before they are encoded, and pass through a task one after the other.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    d = d.repartitionByRange(n, F.col("key").asc_nulls_first(), F.octet_length("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.octet_length("text"), "text")
    d.mapInArrow(lambda parts: _segments(parts, tokenizer, end_id), SEGMENTS).write.option("parquet.block.size", 16 << 20).parquet(out)


def _opened(one: pa.RecordBatch) -> DirectlyAddressable:
    get = lambda c: one.column(c)[0].as_py()
    return DirectlyAddressable(get("chunks"), get("bits"), get("ranks"), get("n_tokens"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids) of each document in the files at path; ids as little-endian unsigned 32-bit integers.

    start counts the ids of all documents before. The driver learns one count a task of the writing, no more.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    starts = _starts(files)

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                one = part.slice(k, 1)
                raw = _opened(one).all().astype("<u4").tobytes()
                lengths = flat(one.column("lengths"))[0]
                ends = np.cumsum(lengths)
                first = starts[one.column("part")[0].as_py()] + one.column("first")[0].as_py()
                keys = pa.array(flat(one.column("keys"))[0], mask=np.array(one.column("null_keys")[0].as_py(), dtype=bool))
                ids = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                for at in range(0, len(ids), 2000):
                    s = slice(at, at + 2000)
                    yield pa.RecordBatch.from_arrays([keys[s], pa.array(first + ends[s] - lengths[s]), pa.array(ids[s], pa.binary())], names=["key", "start", "ids"])

    return files.mapInArrow(decode, "key long, start long, ids binary")


def _starts(files: DataFrame) -> dict[int, int]:
    """The number of each part's first id: one number a task of the writing."""
    out, total = {}, 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        out[part] = total
        total += n
    return out


def token_at(spark: SparkSession, path: str, i: int) -> int:
    """Id number i of all, from one segment and without decoding it."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    part, start = max(((p, x) for p, x in _starts(files).items() if x <= i), key=lambda x: (x[1], x[0]))
    row = files.where((F.col("part") == part) & (F.col("first") <= i - start) & (F.col("first") + F.col("n_tokens") > i - start)).first()
    return DirectlyAddressable(row["chunks"], row["bits"], row["ranks"], row["n_tokens"])[i - start - row["first"]]


def op2_addressable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksums of all documents' ids, from the files they were written to."""
    import public_tokenizers

    path = shared_path(spark, "op2-ids")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
