"""Ranked lexical search: WAND over shards of documents, whose heaps are merged."""

from __future__ import annotations

import heapq
import math
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, flat

#: Of UTF-8: bytes of ASCII letters and digits and all bytes of other characters make terms, A-Z are lower-cased.
_TERM = (string.ascii_letters + string.digits).encode() + bytes(range(128, 256))
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _TERM else 32 for c in range(256))
#: Bytes of a text whose terms are held at once.
PIECE = 1 << 20
#: Bytes of query text that make a block of queries: its terms go to every task.
BLOCK = 8 << 20
#: Postings of a shard, about 100 MB of lists; a shard is at least one document.
POSTINGS = 1 << 20


def term_counts(text: bytes) -> tuple[Counter, int]:
    """How often each term occurs in a text, and the number of its terms with repeats."""
    counts: Counter = Counter()
    text, at, total = text.translate(TABLE), 0, 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        found = text[at:end].split()
        counts.update(found)
        total, at = total + len(found), end
    return counts, total


def _postings(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document that has terms: its id, their number, and those of the vocabulary with their counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for part in parts:
            ids, sizes, at, terms, times = [], [], [0], [], []
            texts = part.column("text")
            for k in range(part.num_rows):
                counts, n = term_counts(texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b"")
                if n:
                    mine = sorted((vocabulary[t], counts[t]) for t in counts.keys() & known)
                    terms += [t for t, _ in mine]
                    times += [c for _, c in mine]
                    ids.append(part.column("doc")[k].as_py())
                    sizes.append(n)
                    at.append(len(terms))
            lists = lambda x, kind, at=at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists(terms, pa.int32()), lists(times, pa.int64())], names=["doc", "n", "terms", "times"])

    return run


class Shard:
    """Documents in ascending id order, and of each term its documents, what it adds to their scores, and the most of that."""

    def __init__(self, docs: list[int | None], lengths: list[int], at: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, count: int, total: int) -> None:
        order = sorted(range(len(docs)), key=lambda k: (docs[k] is None, docs[k] or 0))
        place = np.empty(len(docs), dtype=np.int64)
        place[order] = np.arange(len(docs))
        self.docs = [docs[k] for k in order]
        # Python's integers: the product may pass 64 bits
        m = np.array([10 + (90 * n * count) // total for n in lengths], dtype=np.int64)
        of = np.repeat(np.arange(len(docs)), np.diff(at))
        impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[of]))
        by = np.lexsort((place[of], terms))
        self.places, self.impacts = place[of][by], impact[by]
        self.terms, starts = np.unique(terms[by], return_index=True)
        self.bounds = np.append(starts, len(by))
        self.lists: dict[int, tuple[list[int], list[int], int]] = {}

    def postings(self, term: int) -> tuple[list[int], list[int], int] | None:
        """The documents, impacts and largest impact of a term; None if no document has it or it adds nothing."""
        if term not in self.lists:
            k = int(np.searchsorted(self.terms, term))
            if k == len(self.terms) or self.terms[k] != term:
                return None
            a, b = self.bounds[k], self.bounds[k + 1]
            self.lists[term] = (self.places[a:b].tolist(), self.impacts[a:b].tolist(), int(self.impacts[a:b].max()))
        found = self.lists[term]
        return found if found[2] > 0 else None

    def search(self, query: list[int], k: int, heap: list[tuple]) -> None:
        """Adds to a heap of at most k (score, rank of id, id), the worst first, what is better among these documents.

        WAND: cursors of terms are held in the order of their documents. The pivot is the first cursor at which the
        sum of largest impacts reaches the score that a document needs; no document before the pivot's can have it, so
        all cursors before jump there. A document at which cursors up to the pivot meet is scored whole.
        """
        lists = [x for x in map(self.postings, query) if x]
        end = len(self.docs)
        state = [[x[0][0], x[2], 0, x[0], x[1]] for x in lists]  # document, most, place in the list, documents, impacts
        need = heap[0][0] if len(heap) == k else 1
        while state:
            state.sort(key=_document)
            reach, pivot = 0, -1
            for c in state:
                reach += c[1]
                pivot += 1
                if reach >= need:
                    break
            if reach < need:
                return
            doc = state[pivot][0]
            if state[0][0] == doc:
                score = 0
                for c in state:
                    if c[0] != doc:
                        break
                    score += c[4][c[2]]
                    c[2] += 1
                    c[0] = c[3][c[2]] if c[2] < len(c[3]) else end
                if score >= need:
                    found = self.docs[doc]
                    entry = (score, found is not None, -(found or 0), found)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry[:3] > heap[0][:3]:
                        heapq.heapreplace(heap, entry)
                    need = heap[0][0] if len(heap) == k else 1
            else:
                for c in state[: pivot + 1]:
                    if c[0] < doc:
                        c[2] = bisect_left(c[3], doc, c[2])
                        c[0] = c[3][c[2]] if c[2] < len(c[3]) else end
            if any(c[0] == end for c in state):
                state = [c for c in state if c[0] < end]


def _document(cursor: list) -> int:
    return cursor[0]


def _searched(queries: list[tuple[int, list[int]]], weights: np.ndarray, count: int, total: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's documents, shard by shard; each query's best of the task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple]] = {q: [] for q, _ in queries}
        held: list[tuple] = []

        def close() -> None:
            docs, lengths = [d for x in held for d in x[0]], [n for x in held for n in x[1]]
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held]))])
            terms, times = (np.concatenate([x[i] for x in held]) for i in (3, 4))
            shard = Shard(docs, lengths, at, terms, times, weights, count, total)
            held.clear()
            for q, mine in queries:
                shard.search(mine, k, heaps[q])

        size = 0
        for part in parts:
            ids, lengths = part.column("doc").to_pylist(), part.column("n").to_pylist()
            (terms, at), (times, _) = flat(part.column("terms")), flat(part.column("times"))
            a = 0
            while a < len(ids):  # as many rows as fit the shard, one at least
                b = max(a + 1, int(np.searchsorted(at, at[a] + POSTINGS - size, side="right")) - 1) if not held or at[a + 1] - at[a] + size <= POSTINGS else a
                if b > a:
                    held.append((ids[a:b], lengths[a:b], at[a : b + 1], terms[at[a] : at[b]], times[at[a] : at[b]]))
                    size += int(at[b] - at[a])
                    a = b
                if a < len(ids):
                    close()
                    size = 0
        if held:
            close()
        out = [(q, x[3], x[0]) for q, heap in heaps.items() for x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["q", "doc", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries as (id, distinct terms in order), some BLOCK bytes of text at a time."""
    held, size = [], 0
    for r in items.toLocalIterator():
        raw = (r["text"] or "").encode()
        if held and size + len(raw) > BLOCK:
            yield held
            held, size = [], 0
        held.append((r["item"], sorted(term_counts(raw)[0])))
        size += len(raw)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The k documents with the highest scores above 0 for each row of items: item_col, rank (from 1), id_col, score.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A term's weight
    falls with the number of documents that hold it, what it adds to a score rises with its occurrences and falls with
    the document's length; weights are integers, and so are scores. Equal scores are ranked by ascending id, a null id
    last. Null and empty texts have no terms and are found by nothing; a query without terms, or with none that a
    document holds, gets no rows. Rows that repeat are documents or queries of their own: a repeated item_col has its
    ranks twice. Other columns are ignored; an empty table on either side gives no rows.

    Queries are read in blocks of BLOCK bytes, so that a block's terms may go to every task whatever the number of
    queries. One pass over the documents writes the postings of these terms; a second searches them without a shuffle:
    a shard is what a task has read, POSTINGS at most or one document. A heap goes on from shard to shard of a task, so
    later ones skip more. Only the heaps' rows are shuffled: k a query and task, of which each task passes on k.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    result = None
    for block in _blocks(items.select(F.col(item_col).cast("long").alias("item"), F.col(query_col).alias("text"))):
        terms = sorted({t for _, mine in block for t in mine})
        vocabulary = {t: i for i, t in enumerate(terms)}
        table = cut(d.mapInArrow(_postings(vocabulary), "doc long, n long, terms array<int>, times array<long>"))
        count, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = np.zeros(len(terms), dtype=np.int64)
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a number a term of the block
            held[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for df in held.tolist()], dtype=np.int64)
        queries = [(q, [vocabulary[t] for t in mine if held[vocabulary[t]]]) for q, (_, mine) in enumerate(block)]
        found = table.mapInArrow(_searched(queries, weights, count, total, k), "q long, doc long, score long")
        best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "q long, item long")
        part = ranked.join(F.broadcast(names), "q").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long") if result is None else result


def op13_wand_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item; see `search` for odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(terms)) AS words FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) AS u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term) AS f, s),
t AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS adds FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(adds) AS BIGINT) AS score FROM q JOIN t USING (term) GROUP BY item_id, doc_id HAVING sum(adds) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) AS x WHERE rank <= 10
"""
