"""A quality classifier: random-indexing word vectors pooled by document, and a small calibrated network."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.wordhash import blocks, mixed, spans, word_hashes

#: Word buckets, dimensions of a word vector, non-zeros of an index vector, words looked at on either side.
BUCKETS, DIMS, NONZERO, REACH = 1 << 15, 32, 4, 2
#: A word's shape: which of these byte classes it holds (lower, upper, digit, sentence mark, symbol, other bytes).
SHAPES = 64
HIDDEN, EPOCHS, RATE = 24, 400, 0.02
#: Labelled rows that a model is fitted on at most: the bound that keeps fitting a single task's work.
SAMPLE = 4000

_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 4
_CLASS[list(b".,;:'\"()-?")] = 8
_CLASS[list(b"!#*$%&|<>@=+_/\\^~`[]{}")] = 16


@dataclass
class Model:
    """Word vectors, feature scaling, two layers and a temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of label 1."""
        h = np.tanh((pooled - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((h @ self.w2 + self.b2) / self.temperature, -60, 60)))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's non-zero dimensions and their signs, from its number alone."""
    b = np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64)[None, :]
    x = mixed(b, 5)
    return (x % np.uint64(DIMS)).astype(np.int64), np.where(x >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def context_vectors(ids: list[np.ndarray]) -> np.ndarray:
    """Random indexing: a word's vector is the sum of its neighbours' index vectors, made as long as 1, and its own.

    Words of no text here have their own index vector alone.
    """
    dims, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS)
    for text in ids:
        for reach in range(1, REACH + 1):
            for a, b in ((text[:-reach], text[reach:]), (text[reach:], text[:-reach])):
                place = (a[:, None] * DIMS + dims[b]).ravel()
                total += np.bincount(place, weights=signs[b].ravel(), minlength=len(total)) if len(place) > 50_000 else 0
                if len(place) <= 50_000:
                    np.add.at(total, place, signs[b].ravel())
    context = total.reshape(BUCKETS, DIMS)
    length = np.sqrt((context**2).sum(axis=1, keepdims=True))
    own = np.zeros((BUCKETS, DIMS))
    np.add.at(own, (np.arange(BUCKETS)[:, None], dims), signs)
    return (np.divide(context, length, out=np.zeros_like(context), where=length > 0) + own / np.sqrt(NONZERO)).astype(np.float32)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bucket and shape, and the words' offsets by text."""
    starts, _, by = spans(data, offsets)
    hashes, _ = word_hashes(data, offsets)
    # white space between words has no class, so a word's classes end where the word does
    classes = np.where((data == 32) | (data >= 9) & (data <= 13), 0, _CLASS[data])
    shapes = np.bitwise_or.reduceat(classes, starts) if len(starts) else np.zeros(0, dtype=np.uint8)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), shapes.astype(np.int64), by


def pooled(buckets: np.ndarray, shapes: np.ndarray, by: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of each text, the shares of word shapes, and the logarithm of the number of words."""
    n, out = np.diff(by), np.zeros((len(by) - 1, DIMS + SHAPES + 1))
    full = np.flatnonzero(n)
    if len(full):
        out[full, :DIMS] = np.add.reduceat(vectors[buckets], by[:-1][full], axis=0) / n[full, None]
        text = np.repeat(np.arange(len(n)), n)
        out[:, DIMS:-1] = np.bincount(text * SHAPES + shapes, minlength=len(n) * SHAPES).reshape(len(n), SHAPES) / np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n)
    return out


def fit(texts: Iterator[pa.RecordBatch], seed: int = 5) -> Model:
    """A model from batches of text and label (0 or 1). A fifth of the rows is kept apart to set the temperature."""
    ids, shapes, ends, labels = [], [], [0], []
    for part in texts:
        labels += part.column("label").to_pylist()
        for _, data, offsets in blocks(part.column("text")):
            b, s, by = words_of(data, offsets)
            ids += np.split(b, by[1:-1])
            shapes += np.split(s, by[1:-1])
    vectors = context_vectors([x for x in ids if len(x) > REACH])
    for x in ids:
        ends.append(ends[-1] + len(x))
    x = pooled(np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*shapes, np.zeros(0, np.int64)]), np.array(ends), vectors)
    y = np.array(labels, dtype=float)
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w1, b1 = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
    model = Model(vectors, mean, scale, w1, b1, w2, b2, 1.0)
    if len(y) < 10 or y.min() == y.max():  # nothing to learn from: the share of label 1, whatever the text
        share = (y.sum() + 1) / (len(y) + 2)
        model.w2, model.b2 = np.zeros(HIDDEN), float(np.log(share / (1 - share)))
        return model
    order = rng.permutation(len(y))
    hold, learn = order[: len(y) // 5], order[len(y) // 5 :]
    z, t = (x[learn] - mean) / scale, y[learn]
    moments = [[np.zeros_like(np.asarray(p, dtype=float)) for p in (w1, b1, w2, b2)] for _ in range(2)]
    params = [w1, b1, w2, np.asarray(b2, dtype=float)]
    for epoch in range(1, EPOCHS + 1):
        h = np.tanh(z @ params[0] + params[1])
        error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - t) / len(t)
        back = np.outer(error, params[2]) * (1 - h**2)
        grads = [z.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], np.asarray(error.sum())]
        for k, g in enumerate(grads):
            moments[0][k] = 0.9 * moments[0][k] + 0.1 * g
            moments[1][k] = 0.999 * moments[1][k] + 0.001 * g * g
            params[k] = params[k] - RATE * (moments[0][k] / (1 - 0.9**epoch)) / (np.sqrt(moments[1][k] / (1 - 0.999**epoch)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3])

    def loss(temperature: float) -> float:
        model.temperature = temperature
        p = np.clip(model.scores(x[hold]), 1e-9, 1 - 1e-9)
        return float(-(y[hold] * np.log(p) + (1 - y[hold]) * np.log(1 - p)).mean())

    model.temperature = min(np.geomspace(0.5, 8, 40).tolist(), key=loss)
    return model


def score(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and score of each of docs, by a model fitted on labelled (id_col, label), which must be rows of docs.

    The model sees at most `sample` labelled rows, those whose ids hash lowest, and their whole texts, one batch after
    the other in one task; the rest of the work scales with the documents. Rows with a null label or id teach nothing.
    Null and empty texts have a score, that of no words. Without labels of both kinds every score is the share of
    label 1. Other columns are ignored; an empty table gives no rows.
    """
    few = labelled.where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, "label").orderBy(F.xxhash64(id_col), id_col, "label").limit(sample)
    texts = docs.select(id_col, text_col).join(F.broadcast(few), id_col).select(id_col, F.col(text_col).alias("text"), "label").repartition(1).sortWithinPartitions(id_col, "text", "label")
    got = texts.select("text", "label").mapInArrow(lambda parts: iter([pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(parts))]}, schema=pa.schema([("model", pa.binary())]))]), "model binary").first()
    model = pickle.loads(got["model"]) if got else fit(iter(()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in parts:
            for rows, data, offsets in blocks(part.column(1)):
                s = m.scores(pooled(*words_of(data, offsets), m.vectors))
                yield pa.RecordBatch.from_arrays([part.column(0)[rows.start : rows.stop], pa.array(s)], names=[id_col, "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, score double")


def op8_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a fifth of the ids teaches nothing."""
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out).select("doc_id", F.col("quality").alias("label"))
    scores = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels)
    return scores.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
