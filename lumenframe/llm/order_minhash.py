"""Near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import components, cut, hot_keys, lean, spread_join
from lumenframe.llm.wordhash import blocks, mixed, ranges, windows, word_hashes

#: Words in a k-mer, k-mers in a sample, and samples. At a similarity of 0.8 a sample is shared with a probability of
#: about 0.6, so all 16 miss less than once in a million pairs.
K, PICKED, SAMPLES = 5, 2, 16
#: Buckets of up to SMALL documents are compared pair by pair, larger ones by tiles of about TILE documents or TILE_KMERS
#: k-mers, some megabytes of text.
SMALL, TILE, TILE_KMERS = 16, 512, 1 << 18
#: Columns of the incidence matrix that are multiplied at once.
WIDE = 4096


def labelled(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct k-mers of words: hashes in the order of their first occurrence, offsets by text, and the
    number of words. A k-mer is labelled by how manieth occurrence in the text it is, and those with another label than
    the first leave: similarity is over distinct k-mers, so that a line which two texts repeat a hundred times makes them
    no more alike than one copy of it. A text of fewer words is one k-mer, an empty one none."""
    hashes, by = word_hashes(data, offsets)
    words = np.diff(by)
    counts = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(at[-1], dtype=np.uint64)
    long = np.repeat(words >= k, counts)
    out[long] = windows(hashes, k)[ranges(by[:-1][words >= k], counts[words >= k])]
    for i in np.flatnonzero((words > 0) & (words < k)):
        out[at[i]] = windows(hashes[by[i] : by[i + 1]], int(words[i]), 7)[0]
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    with np.errstate(over="ignore"):
        own = mixed(out + text * np.uint64(0xD1342543DE82EF95))
    order = np.sort(own)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        some = np.flatnonzero(np.isin(own, twice))
        rank = np.argsort(own[some], kind="stable")
        sorted_ = own[some][rank]
        first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        nth = np.arange(len(some)) - np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))
        first_only = np.ones(len(out), dtype=bool)
        first_only[some[rank[nth > 0]]] = False
        at = np.concatenate([[0], np.cumsum(first_only)])[at]
        out = out[first_only]
    return out, at, words


def sketches(kmers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of SAMPLES hashes for each text: of its PICKED k-mers that are least under a sample's own order, in text order."""
    out = np.zeros((len(at) - 1, SAMPLES), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    starts, sizes = at[:-1][full], np.diff(at)[full]
    most = np.uint64((1 << 64) - 1)
    for s in range(SAMPLES):
        odd = mixed(np.array([s], dtype=np.uint64), 3)[0] | np.uint64(1)
        with np.errstate(over="ignore"):
            x = kmers * odd
            places = []
            for _ in range(PICKED):
                least = np.minimum.reduceat(x, starts)
                hits = np.flatnonzero(x == np.repeat(least, sizes))
                place = hits[np.searchsorted(hits, starts)]
                places.append(place)
                x[place] = most
            places = np.sort(np.stack(places), axis=0)
            sig = np.full(len(full), s, dtype=np.uint64)
            for p in places:
                sig = mixed(sig * np.uint64(0x9FB21C651E98DF25) + kmers[p])
        out[full, s] = sig
    return out


def _sketched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for rows, data, offsets in blocks(part.column("text")):
            kmers, at, words = labelled(data, offsets)
            hashes, by = word_hashes(data, offsets)
            prints = []
            for salt in (11, 12):  # of a text's whole word sequence
                with np.errstate(over="ignore"):
                    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(by[:-1], words).astype(np.uint64)
                    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(hashes ^ mixed(place, salt), salt), dtype=np.uint64)])
                    prints.append(mixed(sums[by[1:]] - sums[by[:-1]] + words.astype(np.uint64), salt).view(np.int64))
            s = sketches(kmers, at).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, SAMPLES, dtype=np.int32)), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc")[rows.start : rows.stop], pa.array(prints[0]), pa.array(prints[1]), pa.array(words.astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), lists], names=["doc", "one", "two", "words", "size", "sketch"])


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Similarity of two texts' distinct k-mers: matched / (all - matched), with matches in the order of both texts.

    A k-mer occurs once in a text, so the best alignment is the longest rising chain of matches. An alignment
    good enough leaves few k-mers of either text out, so only matches within a band about the diagonal count.
    """
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return 0.0
    need = similarity * (len(a) + len(b)) / (1 + similarity)
    oa, ob = np.argsort(a), np.argsort(b)
    sa, sb = a[oa], b[ob]
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    same = sb[at] == sa
    if same.sum() < need - 1e-9:
        return 0.0
    i, j = oa[same], ob[at[same]]
    inside = np.abs(i - j) <= len(a) + len(b) - 2 * need + 1
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        matched = len(j)
    else:
        chain: list[int] = []
        for x in j.tolist():
            p = bisect_left(chain, x)
            chain[p : p + 1] = [x]
        matched = len(chain)
    return matched / (len(a) + len(b) - matched)


def _verified(parts: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def kmers(doc: int, text: str) -> np.ndarray:
        if doc not in held:
            if len(held) > 64:
                held.clear()
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            held[doc] = labelled(raw, np.array([0, len(raw)]))[0]
        return held[doc]

    for part in parts:
        a, b, out = part.column("a").to_pylist(), part.column("b").to_pylist(), []
        for k in range(part.num_rows):
            left, right = kmers(a[k], part.column("text_a")[k].as_py()), kmers(b[k], part.column("text_b")[k].as_py())
            if aligned(left, right, similarity) >= similarity:
                out.append((a[k], b[k]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many k-mers each of a shares with each of b: products of incidence matrices, some columns at a time."""
    size = lambda x: np.array([len(y) for y in x])
    left, right = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    row_a, row_b = np.repeat(np.arange(len(a)), size(a)), np.repeat(np.arange(len(b)), size(b))
    for at in range(0, len(common), WIDE):
        part, found = common[at : at + WIDE], []
        for x, rows, n in ((left, row_a, len(a)), (right, row_b, len(b))):
            place = np.minimum(np.searchsorted(part, x), len(part) - 1)
            hit = part[place] == x
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[rows[hit], place[hit]] = 1
            found.append(m)
        out += found[0] @ found[1].T
    return out


def _tiled(parts: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links between two tiles of a bucket, or within one. Those that join what is joined already are left out."""

    def opened(cell: pa.Scalar) -> tuple[list[int], list[int], list[np.ndarray]]:
        rows = cell.as_py()
        texts = [np.frombuffer((r["text"] or "").encode(), dtype=np.uint8) for r in rows]
        return [r["doc"] for r in rows], [r["part"] for r in rows], [labelled(x, np.array([0, len(x)]))[0] for x in texts]

    for part in parts:
        out = []
        for k in range(part.num_rows):
            same = part.column("same")[k].as_py()
            docs_a, parts_a, a = opened(part.column("left")[k])
            docs_b, parts_b, b = (docs_a, parts_a, a) if same else opened(part.column("right")[k])
            na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            need = similarity * (na[:, None] + nb[None, :]) / (1 + similarity)
            hits = (_overlaps(a, b) >= need - 1e-6) & (np.array(parts_a)[:, None] != np.array(parts_b)[None, :])
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while (y := root.get(x, x)) != x:
                    root[x] = x = root.get(y, y)
                return x

            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(hits, 1) if same else hits)), strict=True):
                x, y = find(parts_a[i]), find(parts_b[j])
                if x != y and aligned(a[i], b[j], similarity) >= similarity:
                    root[max(x, y)] = min(x, y)
                    out.append((docs_a[i], docs_b[j]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, class_id (the smallest id of its class), copy_of and kept (whether it is that one).

    Documents of one word sequence are one class; copy_of is the smallest id with the same words. Two classes are one
    if their distinct k-mers of five words align to similarity or more, directly or by way of others. Documents without
    words (null, empty) and those with a null id are like nothing else and are kept. Ids are taken as unique: rows with
    equal ids and equal words are copies. Other columns are ignored; an empty table gives no rows.

    One pass makes sketches; copies leave after it, as one row by task. A sample that documents share puts them in a
    bucket. First all documents of a bucket are held against its smallest, which links most of a group of copies in as
    many comparisons as it has members. Links within what is linked by then change nothing; buckets that still cross
    components are compared whole: small ones pair by pair, large ones by pairs of tiles, where one matrix product
    tells the k-mers that each two documents share. A component that would fill a tile has its own, which do not meet one
    another. A pair of tiles gives a spanning set of links, never all pairs. No link between components is lost and
    nothing is capped.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = d.where("doc is not null")
    prints = cut(known.mapInArrow(lean(_sketched), "doc long, one long, two long, words long, size long, sketch array<long>"))
    classes = cut(prints.where("words > 0").groupBy("one", "two").agg(F.min("doc").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.count("*").alias("many")))
    rows = classes.select("rep", "size", F.posexplode("sketch").alias("s", "sig"))
    shared = rows.groupBy("s", "sig").count().where("count > 1").select("s", "sig")
    buckets = cut(rows.join(shared, ["s", "sig"]).select(F.xxhash64("s", "sig").alias("bucket"), F.col("rep").alias("doc"), "size"))
    texts = cut(known.join(buckets.select("doc").distinct(), "doc").groupBy("doc").agg(F.min("text").alias("text")))
    fits = (F.least("size", "size_b") >= similarity * F.greatest("size", "size_b"))

    def check(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        total = pairs.count()
        left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
        # a document may be in many pairs on either side; both joins deal such documents to several tasks
        often = lambda c: hot_keys(pairs.groupBy(c).count(), [c], "count", total)
        full = spread_join(spread_join(pairs, left, ["a"], often("a"), "b"), right, ["b"], often("b"), "a")
        return cut(full.select("a", "b", "text_a", "text_b").mapInArrow(lean(lambda p: _verified(p, similarity)), "a long, b long"))

    pivots = cut(buckets.groupBy("bucket").agg(F.min(F.struct("doc", "size")).alias("p"), F.count("*").alias("g")).select("bucket", F.col("p.doc").alias("b"), F.col("p.size").alias("size_b"), "g"))
    large = cut(hot_keys(pivots, ["bucket"], "g", buckets.count()))
    met = spread_join(buckets, pivots.drop("g"), ["bucket"], large, "doc").where(F.col("doc") != F.col("b"))
    star = check(met.where(fits).select(F.col("doc").alias("a"), "b").distinct())
    first = cut(components(star))
    at = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rest = cut(met.select("bucket", "doc", "size").join(at("doc"), "doc", "left").select("bucket", "doc", "size", F.coalesce("doc_root", "doc").alias("part")))
    crossing = rest.groupBy("bucket").agg(F.count("*").alias("g"), F.sum("size").alias("all"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("bucket", "g", "all")
    active = cut(spread_join(rest, crossing, ["bucket"], large, "doc"))
    few = active.where(F.col("g") <= SMALL)
    other = few.select("bucket", F.col("doc").alias("b"), F.col("size").alias("size_b"), F.col("part").alias("part_b"))
    pairs = few.join(other, "bucket").where((F.col("doc") < F.col("b")) & (F.col("part") != F.col("part_b")) & fits).select(F.col("doc").alias("a"), "b").distinct()
    # a part that would fill a tile has tiles of its own, which need not meet one another; the others share tiles
    tiles_of = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("all") / TILE_KMERS))
    many = active.where(F.col("g") > SMALL).select("bucket", "doc", "size", "part")
    parts = many.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("size").alias("all")).withColumn("own", F.when(F.col("n") >= TILE, F.col("part")))
    counts = parts.groupBy("bucket", "own").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).select(F.col("bucket").alias("in"), F.col("own").alias("of"), tiles_of.alias("tiles"))
    parts = cut(parts.join(counts, (F.col("bucket") == F.col("in")) & F.col("own").eqNullSafe(F.col("of"))).select("bucket", "part", "own", "n", "tiles"))
    placed = spread_join(many, parts.drop("n"), ["bucket", "part"], hot_keys(parts, ["bucket", "part"], "n", active.count()), "doc")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles"))).join(texts, "doc")
    tiles = cut(placed.groupBy("bucket", "own", "tile").agg(F.collect_list(F.struct("doc", "part", "text")).alias("held")).withColumn("id", F.monotonically_increasing_id()))
    side = lambda s: tiles.select("bucket", F.col("own").alias(f"own_{s}"), F.col("id").alias(s))
    mixed_a, mixed_b, own_a, own_b = side("a").where("own_a is null"), side("b").where("own_b is null"), side("a").where("own_a is not null"), side("b").where("own_b is not null")
    owners = own_a.select("bucket", "own_a").distinct().join(own_b.select("bucket", "own_b").distinct(), "bucket").where("own_a < own_b")
    meet = mixed_a.join(mixed_b, "bucket").where("a <= b").select("a", "b").unionByName(own_a.join(mixed_b, "bucket").select("a", "b")).unionByName(owners.join(own_a, ["bucket", "own_a"]).join(own_b, ["bucket", "own_b"]).select("a", "b"))
    full = cut(meet).join(tiles.select(F.col("id").alias("a"), F.col("held").alias("left")), "a").join(tiles.select(F.col("id").alias("b"), F.col("held").alias("right")), "b")
    tiled = cut(full.select("left", "right", (F.col("a") == F.col("b")).alias("same")).mapInArrow(lean(lambda p: _tiled(p, similarity)), "a long, b long"))
    # what the pivots joined is one node now
    more = check(pairs).unionByName(tiled).join(at("a"), "a", "left").join(at("b"), "b", "left")
    second = components(more.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    named = classes.select("one", "two", "rep", "many").join(at("rep"), "rep", "left").withColumn("node", F.coalesce("rep_root", "rep")).join(second, "node", "left")
    named = cut(named.select("one", "two", "rep", "many", F.coalesce("root", "node").alias("root")))
    # a large group of exact copies is one key
    copies = hot_keys(named, ["one", "two"], "many", prints.count())
    full = spread_join(prints.where("words > 0").select("doc", "one", "two"), named.drop("many"), ["one", "two"], copies, "doc").select("doc", F.col("root").alias("class_id"), F.col("rep").alias("copy_of"))
    alone = prints.where("words = 0").select("doc", F.col("doc").alias("class_id"), F.col("doc").alias("copy_of"))
    nobody = d.where("doc is null").select("doc", F.col("doc").alias("class_id"), F.col("doc").alias("copy_of"))
    out = full.unionByName(alone).unionByName(nobody)
    return out.select(F.col("doc").alias(id_col), "class_id", "copy_of", F.coalesce(F.col("doc") == F.col("class_id"), F.lit(True)).alias("kept"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of near-duplicates of all documents: five words, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
