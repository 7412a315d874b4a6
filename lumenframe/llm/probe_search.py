"""Largest inner products by p-stable hashing, whose buckets are probed in the order of their estimated success."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, flat, hot_keys, spread_join

#: Hash tables, the width of a slab in standard deviations of a projection, and slabs of a function: they are numbered
#: from 0 and the outer ones go on without end.
TABLES, WIDTH, SLABS = 2, 2.0, 16
#: A table's functions: so many that a bucket has about BUCKET vectors, if a function tells 2^BITS slabs apart; MOST at most.
BUCKET, BITS, MOST = 64, 1.5, 10
#: The bounded sample of vectors, by number and by components, that tells how far a query's k-th neighbour is.
SAMPLE, SAMPLE_VALUES = 8192, 1 << 20
#: Lengths of vectors that are indexed, the most frequent first. Vectors of other lengths are one bucket by length.
LENGTHS = 8
#: Most vectors of a tile, most queries of a block, and about so many tiles meet a block in one task.
TILE, BLOCK, LOT = 512, 512, 256
#: Columns of the matrix of products that are held at once.
WIDE = 4096
#: Far above what the order of a sum can move a product by, relative to both norms.
SLACK = 1e-11


@dataclass
class Index:
    """The functions for vectors of one length, and what is known of these vectors."""

    count: int
    most: float  # the largest norm
    axes: np.ndarray  # table, component (and the lifted one), function
    shifts: np.ndarray  # table, function
    sample: np.ndarray
    sample_ids: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table. Vectors are lifted to one length, so that the largest inner product
        with a query is the least distance from it: x / most, and what is left to a norm of 1 as one more component."""
        y = x / self.most
        lifted = np.concatenate([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1, keepdims=True)))], axis=1)
        slab = np.clip(np.floor((np.einsum("nd,tdm->ntm", lifted, self.axes) + self.shifts) / WIDTH) + SLABS // 2, 0, SLABS - 1).astype(np.int64)
        return _packed(slab)

    def reach(self, q: np.ndarray, own: int, k: int) -> float:
        """The cosine, among lifted vectors, that the k-th neighbour of a query has about: that of the sample's neighbour of the same rank in proportion, the next nearer one's if there is none."""
        products = (self.sample @ q)[self.sample_ids != own] / (np.sqrt(q @ q) * self.most)
        if not len(products):
            return 0.0
        rank = min(len(products), max(1, math.ceil(k * len(self.sample_ids) / self.count)))
        return float(np.clip(np.partition(products, -rank)[-rank], 0.0, 1 - 1e-9))

    def probes(self, q: np.ndarray, own: int, k: int, target: float) -> list[list[int]]:
        """The buckets of each table that a query looks at, in the order of the estimated success."""
        tables, _, m = self.axes.shape
        if m == 0:
            return [[0]] * tables
        c, unit = self.reach(q, own, k), q / np.sqrt(q @ q)
        spread = math.sqrt(1 - c * c)
        edges = (np.arange(SLABS + 1) - SLABS // 2) * WIDTH
        out = []
        for t in range(tables):
            # a neighbour's projection lies about c times the query's: the chance of each slab is a difference of errors
            mean = c * (unit @ self.axes[t, :-1]) + self.shifts[t]
            z = (edges[None, 1:-1] - mean[:, None]) / (spread * math.sqrt(2))
            below = np.concatenate([np.zeros((m, 1)), 0.5 * (1 + _erf(z)), np.ones((m, 1))], axis=1)
            out.append(_best_first(np.diff(below, axis=1), 1 - (1 - target) ** (1 / tables)))
        return out


_erf = np.vectorize(math.erf, otypes=[float])


def _packed(slabs: np.ndarray) -> np.ndarray:
    """Slabs of the functions (the last axis) as one number; neighbours along the first functions stay near."""
    out = np.zeros(slabs.shape[:-1], dtype=np.int64)
    for i in range(slabs.shape[-1]):
        out = out * SLABS + slabs[..., i]
    return out


def _best_first(chance: np.ndarray, target: float) -> list[int]:
    """Buckets by falling product of their slabs' chances until these add up to target.

    Each function's slabs are ranked by chance; from a bucket the next ones are made by moving the last raised function on
    (shift), by raising the one after it (expand), or by raising that one instead: so each comes up once.
    """
    m = len(chance)
    order = np.argsort(-chance, axis=1, kind="stable")
    ranked = np.take_along_axis(chance, order, axis=1)
    cost = -np.log(np.maximum(ranked / ranked[:, :1], 1e-300))
    # functions by the price of their first step, so that a step is never cheaper than the one it takes the place of
    by = np.argsort(cost[:, 1], kind="stable")
    cost, order, places = cost[by].tolist(), order[by].tolist(), [SLABS ** (m - 1 - int(i)) for i in by]
    start = float(np.prod(ranked[:, 0]))
    code = sum(order[i][0] * places[i] for i in range(m))
    out, total = [code], start
    step = lambda i, r: (order[i][r] - order[i][r - 1]) * places[i]
    # cost, number of the bucket, function raised last, its rank
    heap = [(cost[0][1], code + step(0, 1), 0, 1)]
    while total < target and heap:
        paid, code, i, r = heapq.heappop(heap)
        out.append(code)
        total += start * math.exp(-paid)
        if r + 1 < SLABS:
            heapq.heappush(heap, (paid + cost[i][r + 1] - cost[i][r], code + step(i, r + 1), i, r + 1))
        if i + 1 < m:
            heapq.heappush(heap, (paid + cost[i + 1][1], code + step(i + 1, 1), i + 1, 1))
            if r == 1:
                heapq.heappush(heap, (paid - cost[i][1] + cost[i + 1][1], code - step(i, 1) + step(i + 1, 1), i + 1, 1))
    return out


def _matrix(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch by length of their vectors: the length, which rows, and the vectors."""
    values, at = flat(part.column("v"))
    sizes = np.diff(at)
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        yield int(n), which, values[at[which][:, None] + np.arange(n)].astype(np.float64)


def _hashed(indexes: dict[int, Index]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row a vector and table, with its bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for n, which, x in _matrix(part):
                some, index = part.take(pa.array(which)), indexes.get(n)
                codes = np.zeros((len(which), TABLES), dtype=np.int64) if index is None else index.codes(x)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), n, dtype=np.int32)), pa.array(np.full(len(which), t, dtype=np.int32)), pa.array(codes[:, t]), some.column("cls"), some.column("low"), some.column("v")], names=["dims", "t", "code", "cls", "low", "v"])

    return run


def _asked(indexes: dict[int, Index], k: int, target: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row a query and table, with the buckets that it looks at."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for n, which, x in _matrix(part):
                index, some = indexes.get(n), part.take(pa.array(which))
                own = np.asarray(some.column("cls"))
                probes = [[[0]] * TABLES if index is None else index.probes(q, int(c), k, target) for q, c in zip(x, own, strict=True)]
                for t in range(TABLES):
                    lists = [p[t] for p in probes]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), n, dtype=np.int32)), pa.array(np.full(len(which), t, dtype=np.int32)), pa.array([x[0] for x in lists], pa.int64()), some.column("cls"), some.column("v"), pa.array(lists, pa.list_(pa.int64()))], names=["dims", "t", "home", "cls", "v", "probes"])

    return run


def _numbers() -> Iterator[int]:
    """Numbers that no other task of the stage uses."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def _runs(part: pa.RecordBatch, names: list[str], most: int) -> Iterator[slice]:
    """Slices of consecutive rows that agree in some columns, of `most` rows at most."""
    keys = np.stack([np.asarray(part.column(c)).astype(np.int64) for c in names])
    new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if part.num_rows else np.zeros(0, dtype=np.int64)
    for a, b in zip(new, np.append(new[1:], part.num_rows), strict=True):
        for s in range(a, b, most):
            yield slice(s, min(b, s + most))


def _tiles(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as tiles of one bucket."""
    numbers = _numbers()
    for part in parts:
        for s in _runs(part, ["dims", "t", "code"], TILE):
            some = part.slice(s.start, s.stop - s.start)
            one = lambda c, some=some: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers)]), *[some.column(c)[:1] for c in ("dims", "t", "code")], one(some.column("cls")), one(some.column("low")), one(some.column("v").flatten())], names=["tile", "dims", "t", "code", "ids", "lows", "vecs"])


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted queries as blocks of one table, and for each bucket that any of them looks at, which of them."""
    numbers = _numbers()
    for part in parts:
        for s in _runs(part, ["dims", "t"], BLOCK):
            some = part.slice(s.start, s.stop - s.start)
            values, at = flat(some.column("probes"))
            who = np.repeat(np.arange(some.num_rows, dtype=np.int32), np.diff(at))
            by = np.argsort(values, kind="stable")
            codes, starts = np.unique(values[by], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(by)).astype(np.int32)), pa.array(who[by]))
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers)]), *[some.column(c)[:1] for c in ("dims", "t")], one(some.column("cls")), one(some.column("v").flatten()), one(pa.array(codes)), one(lists)], names=["block", "dims", "t", "ids", "vecs", "codes", "who"])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def best_of(queries: np.ndarray, tiles: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
    """For each query the k vectors with the largest products in the tiles that it looks at, as (query, id, low, product).

    A tile is (which queries, ids, lows, vectors); equal products are ranked by low. A matrix product tells which
    vectors may be among the k; these products are computed anew in one order of summation, so that equal pairs have
    equal ones wherever they meet.
    """
    norms = np.sqrt((queries * queries).sum(axis=1))
    kept = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def close() -> None:
        nonlocal kept
        x = np.concatenate([h[3] for h in held])
        ids, lows = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        products = np.full((len(queries), len(x)), -np.inf)
        at = 0
        for who, _, _, y in held:
            with np.errstate(over="ignore", invalid="ignore"):
                products[who, at : at + len(y)] = queries[who] @ y.T
            at += len(y)
        held.clear()
        open_ = products > -np.inf
        if len(x) > k:
            least = np.partition(products, len(x) - k, axis=1)[:, len(x) - k]
            slack = SLACK * norms * np.sqrt((x * x).sum(axis=1)).max()
            open_ &= ~(products < (least - slack)[:, None])
        i, j = np.nonzero(open_)
        now = (i, ids[j], lows[j], _exact(queries[i], x[j]))
        kept = tuple(np.concatenate(p) for p in zip(kept, now, strict=True))
        by = np.lexsort((kept[1], kept[2], -kept[3], kept[0]))
        kept = tuple(c[by] for c in kept)
        first = np.searchsorted(kept[0], kept[0])
        kept = tuple(c[np.arange(len(by)) - first < k] for c in kept)

    for tile in tiles:
        if held and sum(len(h[3]) for h in held) + len(tile[3]) > WIDE:
            close()
        held.append(tile)
    if held:
        close()
    return kept


def _scored(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of queries against the tiles of one lot."""
    schema = pa.schema([("q", pa.int64()), ("cls", pa.int64()), ("score", pa.float64())])

    def run(block: pa.Table, tiles: pa.Table) -> pa.Table:
        if not block.num_rows or not tiles.num_rows:
            return schema.empty_table()
        n = block.column("dims")[0].as_py()
        get = lambda table, c, r: np.asarray(table.column(c)[r].values)
        ids = get(block, "ids", 0)
        queries = get(block, "vecs", 0).astype(np.float64).reshape(-1, n)
        lows = lambda r: np.asarray(tiles.column("lows")[r].values.cast(pa.float64()).fill_null(np.inf))
        each = ((get(tiles, "who", r), get(tiles, "ids", r), lows(r), get(tiles, "vecs", r).astype(np.float64).reshape(-1, n)) for r in range(tiles.num_rows))
        i, cls, _, score = best_of(queries, each, k)
        return pa.Table.from_arrays([pa.array(ids[i]), pa.array(cls), pa.array(score)], schema=schema)

    return run


def _indexes(classes: DataFrame) -> dict[int, Index]:
    """The functions by length of vector, from counts, norms and a bounded sample. Where norms overflow there are none: all is compared."""
    out = {}
    for r in classes.groupBy("dims").agg(F.count("*").alias("n"), F.max("square").alias("square")).orderBy(F.desc("n"), "dims").limit(LENGTHS).collect():
        n, dims = r["n"], r["dims"]
        m = min(MOST, round(math.log2(n / BUCKET) / BITS)) if n > BUCKET else 0
        size = min(SAMPLE, SAMPLE_VALUES // dims)
        if m <= 0 or size < 2 or not 1e-300 < r["square"] < 1e300:
            continue
        some = classes.where(F.col("dims") == dims).select("h", "cls", "v").orderBy("h", "cls").limit(size).collect()
        rnd = np.random.default_rng(12)
        axes = rnd.standard_normal((TABLES, dims + 1, m))
        out[dims] = Index(n, math.sqrt(r["square"]), axes, rnd.uniform(0, WIDTH, (TABLES, m)), np.array([x["v"] for x in some], dtype=np.float64), np.array([x["cls"] for x in some]))
    return out


def nearest_products(df: DataFrame, k: int = 20, every: int = 20, target: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest inner product found for each row whose id is divisible by `every`: query_id, rank (from 1), id_col, score.

    Candidates are all other rows with a vector of equal length. Vectors that are null, empty or zero, or hold null or
    non-finite components, take no part. Equal scores are ranked by ascending id, rows with a null id last; rows that
    repeat an id are queries and candidates of their own, and one is the other's candidate. A query with fewer
    candidates gets all that are found. Other columns are ignored; an empty table gives no rows.

    Equal vectors are one node with its k + 1 smallest ids, so a large group of copies costs one vector. Vectors are lifted
    to one norm and hashed by TABLES tables of p-stable functions. A query looks at buckets in the order in which they
    probably hold its k-th neighbour, until all tables together miss it with a probability of 1 - target; how near that
    is tells a bounded sample of SAMPLE vectors. Where neighbours are hardly nearer than other vectors, that is
    most buckets. Queries of near buckets make a block, a bucket's vectors tiles; blocks meet tiles by an equal join on
    buckets, in lots of about LOT tiles, so no bucket and no query is one task. A lot gives k + 1 rows a query; those of
    all tables are merged, and scores are products of the vectors as they came.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    v = F.col("v")
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = d.where(F.coalesce(good, F.lit(False))).select("id", F.transform("v", lambda x: x + F.lit(0).cast(kind)).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(5), "v")).withColumn("asks", F.coalesce(F.col("id") % every == 0, F.lit(False))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    classes = rows.groupBy("h", "g").agg(F.first("v").alias("v"), F.max("asks").alias("asks"), F.min("id").alias("low"), F.count("*").alias("many"))
    classes = cut(classes.select("h", "g", "v", "asks", "low", "many", F.size("v").alias("dims"), square.alias("square"), F.monotonically_increasing_id().alias("cls")))
    indexes = _indexes(classes)

    order = ["dims", "t", "code", "cls"]
    hashed = classes.mapInArrow(_hashed(indexes), f"dims int, t int, code long, cls long, low long, v array<{kind}>")
    tiles = cut(hashed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_tiles, f"tile long, dims int, t int, code long, ids array<long>, lows array<long>, vecs array<{kind}>"))
    order = ["dims", "t", "home", "cls"]
    asked = classes.where("asks").mapInArrow(_asked(indexes, k, target), f"dims int, t int, home long, cls long, v array<{kind}>, probes array<long>")
    blocks = cut(asked.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks, f"block long, dims int, t int, ids array<long>, vecs array<{kind}>, codes array<long>, who array<array<int>>"))

    wants = blocks.select("block", "dims", "t", F.explode(F.arrays_zip("codes", "who")).alias("w")).select("block", "dims", "t", F.col("w.codes").alias("code"), F.col("w.who").alias("who"))
    pairs = cut(wants.join(tiles.select("dims", "t", "code", "tile"), ["dims", "t", "code"]).select("block", "tile", "who"))
    lots = cut(pairs.groupBy("block").agg(F.ceil(F.count("*") / LOT).alias("lots")))
    dealt = pairs.join(lots, "block").select("block", "tile", "who", F.pmod(F.xxhash64("tile"), F.col("lots")).alias("lot"))
    held = dealt.join(tiles.select("tile", "ids", "lows", "vecs"), "tile").select("block", "lot", "who", "ids", "lows", "vecs")
    asking = blocks.join(lots, "block").select("block", "dims", "ids", "vecs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))
    found = cut(asking.groupBy("block", "lot").cogroup(held.groupBy("block", "lot")).applyInArrow(_scored(k + 1), "q long, cls long, score double"))

    # of each node the k + 1 rows with the smallest ids; a large group's are found in parts first
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("id"), "row"))
    members = rows.select("h", "g", "id", "row", F.pmod(F.xxhash64("row"), F.lit(64)).alias("part")).withColumn("nth", first("h", "g", "part")).where(F.col("nth") <= k + 1)
    members = members.withColumn("nth", first("h", "g")).where(F.col("nth") <= k + 1).select("h", "g", "id", "row")
    members = members.join(classes.select("h", "g", "cls", "low"), ["h", "g"]).select("cls", "low", "id", "row")
    ahead = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("low"), "cls")
    once = found.dropDuplicates(["q", "cls"]).join(classes.select("cls", "low"), "cls")
    once = once.withColumn("nth", F.row_number().over(ahead)).where(F.col("nth") <= k + 1).select("q", "cls", "score")
    near = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    lists = once.join(members.drop("low"), "cls").withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k + 1)
    lists = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "row", "id", "score"))).alias("near"))

    asking = rows.where("asks").select("h", "g", F.col("id").alias("query_id"), F.col("row").alias("own"))
    of = classes.where("asks").select("h", "g", "many", F.col("cls").alias("q")).join(lists, "q")
    hot = hot_keys(of, ["h", "g"], "many", rows.count())
    each = spread_join(asking, of.select("h", "g", "near"), ["h", "g"], hot, "own")
    best = F.slice(F.filter("near", lambda x: x["row"] != F.col("own")), 1, k)
    out = each.select("query_id", F.posexplode(best).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def op12_multiprobe_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every 20th embedding, against all; odd rows as in `nearest_products`."""
    return nearest_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
