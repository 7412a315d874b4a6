"""Near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import components, cut, flat

#: Most vectors and most components that a tile holds.
TILE, TILE_VALUES = 1024, 1 << 17
#: Leading axes that order the tiles and bound their boxes, and those along which cells bring near boxes together.
LEAD, GRID = 4, 2
#: Lengths with axes of their own, the most frequent first, and the most numbers that all axes hold together. Vectors of
#: other lengths are compared along their components as they come: the bounds hold for any axes.
LENGTHS, AXES = 8, 1 << 21
#: Leading dimensions after which a pair's bound is looked at again.
STEPS = (8, 24)
#: Far above what rounding can move a cosine by; pairs this near the threshold are computed anew as they came.
SLACK = 1e-9


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """The axes of the unit vectors' second moments, by falling variance. dims rows of dims sums go to the driver."""

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for part in parts:
            x = _unit(flat(part.column("v"))[0].reshape(-1, dims).astype(np.float64))
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(dims), "row": list(total)}, schema=pa.schema([("i", pa.int64()), ("row", pa.list_(pa.float64()))]))

    # rounded, so that the order in which partial sums come changes nothing
    sums = vectors.select("v").mapInArrow(partial, "i long, row array<double>").groupBy("i").agg(*[F.sum(F.round(F.get("row", F.lit(j)) * 1e6).cast("long")).alias(f"c{j}") for j in range(dims)])
    moments = np.zeros((dims, dims))
    for r in sums.collect():
        moments[r["i"]] = [r[f"c{j}"] for j in range(dims)]
    moments = (moments + moments.T) / 2
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Axes:
    """The axes by length of vector; a length without axes of its own keeps its components."""

    def __init__(self, by_length: dict[int, np.ndarray]) -> None:
        self.by_length = by_length

    def turn(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the order of the axes."""
        axes = self.by_length.get(x.shape[1])
        return _unit(x) if axes is None else _unit(x) @ axes

    def lead(self, x: np.ndarray) -> np.ndarray:
        """The leading LEAD coordinates; missing ones are 0."""
        out = np.zeros((len(x), LEAD))
        turned = self.turn(x)[:, :LEAD]
        out[:, : turned.shape[1]] = turned
        return out


def _morton(lead: np.ndarray) -> np.ndarray:
    """The place of each point along a curve that keeps near points near: the bits of all coordinates in turn."""
    cell = np.clip((lead + 1) * 512, 0, 1023).astype(np.int64)
    out = np.zeros(len(lead), dtype=np.int64)
    for bit in range(10):
        for i in range(LEAD):
            out |= (cell[:, i] >> bit & 1) << (LEAD * bit + LEAD - 1 - i)
    return out


def _tiles(parts: Iterator[pa.RecordBatch], axes: _Axes) -> Iterator[pa.RecordBatch]:
    """Sorted nodes as tiles: each has consecutive nodes of one group and length, and a box along the leading axes."""
    from pyspark import TaskContext

    first, seq, held, group, label = TaskContext.get().partitionId() << 32, 0, [], None, None

    def close() -> pa.RecordBatch:
        x = np.array([v for _, _, v in held])
        lead = axes.lead(x)
        row = {"tile": first + seq, "dims": x.shape[1], "ids": [i for i, _, _ in held], "many": [m for _, m, _ in held], "vecs": x.ravel(), "lo": lead.min(axis=0), "hi": lead.max(axis=0)}
        columns = [pa.array([row[c]], k) for c, k in (("tile", pa.int64()), ("dims", pa.int32()), ("ids", pa.list_(pa.int64())), ("many", pa.list_(pa.int64())), ("vecs", pa.list_(pa.float64())), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())))]
        return pa.RecordBatch.from_arrays([label, *columns], names=["g", *row])

    for part in parts:
        groups = part.column("g").to_pylist()
        ids, many = part.column("node").to_pylist(), part.column("many").to_pylist()
        values, at = flat(part.column("v"))
        for k in range(part.num_rows):
            mine = (groups[k], at[k + 1] - at[k])
            if held and (mine != group or len(held) == TILE or (len(held) + 1) * mine[1] > TILE_VALUES):
                yield close()
                seq, held = seq + 1, []
            if not held:
                group, label = mine, part.column("g").slice(k, 1)
            held.append((ids[k], many[k], values[at[k] : at[k + 1]].astype(np.float64)))
    if held:
        yield close()


def linked(a: np.ndarray, b: np.ndarray, axes: _Axes, threshold: float) -> np.ndarray:
    """A matrix of which rows of a and b have a cosine of threshold or more.

    Unit vectors are turned to the axes. The products of the leading dimensions are summed first; what the others can
    still add is at most the product of both suffix norms. Pairs whose sum and bound stay under the threshold are out,
    and the comparison stops when none is left. Rounding is no risk: pairs within SLACK of the threshold are computed
    from the vectors as they came.
    """
    p, q = axes.turn(a), axes.turn(b)
    dims = p.shape[1]
    suffix = lambda x, k: np.sqrt((x[:, k:] ** 2).sum(axis=1))
    sums, done = np.zeros((len(p), len(q))), 0
    for k in [s for s in STEPS if s < dims]:
        sums += p[:, done:k] @ q[:, done:k].T
        done = k
        open_ = sums + np.outer(suffix(p, k), suffix(q, k)) >= threshold - SLACK
        rows, cols = open_.any(axis=1), open_.any(axis=0)
        if not rows.any():
            return np.zeros(sums.shape, dtype=bool)
        if open_.mean() < 0.02:  # few pairs: finish them alone
            i, j = np.nonzero(open_)
            out = np.zeros(sums.shape, dtype=bool)
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                rest = sums[x, y] + np.einsum("ij,ij->i", p[x, done:], q[y, done:])
                out[x, y] = _decided(rest, a, b, x, y, threshold)
            return out
    sums += p[:, done:] @ q[:, done:].T
    out = sums >= threshold
    x, y = np.nonzero(np.abs(sums - threshold) <= SLACK)
    out[x, y] = _decided(sums[x, y], a, b, x, y, threshold)
    return out


def _decided(sums: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    out = sums >= threshold
    for k in np.nonzero(np.abs(sums - threshold) <= SLACK)[0]:
        u, v = a[x[k]], b[y[k]]
        out[k] = np.dot(u, v) / (np.sqrt(np.dot(u, u)) * np.sqrt(np.dot(v, v))) >= threshold
    return out


def _grouped(hit: np.ndarray) -> np.ndarray:
    """For a symmetric or bipartite hit matrix of one set of nodes: the smallest node of each node's component."""
    label = np.arange(len(hit))
    while True:
        low = np.where(hit, label[None, :], len(hit)).min(axis=1, initial=len(hit))
        new = np.minimum(label, low)
        np.minimum.at(new, label, new.copy())  # a component's root learns what its nodes found
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(parts: Iterator[pa.RecordBatch], axes: _Axes, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each pair of tiles: per vector how many others it links with there, and one node of its component there."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    for part in parts:
        for k in range(part.num_rows):
            one = part.slice(k, 1)
            get = lambda c: flat(one.column(c))[0]  # noqa: E731, B023
            dims = one.column("dims")[0].as_py()
            ids, many = get("ids_a"), get("many_a")
            a = get("vecs_a").reshape(-1, dims)
            if one.column("same")[0].as_py():
                hit = linked(a, a, axes, threshold)
                np.fill_diagonal(hit, False)
                links, nodes = hit @ many, ids
            else:
                b, other, others = get("vecs_b").reshape(-1, dims), get("ids_b"), get("many_b")
                cross = linked(a, b, axes, threshold)
                links, nodes = np.concatenate([cross @ others, cross.T @ many]), np.concatenate([ids, other])
                if not cross.any():
                    continue
                hit = np.zeros((len(nodes), len(nodes)), dtype=bool)
                hit[: len(a), len(a) :], hit[len(a) :, : len(a)] = cross, cross.T
            some = np.nonzero(links)[0]
            if len(some):
                roots = _grouped(hit[np.ix_(some, some)])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[some][roots])], schema=schema)


def _near(tiles: DataFrame, width: float) -> DataFrame:
    """(a, b) of tiles of one group and length whose boxes are no further apart than width, each pair once, a <= b.

    Boxes grown by half the width on all sides meet if they are near enough. Each stands in the cells that it touches,
    so an equal join on cells finds the pairs; a pair is taken in the cell where the common part begins.
    """
    cell = lambda x: F.floor(x / width).cast("int")
    lo = lambda s, i: F.get(f"{s}lo", F.lit(i)) - width / 2
    hi = lambda s, i: F.get(f"{s}hi", F.lit(i)) + width / 2
    d = tiles.select("g", "dims", "tile", "lo", "hi")
    for i in range(GRID):
        d = d.withColumn(f"c{i}", F.explode(F.sequence(cell(lo("", i)), cell(hi("", i)))))
    cells = [f"c{i}" for i in range(GRID)]
    a = d.select("g", "dims", *cells, F.col("tile").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = d.select("g", "dims", *cells, F.col("tile").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    gap = lambda i: F.greatest(F.lit(0.0), F.get("a_lo", F.lit(i)) - F.get("b_hi", F.lit(i)), F.get("b_lo", F.lit(i)) - F.get("a_hi", F.lit(i)))
    apart = sum((gap(i) * gap(i) for i in range(LEAD)), F.lit(0.0))
    met = a.join(b, ["g", "dims", *cells]).where((F.col("a") <= F.col("b")) & (apart <= width * width))
    for i in range(GRID):
        met = met.where(F.col(f"c{i}") == cell(F.greatest(lo("a_", i), lo("b_", i))))
    return met.select("dims", "a", "b")


def link_vectors(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """One row a vector: id_col, n_links, component_id, kept. Links join vectors of equal group_col and length with a cosine of threshold or more.

    Vectors that are null or zero or hold null or non-finite components, and vectors without a group or an id, link with
    nothing and are their own component; a null id gives a null component_id and is kept. Rows that repeat an id are
    vectors of their own, each with its links. An empty table gives no rows; other columns are ignored.

    Equal vectors of a group are compared once, as one node with a count, so a large group of copies costs one row.
    Nodes are sorted along a curve through the leading principal axes, in ranges over all tasks, and each run of some
    hundred is a tile. Only tiles meet whose boxes along these axes are no further apart than two linked unit vectors can
    be. A pair of tiles yields a row or two a vector, never its links: counts add up, and a node of each local component
    suffices for connectedness.
    """
    spark = df.sparkSession
    v = F.col("v")
    d = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(group_col).alias("g"))
    good = F.col("g").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    d = cut(d.withColumn("good", good))
    alone = d.where(~F.col("good")).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    # adding 0.0 makes -0.0 and 0.0 one value
    rows = d.where("good").select("id", "g", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumn("h", F.xxhash64("v"))
    nodes = cut(rows.groupBy("g", "h", "v").agg(F.min("id").alias("low"), F.count("*").alias("many")).withColumn("node", F.monotonically_increasing_id()))
    found, left = {}, AXES
    for r in nodes.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(LENGTHS).collect():
        if r["dims"] ** 2 <= left:
            found[r["dims"]] = principal_axes(nodes.where(F.size("v") == r["dims"]), r["dims"])
            left -= r["dims"] ** 2
    axes = spark.sparkContext.broadcast(_Axes(found))
    # two unit vectors with cosine c differ by sqrt(2 - 2c) along any axis at most
    width = max(1e-6, (2 - 2 * min(threshold, 1.0)) ** 0.5) + 1e-6

    @F.pandas_udf("long")
    def place(vectors: pd.Series) -> pd.Series:
        out, size = np.zeros(len(vectors), dtype=np.int64), vectors.map(len).to_numpy()
        for n in np.unique(size):
            out[size == n] = _morton(axes.value.lead(np.stack(vectors[size == n].to_numpy())))
        return pd.Series(out)

    order = ["g", "dims", "z", "node"]
    placed = nodes.select("g", F.size("v").alias("dims"), place("v").alias("z"), "node", "many", "v")
    placed = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    kind = nodes.schema["g"].dataType.simpleString()
    tiles = cut(placed.select("g", "node", "many", "v").mapInArrow(lambda parts: _tiles(parts, axes.value), f"g {kind}, tile long, dims int, ids array<long>, many array<long>, vecs array<double>, lo array<double>, hi array<double>"))
    side = lambda s: tiles.select(F.col("tile").alias(s), F.col("ids").alias(f"ids_{s}"), F.col("many").alias(f"many_{s}"), F.col("vecs").alias(f"vecs_{s}"))
    full = _near(tiles, width).join(side("a"), "a").join(side("b"), "b")
    full = full.select("dims", "ids_a", "many_a", "vecs_a", "ids_b", "many_b", "vecs_b", (F.col("a") == F.col("b")).alias("same"))
    met = cut(full.mapInArrow(lambda parts: _compare(parts, axes.value, threshold), "id long, links long, root long"))
    links = met.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    lows = roots.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("least"))
    # a node of several copies is linked with its copies even if with nothing else
    facts = nodes.join(links, "node", "left").join(roots.join(lows, "root").select("node", "least"), "node", "left")
    facts = facts.select("g", "h", "v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    done = rows.join(facts, ["g", "h", "v"]).select(F.col("id").alias(id_col), F.col("n_links").cast("long"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return done.unionByName(alone)


def op3_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
