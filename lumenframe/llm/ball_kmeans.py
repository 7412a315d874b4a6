"""Exact integer k-means with balls: most vectors are settled by one distance, the others by those of near centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, flat

#: Scaled components lie below this in magnitude, so that four times any squared distance of 64 of them fits 64 bits.
MOST = 1 << 26
#: Vectors whose distances are computed at once.
ROWS = 4096
#: Once this share of vectors lies in another cluster than the one they are stored with, they are stored anew.
STRAYED = 0.1


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The squared distance of each row of x to a centroid, in 64-bit integers."""
    off = x - centre
    return np.einsum("ij,ij->i", off, off)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the smaller number among equals, and its squared distance."""
    best, which = squared(x, centroids[0]), np.zeros(len(x), dtype=np.int64)
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        closer = d < best
        best[closer], which[closer] = d[closer], j
    return which, best


def reassigned(x: np.ndarray, home: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `nearest` gives, from balls: `home` is the centroid that each vector was last near to, between[i, j] the
    squared distance of centroids.

    A centroid's ball holds the vectors whose home it is; its radius is their largest distance. A vector nearer to it
    than half the way to another centroid is nearer to it than to that one. So only centroids nearer than two radii are
    neighbours; what lies within half the way to the nearest of them is the stable core and stays; the rest is cut into
    annuli by half the ways to the neighbours, and a vector meets only those whose half way it has reached.
    """
    which, best = home.copy(), np.zeros(len(x), dtype=np.int64)
    order = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[order], np.arange(len(centroids) + 1))
    for i in range(len(centroids)):
        mine = order[bounds[i] : bounds[i + 1]]
        if not len(mine):
            continue
        own = squared(x[mine], centroids[i])
        by = np.argsort(own, kind="stable")
        mine, own = mine[by], own[by]
        low, at = own.copy(), np.full(len(mine), i, dtype=np.int64)
        reach = 4 * own  # ascending: an annulus and all beyond it are a slice
        neighbours = [j for j in np.argsort(between[i], kind="stable").tolist() if j != i and between[i, j] <= reach[-1]]
        for j in neighbours:
            first = int(np.searchsorted(reach, between[i, j], side="left"))
            d = squared(x[mine[first:]], centroids[j])
            closer = (d < low[first:]) | ((d == low[first:]) & (j < at[first:]))
            low[first:][closer], at[first:][closer] = d[closer], j
        which[mine], best[mine] = at, low
    return which, best


def _between(centroids: np.ndarray) -> np.ndarray:
    return np.stack([squared(centroids, c) for c in centroids])


def _assigned(parts: Iterator[pa.RecordBatch], centroids: np.ndarray, first: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows, their components and home, and the cluster and distance that they have now."""
    between = _between(centroids)
    for part in parts:
        for a in range(0, part.num_rows, ROWS):
            some = part.slice(a, ROWS)
            x = flat(some.column("x"))[0].astype(np.int64).reshape(some.num_rows, -1)
            if first:
                which, best = nearest(x, centroids)
                yield some, x, which, which, best
            else:
                home = np.asarray(some.column("home")).astype(np.int64)
                yield some, x, home, *reassigned(x, home, centroids, between)


def _stored(centroids: np.ndarray, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows with the cluster that they have now as their home."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, _, which, _ in _assigned(parts, centroids, first):
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("x"), pa.array(which.astype(np.int32))], names=["id", "x", "home"])

    return run


def _summed(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a task and cluster: how many vectors it has now, how many of them come from elsewhere, and their sums."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        n, moved, sums = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, x, home, which, _ in _assigned(parts, centroids, False):
            n += np.bincount(which, minlength=k)
            moved += np.bincount(which[which != home], minlength=k)
            for j in np.unique(which):
                sums[j] += x[which == j].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(moved[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "moved", "sums"])

    return run


def _placed(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, _, which, best in _assigned(parts, centroids, False):
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(which.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return run


def ball_kmeans(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a kept vector: id_col, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly `dims` components, none null or non-finite, are kept; the others are left out. A component x
    becomes floor(scale * x). The first centroids are the k kept vectors with the smallest SHA-256 of `seed:id`, fewer if
    there are fewer; among equal ids the smaller vector comes first, and rows with a null id are clustered but are no
    first centroid, unless all ids are null: then no row comes out. Each round assigns vectors to the nearest centroid,
    the smaller number among equals, and moves each non-empty one to the floor of its vectors' mean, all in integers;
    then they are assigned once more. Rows that repeat an id are vectors of their own. Other columns are ignored, an empty
    table gives no rows, and a scaled component of MOST or more is an error, since distances would not fit 64 bits.

    The integers are written once, each row with its home, the cluster that it is in; a round reads them, finds the new
    clusters by balls (see `reassigned`; a task's ball holds what some thousand rows have in common) and sums them by task.
    k rows of dims sums go to the driver, a size that parameters bound. No vector is shuffled. A home may be out of date:
    it costs comparisons, never a wrong cluster; once STRAYED of them are, the rows are written anew.
    """
    spark = df.sparkSession
    v = F.col("v")
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = (F.size("v") == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: F.when(F.abs(x * scale) < MOST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {MOST} or more")).cast("int")))
    rows = d.where(F.coalesce(good, F.lit(False))).select("id", scaled.alias("x"))
    marked = rows.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("mark"), "x")
    start = marked.orderBy("mark", "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in start], dtype=np.int64)
    kind = "id long, x array<int>, home int"
    table = cut(rows.mapInArrow(_stored(centroids, True), kind))
    for left in range(rounds, 0, -1):
        partial = table.select("x", "home").mapInArrow(_summed(centroids), "cluster long, n long, moved long, sums array<long>")
        flows = partial.select("cluster", "n", "moved", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), F.sum("s").alias("s")).collect()
        new = centroids.copy()
        for r in flows:
            new[r["cluster"], r["at"]] = r["s"] // r["n"]
        strayed, total = (sum(r[c] for r in flows if r["at"] == 0) for c in ("moved", "n"))
        if (new == centroids).all():
            break  # every further round would give the same
        if left > 1 and strayed > STRAYED * total:
            table = cut(table.mapInArrow(_stored(centroids, False), kind))
        centroids = new
    placed = cut(table.mapInArrow(_placed(centroids), "id long, cluster int, distance long"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster"))
    sums = of([inertia.get(j, 0) for j in range(len(centroids))]).cast("long")
    return placed.select(F.col("id").alias(id_col), "cluster", "distance", sums.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 finite components in 8 clusters after 10 rounds; other rows, and an empty table, give none."""
    return ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(rounds: int = 10) -> str:
    """The same in DuckDB: every round a table of distances to all centroids, and one of means by component."""
    pick = lambda r: f"w{r} AS MATERIALIZED (SELECT id, any_value(x) AS x, min(ROW(d, c)) AS b FROM (SELECT v.row AS row, v.id, v.x, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} AS k) AS s GROUP BY row, id)"
    move = lambda r: f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, k.x) AS x FROM c{r} AS k LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM (SELECT b[2] AS c, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM w{r}, range(1, 65) AS g(i) GROUP BY 1, 2) AS s GROUP BY c) AS m USING (c))"
    first = "v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || id), x) - 1 AS c, x FROM v WHERE id IS NOT NULL QUALIFY c < 8)"
    steps = ", ".join([first, *[f"{pick(r)}, {move(r)}" for r in range(rounds)], pick(rounds)])
    last = f"SELECT w.id AS vec_id, b[2]::INTEGER AS cluster, b[1]::BIGINT AS distance, sum(b[1]) OVER (PARTITION BY b[2])::BIGINT AS cluster_inertia, sum(b[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM w{rounds} AS w JOIN c{rounds} AS k ON k.c = b[2]"
    return f"WITH {steps} {last}"


OP11_SQL = _sql()
