"""The queries over the sample tables and the SQL they are held against."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import color, hashing, scalar, texture, vector
from lumenframe.operators import distribution, film, graph, spatial
from lumenframe.plans import casting, curves, helpers, lighting, matting, photometry, rendering, sampling, scattering, scenes, textures
from lumenframe.streaming import progressive

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
#: Inputs of the expression families: small numbers, so that results stay well inside a double's digits.
#: They are computed once a row, in a select of their own.
INPUTS = {
    "fa": "l_extendedprice / 10000.0 - 3.0", "fb": "l_quantity / 10.0 - 2.05", "fc": "l_discount * 5.0 + 0.013",
    "fd": "l_tax * 7.0 + 0.11", "fe": "l_discount * 3.0 - 0.17", "ff": "l_quantity / 50.0 + 0.007", "fg": "l_tax + 0.31",
    "ca_r": "l_discount * 9.0 + 0.03", "ca_g": "l_tax * 11.0 + 0.02", "ca_b": "l_quantity / 51.0",
    "cb_r": "l_tax * 10.0 + 0.05", "cb_g": "l_quantity / 52.0", "cb_b": "l_discount * 8.0 + 0.01", "ft": "l_quantity / 60.0",
}
A, B, C = "fa", "fb", "fc"
VA = (A, B, C)
VB = ("fd", "fe", "ff")
VC = ("0.25", "fg", "-0.5")
CA, CB, T = ("ca_r", "ca_g", "ca_b"), ("cb_r", "cb_g", "cb_b"), "ft"


def _round(x: str, name: str) -> str:
    # moved off the decimals that inputs can have, where either engine may round up or down
    return f"round(CAST({x} AS DOUBLE) + 0.0000137291, 4) + 0.0 AS {name}"


def _family(columns: dict[str, str]) -> str:
    inputs = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in INPUTS.items())
    return f"SELECT {KEYS}, " + ", ".join(_round(x, n) for n, x in columns.items()) + f" FROM (SELECT {KEYS}, {inputs} FROM lineitem) AS i"


def _hsv_family(name: str, v: vector.Vector) -> str:
    # hue, saturation and value in a select of their own: one expression with all would outgrow a method's 64 KB
    steps = [(f"{c}_{k}", f"CAST({INPUTS[x]} AS DOUBLE)") for c, colour in (("a", CA), ("b", CB)) for k, x in zip("rgb", colour, strict=True)] + [("t", INPUTS[T])]
    steps += [(f"{c}_{k}", x) for c in "ab" for k, x in zip("hsv", color.rgb_to_hsv((f"{c}_r", f"{c}_g", f"{c}_b")), strict=True)]
    columns = ", ".join(_round(x, f"{name}_{k}") for k, x in zip("rgb", v, strict=True))
    return f"SELECT {KEYS}, {columns} FROM ({hashing.staged('lineitem', KEYS + ', l_discount, l_tax', steps)}) AS h"


NAMED = tuple(tuple(f"{c}_{k}" for k in ks) for c in "ab" for ks in ("rgb", "hsv"))


def _hashes(steps: hashing.Steps, *names: str) -> str:
    return f"SELECT o_orderkey, {', '.join(names)} FROM ({hashing.staged('orders', 'o_orderkey, o_custkey', steps)}) AS h"


def _spread(name: str, x: str) -> hashing.Steps:
    # 16 bits with a gap before each
    steps, at = [(f"{name}_0", f"({x} & 65535)")], f"{name}_0"
    for i, (gap, mask) in enumerate(((256, 0x00FF00FF), (16, 0x0F0F0F0F), (4, 0x33333333), (2, 0x55555555)), 1):
        steps.append((name if i == 4 else f"{name}_{i}", f"(({at} | {at} * {gap}) & {mask})"))
        at = f"{name}_{i}"
    return steps


def _vectors(op: str) -> dict[str, str]:
    return {f"{op}_{k}": x for k, x in zip("xyz", vector.vector_math(op, VA, VB, VC, "0.8"), strict=True)}


def _channels(name: str, v: vector.Vector) -> dict[str, str]:
    return {f"{name}_{k}": x for k, x in zip("rgb", v, strict=True)}


def _guided() -> str:
    """Eleven Gaussian taps (radius 5, sigma 1.5) along hours and then along users; cells without samples are skipped, and each weighs by its samples."""
    taps = " UNION ALL ".join(f"SELECT {k} AS k, CAST({math.exp(-k * k / (2 * 1.5**2)):.12f} AS DOUBLE) AS w" for k in range(-5, 6))
    sums = "sum(v * w) AS v, sum(c * w) AS c"
    return f"WITH g AS (SELECT user_id, hour(ts) AS h, sum(value) AS v, CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY user_id, hour(ts)), k AS ({taps}), x AS (SELECT g.user_id, g.h + k AS h, {sums} FROM g CROSS JOIN k GROUP BY g.user_id, g.h + k), xs AS (SELECT x.user_id, x.h, x.v, x.c FROM x JOIN g ON g.user_id = x.user_id AND g.h = x.h), y AS (SELECT xs.user_id + k AS user_id, xs.h, {sums} FROM xs CROSS JOIN k GROUP BY xs.user_id + k, xs.h) SELECT y.user_id, y.h, round(y.v / y.c, 4) AS smooth FROM y JOIN g ON g.user_id = y.user_id AND g.h = y.h"


#: Queries whose SQL both engines read; Catalyst plans them from the same text.
SHARED = {
    "math_unary": _family({op: scalar.math(op, A) for op in scalar.UNARY}),
    "math_binary": _family({op: scalar.math(op, A, B) for op in scalar.BINARY}),
    "math_ternary": _family({op: scalar.math(op, A, B, C) for op in scalar.TERNARY}),
    "map_range": _family({k: scalar.map_range(k, A, "-1.0", "4.5", "0.2", "2.7") for k in ("linear", "stepped", "smoothstep", "smootherstep")} | {"clamped": scalar.clamp(A), "between": scalar.clamp_range(A, B, C), "empty": scalar.map_range("linear", A, "1.0", "1.0", "0.2", "2.7")}),
    **{f"vec_{op}": _family(_vectors(op)) for op in vector.VECTORS},
    "vec_numbers": _family({op: f(VA, VB) for op, f in vector.NUMBERS.items()}),
    **{f"mix_{op}": _family(_channels(op, color.mix(op, CA, CB, T))) for op in color.CHANNEL},
    "color_hsv": _family(_channels("hsv", color.rgb_to_hsv(CA)) | _channels("back", color.hsv_to_rgb((CA[0], CA[1], CA[2])))),
    "color_light": _family({"luminance": color.luminance(CA), "linear": color.srgb_to_linear(CA[0]), "display": color.linear_to_srgb(CA[1])}),
    **{f"mix_{op}": _hsv_family(op, color.mix_hsv(op, NAMED[0], NAMED[2], "t", NAMED[1], NAMED[3])) for op in ("hue", "saturation", "value", "colour")},
    "color_hsl": _family(_channels("hsl", color.rgb_to_hsl(CA)) | _channels("back", color.hsl_to_rgb(CA))),
    "color_adjust": _family(_channels("contrast", color.bright_contrast(CA, "0.1", "0.3")) | _channels("gamma", color.gamma(CA, "1.7")) | _channels("inverse", color.invert(CA, T)) | _channels("xyz", color.xyy_to_xyz(*CA))),
    "color_adjust_hsv": _hsv_family("hsv", color.adjust_hsv(NAMED[0], "0.17", "1.2", "0.9", "t", NAMED[1])),
    "tex_wave": _family({f"{shape}_{d}_{profile}": texture.wave(VA, shape == "rings", d, profile, "0.3") for shape in ("bands", "rings") for d in ("x", "y", "z", "all") for profile in ("sin", "saw", "tri")}),
    "tex_brick": _family({"mortar": texture.brick_mortar(A, f"({B} + 0.0317)"), "hard": texture.brick_mortar(A, f"({B} + 0.0317)", soft="0.0", squash="0.7", every=3), "stacked": texture.brick_mortar(A, f"({B} + 0.0317)", every=0)}),
    "hash_jenkins": _hashes(hashing.jenkins("one", "o_orderkey") + hashing.jenkins("two", "o_orderkey", "o_custkey") + hashing.jenkins("three", "o_orderkey", "o_custkey", "17"), "one", "two", "three"),
    "hash_pcg": _hashes(hashing.pcg2d("pcg", "o_orderkey", "o_custkey"), "pcg_x", "pcg_y"),
    "hash_prospector": _hashes(hashing.prospector("mixed", "o_orderkey"), "mixed"),
    "hash_wang": _hashes(hashing.wang("mixed", "o_orderkey", 12345), "mixed"),
    "hash_lattice": _hashes(hashing.lattice("mixed", "o_orderkey", "o_custkey"), "mixed"),
    "tex_white_noise": "SELECT o_orderkey, round(CAST(noise_1 AS DOUBLE) / CAST(4294967295 AS DOUBLE), 6) AS one, round(CAST(noise_2 AS DOUBLE) / CAST(4294967295 AS DOUBLE), 6) AS two FROM (" + hashing.staged("orders", "o_orderkey, o_custkey", hashing.jenkins("noise_1", "o_orderkey") + hashing.jenkins("noise_2", "o_orderkey", "o_custkey")) + ") AS h",
    "morton": "SELECT o_orderkey, o_custkey, z_x + 2 * z_y AS place FROM (" + hashing.staged("orders", "o_orderkey, o_custkey", _spread("z_x", "o_orderkey") + _spread("z_y", "o_custkey")) + ") AS m",
    "tex_checker": _family({"checker": f"CASE WHEN (abs(CAST(floor({A} * 4.0 + 0.0001) AS BIGINT)) % 2 + abs(CAST(floor({B} * 4.0 + 0.0001) AS BIGINT)) % 2 + abs(CAST(floor({C} * 4.0 + 0.0001) AS BIGINT)) % 2) % 2 = 1 THEN 1.0 ELSE 0.0 END"}),
    "tex_gradient": _family({"linear": A, "quadratic": f"greatest({A}, 0.0) * greatest({A}, 0.0)", "easing": f"{scalar.clamp(A)} * {scalar.clamp(A)} * (3.0 - 2.0 * {scalar.clamp(A)})", "diagonal": f"({A} + {B}) * 0.5", "radial": f"atan2({B}, {A}) / 6.283185307179586 + 0.5", "sphere": f"greatest(0.999999 - {vector.length(VA)}, 0.0)"}),
    "film_pass_routing": "SELECT l_suppkey, count(*) AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 1000 ELSE 0 END), 3) AS direct, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 ELSE 0 END), 3) AS indirect FROM lineitem GROUP BY l_suppkey",
    "dilate_x": "WITH g AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY user_id, hour(ts)), f AS (SELECT user_id, h, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS done FROM g), x AS (SELECT user_id, h, done, min(done) OVER (PARTITION BY user_id ORDER BY h RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS low FROM f) SELECT user_id, h, done, low FROM x",
    "gaussian_taps": _guided(),
    "lookup_default": "SELECT o_orderkey, coalesce(c_nationkey, 0) AS nation, coalesce(c_mktsegment, '') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "asof_motion": "WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events), m AS (SELECT user_id, max(step) AS top, (user_id % 101) / 100.0 AS moment FROM s GROUP BY user_id), p AS (SELECT user_id, moment * top AS place, CAST(greatest(least(floor(moment * top), top - 1), 0) AS BIGINT) AS low FROM m) SELECT p.user_id, round(a.value + (coalesce(b.value, a.value) - a.value) * (p.place - p.low), 4) AS moved FROM p JOIN s a ON a.user_id = p.user_id AND a.step = p.low LEFT JOIN s b ON b.user_id = p.user_id AND b.step = p.low + 1",
    "bounds": "SELECT p_brand, min(p_size) AS lo_size, max(p_size) AS hi_size, min(p_retailprice) AS lo_price, max(p_retailprice) AS hi_price, count(*) AS n FROM part GROUP BY p_brand",
    "reach_closure": "WITH RECURSIVE reach AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey AS BIGINT) AS needs FROM nation UNION ALL SELECT node, CAST(floor(needs / 2.0) AS BIGINT) AS needs FROM reach WHERE needs > 0) SELECT node, needs FROM reach",
    "node_dedup": "SELECT p_type, p_size, min(p_partkey) AS node, count(*) AS merged FROM part GROUP BY p_type, p_size",
    "attribute_union": "SELECT p_brand AS name FROM part WHERE p_size < 10 UNION SELECT p_brand AS name FROM part WHERE p_size > 40",
    "dependency_intersection": "SELECT p_type AS name FROM part WHERE p_size < 10 INTERSECT SELECT p_type AS name FROM part WHERE p_size > 40",
    "film_finalise": "SELECT l_suppkey, n, round(r / n, 4) AS combined, CASE WHEN d = 0 THEN 10000000000.0 ELSE CAST(d AS DOUBLE) END AS depth, round(least(greatest(1.0 - m / n, 0.0), 1.0), 4) AS mist, round(exp(-v / n), 4) AS majorant, round(CASE WHEN w > 0 THEN u / w ELSE 0.0 END, 4) AS motion FROM (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice / 1000) AS r, min(l_quantity - 1) AS d, sum(l_tax) AS m, sum(l_discount) AS v, sum(l_quantity * l_tax) AS u, sum(l_quantity) AS w FROM lineitem GROUP BY l_suppkey) AS f",
    "extrema_grid": "SELECT cell, lo, hi, n, CAST((hi - lo) * 0.0002 > 1.442 AS INTEGER) AS splits FROM (SELECT o_custkey % 64 AS cell, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY o_custkey % 64) AS g",
    "sah_bins": "SELECT bin, n, lo, hi, CAST(sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_left, CAST(sum(n) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_right, max(hi) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS hi_left FROM (SELECT bin, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM (SELECT p_size, CAST(floor((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) + 0.001 FROM part) * 32.0) AS BIGINT) AS bin FROM part) AS b GROUP BY bin) AS h",
    "named_stats": "SELECT event_type AS name, count(*) AS entries, round(sum(value), 3) AS total, round(avg(value), 4) AS mean FROM events GROUP BY event_type",
    "dilate_y": "WITH g AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY user_id, hour(ts)), f AS (SELECT user_id, h, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS done FROM g), x AS (SELECT user_id, h, done, min(done) OVER (PARTITION BY user_id ORDER BY h RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS low FROM f) SELECT x.user_id, x.h, x.low AS before, least(x.low, coalesce(u.low, 1), coalesce(d.low, 1)) AS low FROM x LEFT JOIN x u ON u.h = x.h AND u.user_id = x.user_id - 1 LEFT JOIN x d ON d.h = x.h AND d.user_id = x.user_id + 1",
    "light_links": "SELECT l_suppkey, bit_or(CAST(1 AS BIGINT) * CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 4 END) AS links FROM lineitem GROUP BY l_suppkey",
    "time_format": "SELECT doc_id, CASE WHEN c >= 360000 THEN concat(lpad(CAST(CAST(floor(c / 360000.0) AS BIGINT) AS STRING), 2, '0'), ':') ELSE '' END || concat(lpad(CAST(CAST(floor(c / 6000.0) AS BIGINT) % 60 AS STRING), 2, '0'), ':', lpad(CAST(CAST(floor(c / 100.0) AS BIGINT) % 60 AS STRING), 2, '0'), '.', lpad(CAST(c % 100 AS STRING), 2, '0')) AS clock FROM (SELECT doc_id, n_chars * 137 AS c FROM documents) AS d",
    "str_sizes": "SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS STRING) ELSE concat(CAST(CAST(floor(q / 100.0) AS BIGINT) AS STRING), '.', lpad(CAST(q % 100 AS STRING), 2, '0'), CASE WHEN b < 1048576 THEN 'K' ELSE 'M' END) END AS size, CAST(lower(lang) = 'en' AS INTEGER) AS english, length(trim(text)) AS stripped, md5(trim(text)) AS stripped_digest, CAST(substr(text, 1, 1) = 'T' AS INTEGER) AS starts FROM (SELECT doc_id, text, lang, b, CAST(floor((CASE WHEN b < 1048576 THEN b ELSE floor(b / 1024.0) END) * 100.0 / 1024.0 + 0.5) AS BIGINT) AS q FROM (SELECT doc_id, text, lang, n_chars AS b FROM documents) AS c) AS d",
    "any_hit": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "no_hit": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "visibility_mask": "SELECT o_orderkey, CAST(o_orderkey & 255 AS BIGINT) AS mask FROM orders WHERE (o_orderkey & 6) <> 0",
    "str_functions": "SELECT doc_id, upper(md5(text)) AS digest, length(text) AS n, substr(text, 1, 12) AS head, length(replace(text, 'e', 'EE')) AS swapped, md5(replace(text, 'e', 'EE')) AS swapped_digest FROM documents",
}
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of SHARED; its tables are named in arguments, so sessions keep no views."""
    kind = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
    return spark.sql(kind + ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if f" {t}" in sql) + (", " + sql[len(kind) :] if sql.startswith("WITH ") else " " + sql))


def film_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by pixel: means of three channels and the depth of the first sample."""
    rows = table(spark, sf_dir, "lineitem")
    out = film.accumulate(rows, "l_suppkey", {"r": F.col("l_extendedprice") / 1000, "g": F.col("l_discount"), "b": F.col("l_tax")}, {"depth": F.col("l_quantity")}, ORDER)
    mean = lambda c: F.round(F.col(c) / F.col("n"), 4).alias(c)
    return out.select("l_suppkey", "n", mean("r"), mean("g"), mean("b"), "depth")


def merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results by line status merged to one a pixel."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_discount").alias("m"))
    return film.merge(parts, "l_suppkey", ["m"]).select("l_suppkey", "n", F.round("m", 5).alias("m"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column], list[Column]]:
    channels = {"r": F.col("l_extendedprice") / 100000, "g": F.col("l_discount"), "b": F.col("l_tax")}
    odd = F.col("l_linenumber") % 2 == 1
    sums = channels | {f"h{k}": F.when(odd, 2.0 * x).otherwise(F.lit(0.0)) for k, x in channels.items()}
    return film.accumulate(table(spark, sf_dir, "lineitem"), "l_suppkey", sums, {}, ORDER), [F.col(k) for k in channels], [F.col(f"h{k}") for k in channels]


def converged_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels whose sampling error is under 0.3 at an exposure of 1.5."""
    d, full, half = _halves(spark, sf_dir)
    return d.select("l_suppkey", film.converged(full, half, F.col("n"), 0.3, 1.5).cast("int").alias("done"))


def half_buffer_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling error of each pixel."""
    d, full, half = _halves(spark, sf_dir)
    return d.select("l_suppkey", "n", F.round(film.sampling_error(full, half, F.col("n"), 1.5), 4).alias("error"))


def merge_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results by line status: a mean by samples, a sum, and a copy of the first."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_discount").alias("m"), F.sum("l_quantity").alias("s"), F.max("l_partkey").alias("c"))
    return film.merge(parts, "l_suppkey", ["m"], sums=("s",), copies=("c",), order="l_linestatus").select("l_suppkey", "n", F.round("m", 5).alias("m"), "s", "c")


def aabb_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers whose boxes overlap on both axes."""
    box = lambda d, key, name, x, y: d.select(F.col(key).alias(name), x.alias("lo0"), (x + 1.5).alias("hi0"), y.alias("lo1"), (y + 2.5).alias("hi1"))
    a = box(table(spark, sf_dir, "part"), "p_partkey", "a", F.col("p_size").cast("double"), F.col("p_retailprice") / 20)
    b = box(table(spark, sf_dir, "supplier"), "s_suppkey", "b", F.col("s_acctbal") / 200, F.col("s_acctbal") / 100)
    return spatial.overlaps(a, b, 4.0).select(F.col("a").alias("part"), F.col("b").alias("supplier"))


def sort_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered within their priority."""
    return distribution.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", RANGE)


def matte_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four parts with most quantity of each supplier."""
    return film.top_weights(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", F.col("l_quantity"), 4)


def _first_hits(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ray"), (F.col("c_custkey") % 97 / 10).alias("x"), (F.col("c_custkey") % 89 / 10).alias("y"), F.lit(-5.0).alias("z"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sphere"), (F.col("s_suppkey") % 83 / 8).alias("sx"), (F.col("s_suppkey") % 79 / 8).alias("sy"), (F.col("s_suppkey") % 7).cast("double").alias("sz"), F.lit(0.77).alias("r"))
    return spatial.first_of_places(c, s, 2.0, n)


def nearest_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sphere that each ray hits."""
    return _first_hits(spark, sf_dir, 1).select("ray", "sphere", F.round("t", 5).alias("t"))


def all_hits_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three spheres of each ray."""
    return _first_hits(spark, sf_dir, 3).withColumn("t", F.round("t", 5))


#: Keys of one range of a running total.
RANGE = 1_000_000


def _lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.greatest(F.round(F.col("s_acctbal") * 100), F.lit(0)).cast("long") + 1
    return distribution.cdf(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", weight, RANGE).drop("s_acctbal")


def cdf_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' ranges in the running total of their balances in cents."""
    return _lights(spark, sf_dir)


def cdf_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier that each order's place in the running total falls on."""
    lights = _lights(spark, sf_dir)
    total, n = lights.agg(F.max("hi"), F.count("*")).first()
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod(F.col("o_orderkey") * 7919, F.lit(total or 1)).alias("place"))
    return distribution.pick(points, "place", lights, F.lit((total or 1) / max(n, 1))).select("o_orderkey", "place", "s_suppkey")


def active_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders, numbered without gaps."""
    return distribution.compact(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus") == "O", RANGE).select("o_orderkey", "index")


def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before each order, the number of lines of all orders with smaller keys."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return distribution.running(lines, "l_orderkey", F.col("n"), RANGE)


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of customers, each linked with the one as many keys on as its balance tells."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") + F.floor(F.abs(F.col("c_acctbal"))) + 1).cast("long").alias("to"))
    edges = c.select(F.col("node").alias("a"), F.col("to").alias("b")).join(c.select(F.col("node").alias("b")), "b")
    return graph.islands(c.select("node"), edges)


def hash_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiply-add hash of part names."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(hashing.string_hash("p_name")).alias("mixed"))


def stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream."""
    return progressive.accumulate(spark, f"{sf_dir}/events.parquet")


NATIVE = (cdf_build, cdf_pick, active_index, prefix_sum, islands, hash_string, film_accumulate, merge_partials, converged_mask, half_buffer_error, merge_modes, aabb_overlap, sort_bucket, matte_topk, nearest_hit, all_hits_n, stream_accumulate)
_CAST = "SELECT ray, sphere, t FROM (SELECT ray, sphere, CASE WHEN sz - z - h > 0 THEN sz - z - h ELSE sz - z + h END AS t FROM (SELECT *, sqrt(greatest(q, 0)) AS h FROM (SELECT *, r * r - (x - sx) * (x - sx) - (y - sy) * (y - sy) AS q FROM (SELECT c_custkey AS ray, (c_custkey % 97) / 10 AS x, (c_custkey % 89) / 10 AS y, -5.0::DOUBLE AS z FROM customer) a CROSS JOIN (SELECT s_suppkey AS sphere, (s_suppkey % 83) / 8 AS sx, (s_suppkey % 79) / 8 AS sy, (s_suppkey % 7)::DOUBLE AS sz, 0.77::DOUBLE AS r FROM supplier) b) WHERE q >= 0)) WHERE t > 0"
_LIGHTS = "SELECT s_suppkey, CAST(coalesce(sum(w) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo, CAST(sum(w) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM (SELECT s_suppkey, CAST(greatest(round(s_acctbal * 100), 0) AS BIGINT) + 1 AS w FROM supplier) AS s"
SQL = {
    "cdf_build": _LIGHTS,
    "cdf_pick": f"WITH c AS ({_LIGHTS}), p AS (SELECT o_orderkey, o_orderkey * 7919 % (SELECT max(hi) FROM c) AS place FROM orders) SELECT o_orderkey, place, s_suppkey FROM p JOIN c ON place >= lo AND place < hi",
    "active_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders WHERE o_orderstatus = 'O'",
    "prefix_sum": "SELECT l_orderkey, n, CAST(coalesce(sum(n) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) AS s",
    "islands": "WITH RECURSIVE d AS (SELECT c_custkey AS a, CAST(c_custkey + floor(abs(c_acctbal)) + 1 AS BIGINT) AS b FROM customer), e AS (SELECT a, b FROM d WHERE b IN (SELECT a FROM d) UNION SELECT b AS a, a AS b FROM d WHERE b IN (SELECT a FROM d)), r AS (SELECT c_custkey AS node, c_custkey AS up FROM customer UNION SELECT node, b AS up FROM r JOIN e ON up = a) SELECT node, min(up) AS island FROM r GROUP BY node",
    "merge_modes": "SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 5) AS m, sum(l_quantity) AS s, max(CASE WHEN l_linestatus = first THEN l_partkey END) AS c FROM (SELECT *, min(l_linestatus) OVER (PARTITION BY l_suppkey) AS first FROM lineitem) AS l GROUP BY l_suppkey",
    "aabb_overlap": "SELECT p_partkey AS part, s_suppkey AS supplier FROM part JOIN supplier ON p_size <= s_acctbal / 200 + 1.5 AND s_acctbal / 200 <= p_size + 1.5 AND p_retailprice / 20 <= s_acctbal / 100 + 2.5 AND s_acctbal / 100 <= p_retailprice / 20 + 2.5",
    "sort_bucket": "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders",
    "hash_string": "SELECT p_partkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_filter(range(1, 2 * octet_length(encode(p_name))), lambda i: i % 2 = 1), lambda i: CAST((strpos('0123456789ABCDEF', substr(hex(encode(p_name)), i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(p_name)), i + 1, 1)) - 1 AS BIGINT))), lambda a, c: (a * 37 + c) & 4294967295) AS mixed FROM part",
    "film_accumulate": f"SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice / 1000) / count(*), 4) AS r, round(sum(l_discount) / count(*), 4) AS g, round(sum(l_tax) / count(*), 4) AS b, arg_min(l_quantity, ROW({', '.join(ORDER)})) AS depth FROM lineitem GROUP BY l_suppkey",
    "merge_partials": "SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 5) AS m FROM lineitem GROUP BY l_suppkey",
    "converged_mask": "SELECT l_suppkey, CASE WHEN ((abs(r - hr) + abs(g - hg) + abs(b - hb)) * 1.5 / n) / (0.0001 + CASE WHEN (r + g + b) * 1.5 / n < 1 THEN sqrt((r + g + b) * 1.5 / n) ELSE (r + g + b) * 1.5 / n END) < 0.3 THEN 1 ELSE 0 END AS done FROM (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice / 100000) AS r, sum(l_discount) AS g, sum(l_tax) AS b, sum(CASE WHEN l_linenumber % 2 = 1 THEN 2.0 * l_extendedprice / 100000 ELSE 0.0 END) AS hr, sum(CASE WHEN l_linenumber % 2 = 1 THEN 2.0 * l_discount ELSE 0.0 END) AS hg, sum(CASE WHEN l_linenumber % 2 = 1 THEN 2.0 * l_tax ELSE 0.0 END) AS hb FROM lineitem GROUP BY l_suppkey) AS f",
    "half_buffer_error": "SELECT l_suppkey, n, round(((abs(r - hr) + abs(g - hg) + abs(b - hb)) * 1.5 / n) / (0.0001 + CASE WHEN (r + g + b) * 1.5 / n < 1 THEN sqrt((r + g + b) * 1.5 / n) ELSE (r + g + b) * 1.5 / n END), 4) AS error FROM (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice / 100000) AS r, sum(l_discount) AS g, sum(l_tax) AS b, sum(CASE WHEN l_linenumber % 2 = 1 THEN 2.0 * l_extendedprice / 100000 ELSE 0.0 END) AS hr, sum(CASE WHEN l_linenumber % 2 = 1 THEN 2.0 * l_discount ELSE 0.0 END) AS hg, sum(CASE WHEN l_linenumber % 2 = 1 THEN 2.0 * l_tax ELSE 0.0 END) AS hb FROM lineitem GROUP BY l_suppkey) AS f",
    "matte_topk": "SELECT l_suppkey, slot, l_partkey, weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, l_partkey) AS INTEGER) AS slot FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey)) WHERE slot <= 4",
    "nearest_hit": f"SELECT ray, arg_min(sphere, ROW(t, sphere)) AS sphere, round(min(t), 5) AS t FROM ({_CAST}) GROUP BY ray",
    "all_hits_n": f"SELECT ray, sphere, round(t, 5) AS t, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ray ORDER BY t, sphere) AS INTEGER) AS nth FROM ({_CAST})) WHERE nth <= 3",
    "stream_accumulate": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each takes (spark, sf_dir)."""
    return {name: partial(shared, sql) for name, sql in (SHARED | rendering.QUERIES | helpers.SPARK | scattering.QUERIES).items()} | textures.NATIVE | {f.__name__: f for f in NATIVE + scenes.NATIVE + casting.NATIVE + sampling.NATIVE + curves.NATIVE + photometry.NATIVE + matting.NATIVE + scattering.NATIVE + lighting.NATIVE}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return SHARED | rendering.QUERIES | textures.QUERIES | helpers.QUERIES | scattering.QUERIES | SQL | scenes.SQL | casting.SQL | sampling.SQL | curves.SQL | photometry.SQL | matting.SQL | scattering.SQL | lighting.SQL
