"""Queries of noise and cells: a text that Spark and DuckDB can read, and the same over batches of numbers, which Spark runs.

tests/test_noise.py holds the texts against plain Python, tests/test_lattice.py the batches against the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import lattice, noise

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
#: A point in space from a line of an order, some coordinates below 0.
POINT = {"px": "l_extendedprice / 3000.0 - 7.31", "py": "l_quantity / 3.0 - 6.17", "pz": "l_discount * 40.0 - 1.57"}
X, Y, Z = POINT


def over_lines(levels: noise.Levels, **results: str) -> str:
    """Results of levels over lines of orders, rounded."""
    return noise.leveled("lineitem", KEYS, POINT, levels, {n: f"round(CAST({x} AS DOUBLE) + 0.0000137291, 4) + 0.0" for n, x in results.items()})


def _voronoi(metric: str) -> str:
    return over_lines(noise.voronoi("v", X, Y, metric, "0.9"), f1="v_f1", f2="v_f2", x="v_x", y="v_y")


QUERIES = {
    "noise_perlin_1d": over_lines(noise.perlin("n", (X,)), signed="n", unsigned="n * 0.5 + 0.5"),
    "noise_perlin_2d": over_lines(noise.perlin("n", (X, Y)), signed="n", unsigned="n * 0.5 + 0.5"),
    "noise_perlin_3d": over_lines(noise.perlin("n", (X, Y, Z)), signed="n", unsigned="n * 0.5 + 0.5"),
    **{f"noise_{kind}": over_lines(noise.fractal("n", kind, (X, Y), 1.4, 0.55, 2.1, 0.8, 1.3), value="n") for kind in noise.FRACTALS},
    "noise_fbm_3d": over_lines(noise.fractal("n", "fbm", (X, Y, Z), 1.0, 0.5, 2.0, normalize=False), value="n"),
    **{f"voronoi_{metric}": _voronoi(metric) for metric in noise.METRICS},
}


def batched(spark: SparkSession, sf_dir: str, run: Callable[..., tuple[np.ndarray, ...]], inputs: tuple[str, ...], names: tuple[str, ...], **results: str) -> DataFrame:
    """over_lines with names that run makes of batches of inputs."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*KEYS, lattice.column(run, names, *(POINT[i] for i in inputs)).alias("made"))
    return lines.select(*KEYS, "made.*").selectExpr(*KEYS, *(f"round(CAST({x} AS DOUBLE) + CAST(0.0000137291 AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS {n}" for n, x in results.items()))


def _noise(dims: int) -> Callable[[SparkSession, str], DataFrame]:
    return partial(batched, run=lambda *p: (lattice.perlin(*p),), inputs=tuple(POINT)[:dims], names=("n",), signed="n", unsigned="n * 0.5D + 0.5D")


def _fractal(dims: int, *numbers: object, **more: object) -> Callable[[SparkSession, str], DataFrame]:
    kind, *settings = numbers
    return partial(batched, run=lambda *p: (lattice.fractal(kind, p, *settings, **more),), inputs=tuple(POINT)[:dims], names=("n",), value="n")


def _cells(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    return partial(batched, run=lambda x, y: lattice.voronoi(x, y, metric, 0.9), inputs=tuple(POINT)[:2], names=("f1", "f2", "x", "y"), f1="f1", f2="f2", x="x", y="y")


NATIVE = {
    **{f"noise_perlin_{n}d": _noise(n) for n in (1, 2, 3)},
    **{f"noise_{kind}": _fractal(2, kind, 1.4, 0.55, 2.1, 0.8, 1.3) for kind in noise.FRACTALS},
    "noise_fbm_3d": _fractal(3, "fbm", 1.0, 0.5, 2.0, normalize=False),
    **{f"voronoi_{metric}": _cells(metric) for metric in noise.METRICS},
}
