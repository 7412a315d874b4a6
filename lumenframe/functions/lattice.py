"""The noise and cellular distances of `noise` over columns of numbers, in numpy: whole batches a step, in words of 32 bits.

The texts of `noise` outgrow what the engine compiles; these are the same steps in the same order.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import hashing, noise

TURNS = tuple(zip("cabcabc", "bcabcab", hashing.JENKINS_TURNS, strict=True))
SCALES, PERIOD, LARGE, TOP = {k: float(v) for k, v in noise.SCALES.items()}, float(noise.PERIOD), float(noise.LARGE), float(noise.TOP)
FACTOR, STEP = np.uint32(hashing.PCG_FACTOR), np.uint32(hashing.PCG_STEP)


def _word(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).astype(np.uint32)


def jenkins(*keys: np.ndarray) -> np.ndarray:
    """The final mix of one to three words."""
    start = np.uint32((hashing.JENKINS_START + 4 * len(keys)) % hashing.WORD)
    at = {v: start + keys[i] if i < len(keys) else np.full_like(keys[0], start) for i, v in enumerate("abc")}
    for to, by, turn in TURNS:
        x = at[by]
        at[to] = (at[to] ^ x) - ((x << np.uint32(turn)) | (x >> np.uint32(32 - turn)))
    return at["c"]


def _gradient(h: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    turned = lambda x, bit: np.where(h & np.uint32(bit), -x, x)
    if len(at) == 1:
        return (1.0 + (h & np.uint32(7))) * turned(at[0], 8)
    if len(at) == 2:
        straight = (h & np.uint32(7)) < 4
        return turned(np.where(straight, *at), 1) + 2.0 * turned(np.where(straight, *at[::-1]), 2)
    x, y, z = at
    second = np.where((h & np.uint32(12)) == 0, y, np.where((h & np.uint32(13)) == 12, x, z))
    return turned(np.where((h & np.uint32(8)) == 0, x, y), 1) + turned(second, 2)


def perlin(*point: np.ndarray) -> np.ndarray:
    """Gradient noise in [-1, 1] of points of one to three dimensions."""
    moved = [np.fmod(p, PERIOD) + np.where(np.abs(p) >= LARGE, 0.5, 0.0) for p in point]
    floors = [np.floor(m) for m in moved]
    words, parts = [_word(f) for f in floors], [m - f for m, f in zip(moved, floors, strict=True)]
    eased = [t * t * t * (t * (t * 6.0 - 15.0) + 10.0) for t in parts]
    value = None
    for corner in product((0, 1), repeat=len(point)):
        h = jenkins(*(w + np.uint32(c) for w, c in zip(words, corner, strict=True)))
        share = _gradient(h, [t - float(c) for t, c in zip(parts, corner, strict=True)])
        for e, c in zip(eased, corner, strict=True):
            share = share * (e if c else 1.0 - e)
        value = share if value is None else value + share
    return value * SCALES[len(point)]


def fractal(kind: str, point: tuple[np.ndarray, ...], detail: float, roughness: float, lacunarity: float, offset: float = 0.0, gain: float = 1.0, normalize: bool = True) -> np.ndarray:
    """The sum of octaves that `noise.fractal` writes."""
    whole, rest = int(detail), detail - int(detail)
    count = 1 + whole + (1 if rest and kind != "ridged_multifractal" else 0)
    o = [perlin(*(lacunarity**i * p for p in point)) for i in range(count)]
    share = lambda i: rest if i > whole else 1.0
    if kind == "fbm":
        def total(n: int) -> np.ndarray:
            amounts = [roughness**i for i in range(n)]
            s = amounts[0] * o[0]
            for i in range(1, n):
                s = s + amounts[i] * o[i]
            return 0.5 * s / sum(amounts) + 0.5 if normalize else s

        return total(whole + 1) * (1 - rest) + total(count) * rest if rest else total(count)
    if kind == "multifractal":
        v = share(0) * o[0] + 1.0
        for i in range(1, count):
            v = v * (share(i) * roughness**i * o[i] + 1.0)
        return v
    if kind == "hetero_terrain":
        v = offset + o[0]
        for i in range(1, count):
            v = v + share(i) * roughness**i * (o[i] + offset) * v
        return v
    if kind == "hybrid_multifractal":
        v, w = o[0] + offset, gain * (o[0] + offset)
        for i in range(1, count):
            held = np.where(w > 0.001, np.minimum(w, 1.0), 0.0)
            signal = (o[i] + offset) * roughness**i
            v, w = v + share(i) * held * signal, held * gain * signal
        return v
    ridge = lambda x: (offset - np.abs(x)) * (offset - np.abs(x))
    v = w = ridge(o[0])
    for i in range(1, count):
        w = ridge(o[i]) * np.maximum(np.minimum(w * gain, 1.0), 0.0)
        v = v + roughness**i * w
    return v


def pcg2d(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two-dimensional multiply-add hash of words, of 31 bits."""
    fold = lambda a: a ^ (a.view(np.int32) >> 16).view(np.uint32)
    x, y = x * FACTOR + STEP, y * FACTOR + STEP
    x = x + y * FACTOR
    y = y + x * FACTOR
    x, y = fold(x), fold(y)
    x = x + y * FACTOR
    y = y + x * FACTOR
    return x & np.uint32(0x7FFFFFFF), y & np.uint32(0x7FFFFFFF)


def _length(metric: str, x: np.ndarray, y: np.ndarray, exponent: float = 2.5) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(x * x + y * y)
    x, y = np.abs(x), np.abs(y)
    return {"manhattan": lambda: x + y, "chebychev": lambda: np.maximum(x, y), "minkowski": lambda: np.power(np.power(x, exponent) + np.power(y, exponent), 1.0 / exponent)}[metric]()


def voronoi(x: np.ndarray, y: np.ndarray, metric: str = "euclidean", randomness: float = 1.0) -> tuple[np.ndarray, ...]:
    """The nearest and second nearest distance to the points of nine cells, and the nearest one's place; of equal ones the first."""
    cx, cy = np.floor(x), np.floor(y)
    wx, wy = _word(cx), _word(cy)
    first = second = px = py = None
    for a, b in product((-1, 0, 1), repeat=2):
        hx, hy = pcg2d(wx + np.uint32(a % hashing.WORD), wy + np.uint32(b % hashing.WORD))
        ox, oy = float(a) + hx / TOP * randomness, float(b) + hy / TOP * randomness
        d = _length(metric, ox - (x - cx), oy - (y - cy))
        if first is None:
            first, second, px, py = d, np.full_like(d, np.inf), ox, oy
            continue
        near = d < first
        second = np.minimum(second, np.maximum(first, d))
        first, px, py = np.where(near, d, first), np.where(near, ox, px), np.where(near, oy, py)
    return first, second, px + cx, py + cy


def column(run: Callable[..., tuple[np.ndarray, ...]], names: tuple[str, ...], *inputs: str) -> Column:
    """A struct of doubles that run makes of batches of numeric columns; null where any of them is."""

    def batch(*columns: pa.Array) -> pa.Array:
        none = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
        with np.errstate(all="ignore"):
            out = run(*(c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns))
        return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=none) for v in out], names=list(names))

    return F.arrow_udf(batch, ", ".join(f"{n} double" for n in names), F.ArrowUDFType.SCALAR)(*(F.expr(f"CAST({x} AS DOUBLE)") for x in inputs))
