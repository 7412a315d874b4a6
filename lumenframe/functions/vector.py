"""Operators on vectors of three components, as SQL expressions by component."""

from __future__ import annotations

from collections.abc import Callable

from lumenframe.functions import scalar

Vector = tuple[str, str, str]


def dot(a: Vector, b: Vector) -> str:
    """The inner product."""
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def length(a: Vector) -> str:
    """The Euclidean length."""
    return f"sqrt({dot(a, a)})"


def each(f: Callable[..., str], *vectors: Vector) -> Vector:
    """f by component."""
    return tuple(f(*x) for x in zip(*vectors, strict=True))  # type: ignore[return-value]


def scale(a: Vector, s: str) -> Vector:
    """a times a number."""
    return each(lambda x: f"({x} * {s})", a)


def normalize(a: Vector) -> Vector:
    """a at length 1; zero stays zero."""
    return each(lambda x: scalar.divide(x, length(a)), a)


def cross(a: Vector, b: Vector) -> Vector:
    """The outer product."""
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))  # type: ignore[return-value]


def project(a: Vector, b: Vector) -> Vector:
    """a's part along b; zero for a zero b."""
    return scale(b, scalar.divide(dot(a, b), dot(b, b)))


def reflect(a: Vector, b: Vector) -> Vector:
    """a mirrored at the plane across b."""
    n = normalize(b)
    return each(lambda x, y: f"({x} - 2.0 * {dot(a, n)} * {y})", a, n)


def refract(a: Vector, b: Vector, eta: str) -> Vector:
    """a bent at the plane across b by Snell's law; zero on total reflection."""
    n = normalize(b)
    d = dot(n, a)
    k = f"(1.0 - {eta} * {eta} * (1.0 - {d} * {d}))"
    return each(lambda x, y: f"(CASE WHEN {k} < 0 THEN 0.0 ELSE {eta} * {x} - ({eta} * {d} + sqrt(greatest({k}, 0.0))) * {y} END)", a, n)


def faceforward(a: Vector, b: Vector, c: Vector) -> Vector:
    """a if c and b face one another, else -a."""
    return each(lambda x: f"(CASE WHEN {dot(c, b)} < 0 THEN {x} ELSE -({x}) END)", a)


NUMBERS = {"dot_product": dot, "distance": lambda a, b: length(each(lambda x, y: f"({x} - {y})", a, b)), "length": lambda a, b: length(a)}
COMPONENTS = ("add", "subtract", "multiply", "divide", "snap", "floor", "ceil", "modulo", "fraction", "absolute", "minimum", "maximum", "wrap", "sine", "cosine", "tangent", "multiply_add", "power", "sign", "round")


def vector_math(op: str, a: Vector, b: Vector, c: Vector, s: str = "1.0") -> Vector:
    """Any vector operator with a vector result, by name."""
    whole = {"cross_product": lambda: cross(a, b), "project": lambda: project(a, b), "reflect": lambda: reflect(a, b), "refract": lambda: refract(a, b, s), "faceforward": lambda: faceforward(a, b, c), "scale": lambda: scale(a, s), "normalize": lambda: normalize(a)}
    return whole[op]() if op in whole else each(lambda x, y, z: scalar.math(op, x, y, z), a, b, c)


VECTORS = (*COMPONENTS, "cross_product", "project", "reflect", "refract", "faceforward", "scale", "normalize")
