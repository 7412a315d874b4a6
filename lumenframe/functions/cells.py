"""Cellular features of the plane, as SQL over arrays of the cells about a point: nearest points, a smooth
nearest distance, the distance to the edge between cells, and the room about the nearest point.

Each cell's point is a hash of the cell. Neighbours are an array in the row, so nothing is joined; a hash's steps are nested
names, each computed once a cell. Spark plans nested names in a time that multiplies with their depth: the eight steps of the plane's
hash take a second, the hash of space took minutes, so space is left out.
"""

from __future__ import annotations

from lumenframe.functions import hashing, noise

#: Fixed value: squared distance of two points below which they are one.
SAME = 0.0001


def let(value: str, name: str, body: str) -> str:
    """body with a name for a value, which is computed once. The word for an array must not stand before a shift to the right:
    Spark would read that as the end of a type."""
    return f"get(transform(array_repeat({value}, 1), {name} -> {body}), 0)"


def _named(steps: hashing.Steps, body: str) -> str:
    for name, value in reversed(steps):
        body = let(value, name, body)
    return body


def points(at: tuple[str, ...], randomness: str, reach: int = 1, about: tuple[str, ...] | None = None) -> str:
    """An array of (o0 .., w0 ..): the cells within reach of that of a point, each with its offset and the way from the point
    to its own point, the last axis outermost. With about, cells are counted from that offset."""
    dims, wide = len(at), 2 * reach + 1
    own = [f"(n DIV {wide**k} % {wide} - {reach}" + (f" + {about[k]})" if about else ")") for k in range(dims)]
    cell = hashing.pcg2d("h", *[hashing.cut(f"CAST(floor({x}) AS BIGINT) + {o}") for x, o in zip(at, own, strict=True)])
    ways = [f"{o} + h_{c} / CAST({noise.TOP} AS DOUBLE) * {randomness} - ({x} - floor({x}))" for o, c, x in zip(own, "xyz", at, strict=False)]
    fields = ", ".join(f"'o{k}', CAST({o} AS BIGINT), 'w{k}', CAST({w} AS DOUBLE)" for k, (o, w) in enumerate(zip(own, ways, strict=True)))
    return f"transform(sequence(0, {wide**dims - 1}), n -> {_named(cell, f'named_struct({fields})')})"


def _parts(name: str, dims: int) -> list[str]:
    return [f"{name}{k}" for k in range(dims)]


def _square(v: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {x}" for x in v) + ")"


def smooth(at: tuple[str, ...], metric: str, randomness: str, smoothness: str) -> str:
    """The distances within two cells, folded by a smooth least: a step of two blends them by how near they are."""
    far = noise.distance(metric, _parts("p.w", len(at)))
    blend = let(f"least(greatest(0.5D + 0.5D * (s.d - x) / {smoothness}, 0.0D), 1.0D)", "t", "t * t * (3 - 2 * t)")
    step = let(f"CASE WHEN s.first THEN 1.0D ELSE {blend} END", "h", f"named_struct('d', s.d + (x - s.d) * h - {smoothness} * h * (1 - h), 'first', false)")
    return f"aggregate(transform({points(at, randomness, 2)}, p -> {far}), named_struct('d', 0.0D, 'first', true), (s, x) -> {step}).d"


def edge(at: tuple[str, ...], randomness: str) -> str:
    """The distance to the nearest plane half way between the nearest point and another one."""
    n = len(at)
    across = [f"(p.w{k} - m.w{k})" for k in range(n)]
    half = " + ".join(f"(m.w{k} + p.w{k}) / 2 * {a}" for k, a in enumerate(across))
    found = f"transform(filter(c.all, p -> {_square(across)} > {SAME}D), p -> ({half}) / sqrt({_square(across)}))"
    return let(points(at, randomness), "all", let("named_struct('all', all, 'm', " + _least("all", n) + ")", "c", let("c.m", "m", f"array_min({found})")))


def _least(all_: str, n: int) -> str:
    # the first of the points that are nearest
    return f"aggregate({all_}, {all_}[0], (s, p) -> CASE WHEN {_square(_parts('p.w', n))} < {_square(_parts('s.w', n))} THEN p ELSE s END)"


def radius(at: tuple[str, ...], randomness: str) -> str:
    """Half the distance from the nearest point to the point nearest to it among the cells about its own."""
    n = len(at)
    others = points(at, randomness, about=tuple(f"m.o{k}" for k in range(n)))
    far = f"sqrt({_square([f'(p.w{k} - m.w{k})' for k in range(n)])})"
    same = " AND ".join(f"p.o{k} = m.o{k}" for k in range(n))
    return let(let(points(at, randomness), "all", _least("all", n)), "m", f"array_min(transform(filter({others}, p -> NOT ({same})), p -> {far})) / 2")
