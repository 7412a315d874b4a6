"""Rays against planes, discs, quads, triangles, spheres, boxes and cylinders, and rotations, as steps of SQL.

Each function gives a chain of named steps for `hashing.staged`; the last ones are its results. A ray starts at p, goes
along d and counts from t = 0; a miss is -1.
"""

from __future__ import annotations

from lumenframe.functions.hashing import Steps
from lumenframe.functions.vector import Vector, cross, dot, each


def minus(a: Vector, b: Vector) -> Vector:
    """a - b."""
    return each(lambda x, y: f"({x} - {y})", a, b)


def along(p: Vector, d: Vector, t: str) -> Vector:
    """The point of a ray at t."""
    return each(lambda x, y: f"({x} + {t} * {y})", p, d)


def named(name: str, v: Vector) -> tuple[Steps, Vector]:
    """A vector as three steps, and the names they have."""
    names = tuple(f"{name}_{k}" for k in "xyz")
    return list(zip(names, v, strict=True)), names  # type: ignore[return-value]


def plane(name: str, p: Vector, d: Vector, q: Vector, n: Vector) -> Steps:
    """Where a ray meets the plane through q across n, ahead of its start."""
    return [(f"{name}_down", dot(d, n)), (f"{name}_up", dot(minus(q, p), n)), (name, f"(CASE WHEN {name}_down <> 0 AND {name}_up / {name}_down >= 0 THEN {name}_up / {name}_down ELSE -1.0 END)")]


def disc(name: str, p: Vector, d: Vector, q: Vector, n: Vector, radius: str) -> Steps:
    """The plane's hit if it is no further than radius from q."""
    off = minus(along(p, d, f"{name}_t"), q)
    return [*plane(f"{name}_t", p, d, q, n), (name, f"(CASE WHEN {name}_t >= 0 AND {dot(off, off)} <= {radius} * {radius} THEN {name}_t ELSE -1.0 END)")]


def quad(name: str, p: Vector, d: Vector, q: Vector, u: Vector, v: Vector, ellipse: bool = False) -> Steps:
    """The hit of the rectangle with centre q and whole sides u and v, or of the ellipse in it; name_u and name_v run from -0.5 to 0.5."""
    first, n = named(f"{name}_n", cross(u, v))
    off, o = named(f"{name}_o", minus(along(p, d, f"{name}_t"), q))
    inside = f"{name}_u * {name}_u + {name}_v * {name}_v <= 0.25" if ellipse else f"abs({name}_u) <= 0.5 AND abs({name}_v) <= 0.5"
    return [*first, *plane(f"{name}_t", p, d, q, n), *off, (f"{name}_u", f"({dot(o, u)} / {dot(u, u)})"), (f"{name}_v", f"({dot(o, v)} / {dot(v, v)})"), (name, f"(CASE WHEN {name}_t >= 0 AND {inside} THEN {name}_t ELSE -1.0 END)")]


def triangle(name: str, p: Vector, d: Vector, a: Vector, b: Vector, c: Vector) -> Steps:
    """The hit of a triangle, with name_u and name_v, the weights of b and c. An edge belongs to the triangle."""
    s1, e1 = named(f"{name}_e", minus(b, a))
    s2, e2 = named(f"{name}_f", minus(c, a))
    s3, h = named(f"{name}_h", cross(d, e2))
    s4, s = named(f"{name}_s", minus(p, a))
    s5, k = named(f"{name}_k", cross(s, e1))
    part = lambda x: f"(CASE WHEN {name}_det <> 0 THEN {x} / {name}_det ELSE 0.0 END)"
    steps = [*s1, *s2, *s3, (f"{name}_det", dot(e1, h)), *s4, *s5, (f"{name}_u", part(dot(s, h))), (f"{name}_v", part(dot(d, k))), (f"{name}_t", part(dot(e2, k)))]
    return [*steps, (name, f"(CASE WHEN {name}_det <> 0 AND {name}_u >= 0 AND {name}_v >= 0 AND {name}_u + {name}_v <= 1 AND {name}_t >= 0 THEN {name}_t ELSE -1.0 END)")]


def sphere(name: str, p: Vector, d: Vector, q: Vector, radius: str) -> Steps:
    """The first crossing of a sphere ahead of a ray of any direction and length."""
    s, o = named(f"{name}_o", minus(p, q))
    steps = [*s, (f"{name}_a", dot(d, d)), (f"{name}_b", dot(o, d)), (f"{name}_c", f"({name}_b * {name}_b - {name}_a * ({dot(o, o)} - {radius} * {radius}))"), (f"{name}_r", f"sqrt(greatest({name}_c, 0.0))")]
    return [*steps, (name, f"(CASE WHEN {name}_c < 0 OR {name}_a = 0 OR {name}_r < {name}_b THEN -1.0 WHEN -{name}_b - {name}_r >= 0 THEN (-{name}_b - {name}_r) / {name}_a ELSE ({name}_r - {name}_b) / {name}_a END)")]


def box(name: str, p: Vector, d: Vector, low: Vector, high: Vector) -> Steps:
    """The stretch name_in .. name_out of a ray in a box; both are -1 where it misses. Along an axis that it does not run, it is in or out."""
    steps: Steps = []
    for k, (x, y, lo, hi) in zip("xyz", zip(p, d, low, high, strict=True), strict=True):
        still = f"CASE WHEN {x} BETWEEN {lo} AND {hi} THEN {{}} ELSE {{}} END"
        steps.append((f"{name}_lo{k}", f"(CASE WHEN {y} <> 0 THEN least(({lo} - {x}) / {y}, ({hi} - {x}) / {y}) ELSE {still.format('-1e30', '1e30')} END)"))
        steps.append((f"{name}_hi{k}", f"(CASE WHEN {y} <> 0 THEN greatest(({lo} - {x}) / {y}, ({hi} - {x}) / {y}) ELSE {still.format('1e30', '-1e30')} END)"))
    steps.append((f"{name}_a", f"greatest({name}_lox, {name}_loy, {name}_loz, 0.0)"))
    steps.append((f"{name}_b", f"least({name}_hix, {name}_hiy, {name}_hiz)"))
    return [*steps, *[(f"{name}_{n}", f"(CASE WHEN {name}_a <= {name}_b THEN {name}_{v} ELSE -1.0 END)") for n, v in (("in", "a"), ("out", "b"))]]


def cylinder(name: str, p: Vector, d: Vector, u: str, v: str) -> Steps:
    """The stretch name_in .. name_out of a line in an endless cylinder along z whose section has the half axes u and v."""
    steps: Steps = [(f"{name}_a", f"({d[0]} * {d[0]} / ({u} * {u}) + {d[1]} * {d[1]} / ({v} * {v}))"), (f"{name}_b", f"({p[0]} * {d[0]} / ({u} * {u}) + {p[1]} * {d[1]} / ({v} * {v}))"), (f"{name}_c", f"({p[0]} * {p[0]} / ({u} * {u}) + {p[1]} * {p[1]} / ({v} * {v}) - 1.0)")]
    steps.append((f"{name}_q", f"({name}_b * {name}_b - {name}_a * {name}_c)"))
    return [*steps, *[(f"{name}_{n}", f"(CASE WHEN {name}_a > 0 AND {name}_q >= 0 THEN (-{name}_b {s} sqrt(greatest({name}_q, 0.0))) / {name}_a ELSE 0.0 END)") for n, s in (("in", "-"), ("out", "+"))], (f"{name}_hit", f"(CASE WHEN {name}_a > 0 AND {name}_q >= 0 THEN 1.0 ELSE 0.0 END)")]


def rotate(name: str, x: Vector, axis: Vector, angle: str, centre: Vector) -> Steps:
    """x turned by angle about an axis through centre; unmoved about an axis of no length."""
    s1, o = named(f"{name}_o", minus(x, centre))
    long = f"{name}_long"
    s2, n = named(f"{name}_n", each(lambda c: f"(CASE WHEN {long} > 0 THEN {c} / {long} ELSE 0.0 END)", axis))
    steps = [*s1, (long, f"sqrt({dot(axis, axis)})"), *s2, (f"{name}_cos", f"cos({angle})"), (f"{name}_sin", f"sin({angle})"), (f"{name}_d", dot(n, o))]
    turned = each(lambda a, b, c, e: f"(CASE WHEN {long} > 0 THEN {e} + {a} * {name}_cos + {b} * {name}_sin + {c} * {name}_d * (1.0 - {name}_cos) ELSE {e} + {a} END)", o, cross(n, o), n, centre)
    return [*steps, *named(name, turned)[0]]


def euler(name: str, x: Vector, angles: Vector, back: bool = False) -> Steps:
    """x turned about the x axis, then y, then z; with back, the other way about."""
    steps, at = [], x
    order = [(0, 1, 2), (1, 2, 0), (2, 0, 1)]
    for n, (axis, i, j) in enumerate(reversed(order) if back else order):
        c, s = f"cos({angles[axis]})", f"{'-' if back else ''}sin({angles[axis]})"
        new = list(at)
        new[i], new[j] = f"({at[i]} * {c} - {at[j]} * ({s}))", f"({at[i]} * ({s}) + {at[j]} * {c})"
        more, at = named(f"{name}_{n}", tuple(new))  # type: ignore[arg-type]
        steps += more
    return [*steps, *named(name, at)[0]]


def mapping(kind: str, name: str, x: Vector, move: Vector, angles: Vector, size: Vector) -> Steps:
    """point: scaled, turned and moved; texture: that undone; vector: scaled and turned; normal: divided, turned and made as long as 1."""
    by = lambda a: each(lambda c, k: f"(CASE WHEN {k} <> 0 THEN {c} / {k} ELSE 0.0 END)", a, size)
    if kind == "texture":
        s, o = named(f"{name}_o", minus(x, move))
        turned = euler(f"{name}_r", o, angles, True)
        return [*s, *turned, *named(name, by(named(f"{name}_r", x)[1]))[0]]
    s, o = named(f"{name}_o", by(x) if kind == "normal" else each(lambda c, k: f"({c} * {k})", x, size))
    turned, r = euler(f"{name}_r", o, angles), named(f"{name}_r", x)[1]
    if kind == "normal":
        return [*s, *turned, (f"{name}_l", f"sqrt({dot(r, r)})"), *named(name, each(lambda c: f"(CASE WHEN {name}_l > 0 THEN {c} / {name}_l ELSE 0.0 END)", r))[0]]
    return [*s, *turned, *named(name, each(lambda c, m: f"({c} + {m})", r, move) if kind == "point" else r)[0]]
