"""Reflectance, phase functions, sample warps, weights, projections, conversions and the magic texture, as SQL."""

from __future__ import annotations

from lumenframe.functions.hashing import Steps
from lumenframe.functions.scalar import clamp
from lumenframe.functions.vector import Vector, dot

PI, TURN = "3.141592653589793", "6.283185307179586"
#: The rounds of the magic texture: which coordinate changes, by which function, with which signs of x, y and z: fixed values.
MAGIC = (("y", "-cos", "+-+"), ("x", "cos", "+--"), ("z", "sin", "---"), ("x", "-cos", "-+-"), ("y", "-sin", "-++"), ("y", "-cos", "-++"), ("x", "cos", "+++"), ("z", "sin", "++-"), ("x", "-cos", "--+"), ("y", "-sin", "+-+"))


def fresnel(cosine: str, ior: str) -> str:
    """Unpolarised reflectance of a smooth dielectric of that index for the cosine of the incidence; 1 on total reflection."""
    c = f"abs({cosine})"
    g2 = f"({ior} * {ior} - 1.0 + {c} * {c})"
    g = f"sqrt(greatest({g2}, 0.0))"
    a = f"(({g} - {c}) / ({g} + {c}))"
    b = f"((({g} + {c}) * {c} - 1.0) / (({g} - {c}) * {c} + 1.0))"
    return f"(CASE WHEN {g2} > 0 THEN 0.5 * {a} * {a} * (1.0 + {b} * {b}) ELSE 1.0 END)"


def facing(cosine: str, blend: str) -> str:
    """How much a surface turns away, with a blend of 0.5 as it is."""
    b = clamp(blend, "0.0", "0.99999")
    power = f"(CASE WHEN {b} < 0.5 THEN 2.0 * {b} ELSE 0.5 / (1.0 - {b}) END)"
    return f"(1.0 - power(abs({cosine}), {power}))"


def henyey_greenstein(cosine: str, g: str) -> str:
    """The phase function with mean cosine g."""
    return f"((1.0 - {g} * {g}) / (4.0 * {PI} * power(1.0 + {g} * {g} - 2.0 * {g} * {cosine}, 1.5)))"


def rayleigh(cosine: str) -> str:
    """Scattering by particles much smaller than the wavelength."""
    return f"(3.0 / (16.0 * {PI}) * (1.0 + {cosine} * {cosine}))"


def draine(cosine: str, g: str, alpha: str) -> str:
    """The phase function between Rayleigh's (g 0, alpha 1) and Henyey and Greenstein's (alpha 0)."""
    return f"({henyey_greenstein(cosine, g)} * (1.0 + {alpha} * {cosine} * {cosine}) / (1.0 + {alpha} * (1.0 + 2.0 * {g} * {g}) / 3.0))"


def lambert(cosine: str) -> str:
    """Diffuse reflection times the cosine."""
    return f"(greatest({cosine}, 0.0) / {PI})"


def disc(name: str, u: str, v: str) -> Steps:
    """A point of the unit disc by squares mapped to rings: name_x and name_y."""
    a, b = f"{name}_a", f"{name}_b"
    big = f"abs({a}) > abs({b})"
    return [(a, f"(2.0 * {u} - 1.0)"), (b, f"(2.0 * {v} - 1.0)"), (f"{name}_r", f"(CASE WHEN {big} THEN {a} ELSE {b} END)"), (f"{name}_phi", f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0.0 WHEN {big} THEN {PI} / 4.0 * {b} / {a} ELSE {PI} / 2.0 - {PI} / 4.0 * {a} / {b} END)"), (f"{name}_x", f"({name}_r * cos({name}_phi))"), (f"{name}_y", f"({name}_r * sin({name}_phi))")]


def cosine_hemisphere(name: str, u: str, v: str) -> Steps:
    """A direction about +z by the cosine, with name_pdf."""
    return [*disc(name, u, v), (f"{name}_z", f"sqrt(greatest(1.0 - {name}_x * {name}_x - {name}_y * {name}_y, 0.0))"), (f"{name}_pdf", f"({name}_z / {PI})")]


def around(name: str, z: str, v: str) -> Steps:
    """A direction of height z, a turn v about the axis: with z = u the uniform hemisphere, 1 - 2 u the sphere, 1 - u (1 - cos) a cone."""
    return [(f"{name}_z", z), (f"{name}_r", f"sqrt(greatest(1.0 - {name}_z * {name}_z, 0.0))"), (f"{name}_x", f"({name}_r * cos({TURN} * {v}))"), (f"{name}_y", f"({name}_r * sin({TURN} * {v}))")]


def balance(a: str, b: str) -> str:
    """The weight of a among two densities."""
    return f"(CASE WHEN {a} + {b} > 0 THEN {a} / ({a} + {b}) ELSE 0.0 END)"


def power_weight(a: str, b: str) -> str:
    """The weight of a by squares."""
    return balance(f"({a} * {a})", f"({b} * {b})")


def continuation(r: str, g: str, b: str) -> str:
    """The probability that a path goes on: the root of its largest throughput, at most 1."""
    return f"least(sqrt(greatest({r}, {g}, {b}, 0.0)), 1.0)"


def clamped_light(c: Vector, limit: str) -> Vector:
    """A colour whose sum of absolute channels is over the limit, scaled down to it; a limit of 0 is none."""
    total = "(" + " + ".join(f"abs({x})" for x in c) + ")"
    return tuple(f"(CASE WHEN {limit} > 0 AND {total} > {limit} THEN {x} * {limit} / {total} ELSE {x} END)" for x in c)  # type: ignore[return-value]


def equirectangular(d: Vector) -> tuple[str, str]:
    """Longitude and latitude of a direction as places from 0 to 1."""
    long = f"sqrt({dot(d, d)})"
    return f"(-atan2({d[1]}, {d[0]}) / {TURN} + 0.5)", f"(CASE WHEN {long} > 0 THEN acos({clamp(f'{d[2]} / {long}', '-1.0', '1.0')}) / -{PI} + 1.0 ELSE 0.5 END)"


def from_equirectangular(u: str, v: str) -> Vector:
    """The direction at places of longitude and latitude."""
    phi, theta = f"(-{TURN} * ({u} - 0.5))", f"({PI} * (1.0 - {v}))"
    return f"(sin({theta}) * cos({phi}))", f"(sin({theta}) * sin({phi}))", f"cos({theta})"


def to_byte(x: str) -> str:
    """A value from 0 to 1 as a byte, rounded."""
    return f"CAST(floor({clamp(x)} * 255.0 + 0.5) AS BIGINT)"


def ramp(x: str, stops: tuple[float, ...], smooth: bool = True) -> str:
    """x looked up in equidistant stops over 0 to 1: between neighbours, or the one at or before it."""
    last = len(stops) - 1
    place = f"({clamp(x)} * {float(last)})"
    cases = []
    for i, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
        cases.append(f"WHEN {place} < {float(i + 1)} THEN " + (f"{a} + ({b - a}) * ({place} - {float(i)})" if smooth else f"{a}"))
    return f"(CASE {' '.join(cases)} ELSE {stops[-1]} END)"


def magic(name: str, p: Vector, depth: int, distortion: str) -> Steps:
    """Nested waves of a point: name_x, name_y and name_z; each round changes one coordinate."""
    steps: Steps = [(f"{name}_p{k}", f"({c} - {TURN} * (CASE WHEN {c} >= 0 THEN floor({c} / {TURN}) ELSE ceil({c} / {TURN}) END))") for k, c in zip("xyz", p, strict=True)]
    x, y, z = (f"{name}_p{k}" for k in "xyz")
    at = {}
    for k, value in (("x", f"sin(({x} + {y} + {z}) * 5.0)"), ("y", f"cos((-{x} + {y} - {z}) * 5.0)"), ("z", f"-cos((-{x} - {y} + {z}) * 5.0)")):
        steps.append((f"{name}_0{k}", f"({value}) * {distortion}" if depth else f"({value})"))
        at[k] = f"{name}_0{k}"
    for i, (k, f, signs) in enumerate(MAGIC[:depth], 1):
        inner = " ".join(f"{s} {at[c]}" for s, c in zip(signs, "xyz", strict=True))
        steps.append((f"{name}_{i}{k}", f"{f}({inner}) * {distortion}"))
        at[k] = f"{name}_{i}{k}"
    return [*steps, *[(f"{name}_{k}", f"(CASE WHEN {distortion} <> 0 THEN 0.5 - {at[k]} / (2.0 * {distortion}) ELSE 0.5 - {at[k]} END)") for k in "xyz"]]
