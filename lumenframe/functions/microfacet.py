"""Rough reflection by microfacets, as SQL in a frame whose z axis is the normal: slopes' distribution, masking, value, density, sampling.

i is the direction towards the viewer and o towards the light, both of length 1; alpha is the roughness squared.
"""

from __future__ import annotations

from lumenframe.functions.vector import Vector, dot

#: The fit of the masking term of Gaussian slopes, and the bound from which it masks nothing.
FIT, OPEN = (0.396, -1.259, 2.181, 3.535), 1.6


def distribution(kind: str, cos: str, alpha: str) -> str:
    """How densely facets' normals stand at a cosine, 0 below the surface: 'ggx' or 'beckmann'."""
    a2, c2 = f"({alpha} * {alpha})", f"({cos} * {cos})"
    value = f"{a2} / (pi() * (1 + ({a2} - 1) * {c2}) * (1 + ({a2} - 1) * {c2}))" if kind == "ggx" else f"exp((1 - 1 / {c2}) / {a2}) / (pi() * {a2} * {c2} * {c2})"
    return f"(CASE WHEN {cos} > 0 THEN {value} ELSE 0.0 END)"


def masking(kind: str, cos: str, alpha: str) -> str:
    """How much of what stands at a cosine is hidden for each part that is seen."""
    slope = f"({alpha} * {alpha} * (1 / ({cos} * {cos}) - 1))"
    if kind == "ggx":
        return f"((sqrt(1 + {slope}) - 1) / 2)"
    a, (p, q, r, s) = f"(1 / sqrt(greatest({slope}, 1e-30)))", FIT
    return f"(CASE WHEN {a} >= {OPEN} THEN 0.0 ELSE (({p} * {a} + {q}) * {a} + 1) / (({r} * {a} + {s}) * {a}) END)"


def reflection(name: str, kind: str, i: Vector, o: Vector, alpha: str) -> list[tuple[str, str]]:
    """Steps of name_value (times the light's cosine) and name_pdf, the density of sampling the facets that i sees."""
    half = [(f"{name}_h{k}", f"({x} + {y})") for k, x, y in zip("xyz", i, o, strict=True)]
    long = f"sqrt({dot(tuple(n for n, _ in half), tuple(n for n, _ in half))})"  # type: ignore[arg-type]
    steps = [*half, (f"{name}_c", f"(CASE WHEN {long} > 0 THEN {name}_hz / {long} ELSE 0.0 END)"), (f"{name}_d", f"(CASE WHEN {i[2]} > 0 AND {o[2]} > 0 THEN {distribution(kind, f'{name}_c', alpha)} / (4 * {i[2]}) ELSE 0.0 END)")]
    hidden = lambda v: f"(CASE WHEN {v[2]} > 0 THEN {masking(kind, v[2], alpha)} ELSE 0.0 END)"
    steps += [(f"{name}_li", hidden(i)), (f"{name}_lo", hidden(o))]
    return [*steps, (f"{name}_value", f"({name}_d / (1 + {name}_li + {name}_lo))"), (f"{name}_pdf", f"({name}_d / (1 + {name}_li))")]


def sampled(name: str, i: Vector, alpha: str, u: str, v: str) -> list[tuple[str, str]]:
    """Steps of the direction name_x, name_y, name_z into which a facet that i sees reflects it, for 'ggx', by two numbers in [0, 1).

    The surface is stretched to one of half spheres, a point of the disc that i sees of one is drawn, and its normal is
    stretched back. The direction may lie below the surface: then it counts for nothing.
    """
    s = lambda n: f"{name}_{n}"
    steps = [(s("sx"), f"({alpha} * {i[0]})"), (s("sy"), f"({alpha} * {i[1]})"), (s("sl"), f"sqrt({s('sx')} * {s('sx')} + {s('sy')} * {s('sy')} + {i[2]} * {i[2]})")]
    steps += [(s(f"w{k}"), f"({x} / {s('sl')})") for k, x in zip("xyz", (s("sx"), s("sy"), i[2]), strict=True)]
    steps += [(s("fl"), f"sqrt({s('wx')} * {s('wx')} + {s('wy')} * {s('wy')})"), (s("tx"), f"(CASE WHEN {s('fl')} > 1e-7 THEN -{s('wy')} / {s('fl')} ELSE 1.0 END)"), (s("ty"), f"(CASE WHEN {s('fl')} > 1e-7 THEN {s('wx')} / {s('fl')} ELSE 0.0 END)")]
    # the third axis across the other two
    steps += [(s("bx"), f"(-{s('wz')} * {s('ty')})"), (s("by_"), f"({s('wz')} * {s('tx')})"), (s("bz"), f"({s('wx')} * {s('ty')} - {s('wy')} * {s('tx')})")]
    steps += [(s("r"), f"sqrt({u})"), (s("a"), f"({s('r')} * cos(2 * pi() * {v}))"), (s("q"), f"({s('r')} * sin(2 * pi() * {v}))"), (s("m"), f"((1 + {s('wz')}) / 2)"), (s("b"), f"((1 - {s('m')}) * sqrt(greatest(1 - {s('a')} * {s('a')}, 0.0)) + {s('m')} * {s('q')})"), (s("z0"), f"sqrt(greatest(1 - {s('a')} * {s('a')} - {s('b')} * {s('b')}, 0.0))")]
    steps += [(s("nx"), f"({alpha} * ({s('a')} * {s('tx')} + {s('b')} * {s('bx')} + {s('z0')} * {s('wx')}))"), (s("ny"), f"({alpha} * ({s('a')} * {s('ty')} + {s('b')} * {s('by_')} + {s('z0')} * {s('wy')}))"), (s("nz"), f"greatest({s('b')} * {s('bz')} + {s('z0')} * {s('wz')}, 1e-9)"), (s("nl"), f"sqrt({s('nx')} * {s('nx')} + {s('ny')} * {s('ny')} + {s('nz')} * {s('nz')})")]
    steps += [(s("in"), f"(({i[0]} * {s('nx')} + {i[1]} * {s('ny')} + {i[2]} * {s('nz')}) / {s('nl')})")]
    return [*steps, *[(s(k), f"(2 * {s('in')} * {s('n' + k)} / {s('nl')} - {x})") for k, x in zip("xyz", i, strict=True)]]
