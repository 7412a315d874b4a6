"""Lattice noise, its fractal sums, and cellular (Voronoi) distances, as SQL in levels.

The corners of a cell, the octaves of a sum and the cells around a point are independent of each other, so their hashes
advance side by side: one level holds the same step of all of them. `leveled` writes a select per level that carries only what
later levels still name, so that rows stay narrow. About a dozen corners (three octaves in the plane, one in space) fit
one generated method; beyond that Spark leaves whole-stage code generation and evaluates select by select.
"""

from __future__ import annotations

import re
from itertools import product

from lumenframe.functions import hashing
from lumenframe.functions.hashing import Steps

Levels = list[Steps]
#: What brings gradient noise of one to three dimensions to [-1, 1], where coordinates repeat, and from where on they are moved to the middle of a cell.
SCALES = {1: "0.25", 2: "0.6616", 3: "0.982"}
PERIOD, LARGE = "100000.0", "1000000.0"
#: The largest value of the cell hash.
TOP = "2147483647.0"
FRACTALS = ("fbm", "multifractal", "hetero_terrain", "hybrid_multifractal", "ridged_multifractal")
METRICS = ("euclidean", "manhattan", "chebychev", "minkowski")


def abreast(chains: list[Levels]) -> Levels:
    """Independent chains side by side."""
    return [[step for c in chains if i < len(c) for step in c[i]] for i in range(max(map(len, chains)))]


def one_a_level(steps: Steps) -> Levels:
    """A chain whose every step needs the one before."""
    return [[s] for s in steps]


def leveled(source: str, keep: tuple[str, ...], inputs: dict[str, str], levels: Levels, results: dict[str, str]) -> str:
    """keep and results over source; inputs are the first level, and each level's columns live until the last level that names them."""
    names = lambda texts: set(re.findall(r"[a-z_]\w*", " ".join(texts)))
    named = [names(x for _, x in level) for level in levels] + [names(results.values())]
    sql = f"SELECT {', '.join([*keep, *(f'CAST({x} AS DOUBLE) AS {n}' for n, x in inputs.items())])} FROM {source}"
    have = list(inputs)
    for i, level in enumerate(levels):
        later = set().union(*named[i + 1 :])
        have = [n for n in have if n in later]
        sql = f"SELECT {', '.join([*keep, *have, *(f'{x} AS {n}' for n, x in level)])} FROM ({sql}) AS s"
        have += [n for n, _ in level]
    return f"SELECT {', '.join([*keep, *(f'{x} AS {n}' for n, x in results.items())])} FROM ({sql}) AS s"


def _gradient(h: str, at: list[str]) -> str:
    # the lattice vector that the lowest bits of h choose, times the way from the corner to the point
    turned = lambda x, bit: f"(CASE WHEN ({h} & {bit}) <> 0 THEN -{x} ELSE {x} END)"
    if len(at) == 1:
        return f"((1.0 + ({h} & 7)) * {turned(at[0], 8)})"
    if len(at) == 2:
        first, second = (f"(CASE WHEN ({h} & 7) < 4 THEN {a} ELSE {b} END)" for a, b in (at, at[::-1]))
        return f"({turned(first, 1)} + 2.0 * {turned(second, 2)})"
    x, y, z = at
    first = f"(CASE WHEN ({h} & 8) = 0 THEN {x} ELSE {y} END)"
    second = f"(CASE WHEN ({h} & 12) = 0 THEN {y} WHEN ({h} & 13) = 12 THEN {x} ELSE {z} END)"
    return f"({turned(first, 1)} + {turned(second, 2)})"


def perlin(name: str, point: tuple[str, ...]) -> Levels:
    """Gradient noise in [-1, 1] of a point of one to three dimensions; the last level is `name`."""
    axes = range(len(point))
    moved = [(f"{name}_m{i}", f"({p} % {PERIOD} + (CASE WHEN abs({p}) >= {LARGE} THEN 0.5 ELSE 0.0 END))") for i, p in enumerate(point)]
    whole = [(f"{name}_w{i}", f"CAST(floor({name}_m{i}) AS BIGINT)") for i in axes]
    part = [(f"{name}_p{i}", f"({name}_m{i} - floor({name}_m{i}))") for i in axes]
    corners = list(product((0, 1), repeat=len(point)))
    label = lambda c: f"{name}_h" + "".join(map(str, c))
    hashes = [one_a_level(hashing.jenkins(label(c), *(f"({name}_w{i} + {c[i]})" for i in axes))) for c in corners]
    reached = [(f"{label(c)}g", _gradient(label(c), [f"({name}_p{i} - {c[i]}.0)" for i in axes])) for c in corners]
    eased = [(f"{name}_e{i}", "({0} * {0} * {0} * ({0} * ({0} * 6.0 - 15.0) + 10.0))".format(f"{name}_p{i}")) for i in axes]
    value = " + ".join("(" + " * ".join([f"{label(c)}g", *(f"{name}_e{i}" if c[i] else f"(1.0 - {name}_e{i})" for i in axes)]) + ")" for c in corners)
    return [moved, whole + part, *abreast(hashes), reached + eased, [(name, f"(({value}) * {SCALES[len(point)]})")]]


def fractal(name: str, kind: str, point: tuple[str, ...], detail: float, roughness: float, lacunarity: float, offset: float = 0.0, gain: float = 1.0, normalize: bool = True) -> Levels:
    """Octaves of noise, each lacunarity finer and roughness weaker: detail whole ones after the first and one more by what is left of detail.

    A detail, roughness or lacunarity is a number of the graph, not a column, so the number of levels is known. The
    ridged kind has whole octaves only.
    """
    whole, rest = int(detail), detail - int(detail)
    count = 1 + whole + (1 if rest and kind != "ridged_multifractal" else 0)
    octaves = [perlin(f"{name}_o{i}", tuple(f"({lacunarity**i} * {p})" for p in point)) for i in range(count)]
    o, share, levels = (lambda i: f"{name}_o{i}"), (lambda i: rest if i > whole else 1.0), abreast(octaves)
    number = lambda x: f"CAST({x!r} AS DOUBLE)"
    if kind == "fbm":
        def total(n: int) -> str:
            amounts = [roughness**i for i in range(n)]
            text = " + ".join(f"{number(a)} * {o(i)}" for i, a in enumerate(amounts))
            return f"(0.5 * ({text}) / {number(sum(amounts))} + 0.5)" if normalize else f"({text})"

        return [*levels, [(name, f"({total(whole + 1)} * {number(1 - rest)} + {total(count)} * {number(rest)})" if rest else total(count))]]
    if kind == "multifractal":
        return [*levels, [(name, "(" + " * ".join(f"({number(share(i) * roughness**i)} * {o(i)} + 1.0)" for i in range(count)) + ")")]]
    v, w = (lambda i: f"{name}_v{i}"), (lambda i: f"{name}_k{i}")
    if kind == "hetero_terrain":
        levels.append([(v(0), f"({number(offset)} + {o(0)})")])
        for i in range(1, count):
            levels.append([(v(i), f"({v(i - 1)} + {number(share(i) * roughness**i)} * ({o(i)} + {number(offset)}) * {v(i - 1)})")])
    elif kind == "hybrid_multifractal":
        # a weight of 0.001 or less ends the sum: it is 0 from there on
        levels.append([(v(0), f"({o(0)} + {number(offset)})"), (w(0), f"({number(gain)} * ({o(0)} + {number(offset)}))")])
        for i in range(1, count):
            held = f"(CASE WHEN {w(i - 1)} > 0.001 THEN least({w(i - 1)}, 1.0) ELSE 0.0 END)"
            signal = f"(({o(i)} + {number(offset)}) * {number(roughness**i)})"
            levels.append([(v(i), f"({v(i - 1)} + {number(share(i))} * {held} * {signal})"), (w(i), f"({held} * {number(gain)} * {signal})")])
    else:
        ridge = lambda i: f"(({number(offset)} - abs({o(i)})) * ({number(offset)} - abs({o(i)})))"
        levels.append([(v(0), ridge(0)), (w(0), ridge(0))])
        for i in range(1, count):
            signal = f"({ridge(i)} * greatest(least({w(i - 1)} * {number(gain)}, 1.0), 0.0))"
            levels.append([(v(i), f"({v(i - 1)} + {number(roughness**i)} * {signal})"), (w(i), signal)])
    return [*levels, [(name, v(count - 1))]]


def distance(metric: str, way: list[str], exponent: str = "2.5") -> str:
    """The length of a way by one of METRICS."""
    sizes = [f"abs({x})" for x in way]
    return {
        "euclidean": f"sqrt({' + '.join(f'{x} * {x}' for x in way)})",
        "manhattan": f"({' + '.join(sizes)})",
        "chebychev": f"greatest({', '.join(sizes)})",
        "minkowski": f"power({' + '.join(f'power({x}, {exponent})' for x in sizes)}, 1.0 / {exponent})",
    }[metric]


def voronoi(name: str, x: str, y: str, metric: str = "euclidean", randomness: str = "1.0") -> Levels:
    """Distances of a point of the plane to the nearest (name_f1) and second nearest (name_f2) of the points that nine cells hold, and the nearest one's place (name_x, name_y).

    The nine distances are equal joins on cells without the join: each cell's point is a hash of the cell.
    """
    cells = list(product((-1, 0, 1), repeat=2))
    first = [(f"{name}_cx", f"CAST(floor({x}) AS BIGINT)"), (f"{name}_cy", f"CAST(floor({y}) AS BIGINT)"), (f"{name}_lx", f"({x} - floor({x}))"), (f"{name}_ly", f"({y} - floor({y}))")]
    label = lambda i: f"{name}_n{i}"
    hashes = abreast([one_a_level(hashing.pcg2d(label(i), hashing.cut(f"{name}_cx + {a}"), hashing.cut(f"{name}_cy + {b}"))) for i, (a, b) in enumerate(cells)])
    places = [(f"{label(i)}_p{k}", f"({c}.0 + {label(i)}_{k} / {TOP} * {randomness})") for i, cell in enumerate(cells) for k, c in zip("xy", cell, strict=True)]
    ways = [(f"{label(i)}_d", distance(metric, [f"({label(i)}_p{k} - {name}_l{k})" for k in "xy"])) for i in range(len(cells))]
    levels = [first, *hashes, places, ways, [(f"{name}_a1", f"least({label(0)}_d, {label(1)}_d)"), (f"{name}_b1", f"greatest({label(0)}_d, {label(1)}_d)")]]
    for i in range(2, len(cells)):
        best, next_best, d = f"{name}_a{i - 1}", f"{name}_b{i - 1}", f"{label(i)}_d"
        levels.append([(f"{name}_a{i}", f"least({best}, {d})"), (f"{name}_b{i}", f"least({next_best}, greatest({best}, {d}))")])
    last = f"{name}_a{len(cells) - 1}"
    nearest = lambda k: "(CASE " + " ".join(f"WHEN {label(i)}_d = {last} THEN {label(i)}_p{k}" for i in range(len(cells))) + f" END + {name}_c{k})"
    return [*levels, [(f"{name}_f1", last), (f"{name}_f2", f"{name}_b{len(cells) - 1}"), (f"{name}_x", nearest("x")), (f"{name}_y", nearest("y"))]]

