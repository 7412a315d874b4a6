"""Lookups in tables that rows hold as arrays, as SQL: linear between entries, curves, ramps. Spark evaluates them without a UDF."""

from __future__ import annotations


def let(value: str, name: str, body: str) -> str:
    """body with a name for a value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def channel(flat: str, which: int, of: int = 3) -> str:
    """Every `of`-th entry of a flat array from entry `which` on."""
    return f"transform(filter({flat}, (x, i) -> i % {of} = {which}), x -> double(x))"


def ramp(table: str, x: str, interpolate: str = "true", extrapolate: str = "false") -> str:
    """The value of a table over 0 to 1 at x. Beyond its ends that of the end, or of a line through the last two entries.

    Without interpolate the entry at or before x. An empty table has no value; x that is no number counts as 1.
    """
    at = "least(greatest(s.x, 0.0D), 1.0D) * (size(s.t) - 1)"
    near = let(f"named_struct('t', s.t, 'i', int({at}), 'f', {at} - int({at}))", "p", f"CASE WHEN ({interpolate}) AND p.f > 0 THEN (1 - p.f) * get(p.t, p.i) + p.f * get(p.t, p.i + 1) ELSE get(p.t, p.i) END")
    end = lambda first, second, far: f"{first} + ({first} - coalesce({second}, {first})) * ({far}) * (size(s.t) - 1)"
    below, above = end("get(s.t, 0)", "get(s.t, 1)", "-s.x"), end("get(s.t, size(s.t) - 1)", "get(s.t, size(s.t) - 2)", "s.x - 1")
    return let(f"named_struct('t', {table}, 'x', double({x}))", "s", f"CASE WHEN size(s.t) = 0 THEN CAST(NULL AS DOUBLE) WHEN ({extrapolate}) AND s.x < 0 THEN {below} WHEN ({extrapolate}) AND s.x > 1 AND NOT isnan(s.x) THEN {above} ELSE {near} END")


def curves(flat: str, v: tuple[str, ...], fac: str, low: str, high: str, extrapolate: str = "true") -> tuple[str, ...]:
    """Each component of v carried from low .. high to its curve (one of the interleaved ones of a flat table) and mixed in by fac."""
    n = len(v)
    bent = (ramp(channel(flat, i, n) if n > 1 else f"transform({flat}, x -> double(x))", f"(({x}) - ({low})) / (({high}) - ({low}))", "true", extrapolate) for i, x in enumerate(v))
    return tuple(f"((1 - ({fac})) * ({x}) + ({fac}) * ({b}))" for x, b in zip(v, bent, strict=True))


def lookup(table: str, sizes: tuple[int, ...], *at: str) -> str:
    """The value of a table of 1 to 3 dimensions, the first running fastest, at places within 0 to 1, linear along each.

    A place outside counts as the nearest within.
    """
    corners = []
    for bits in range(1 << len(sizes)):
        index, weight, stride = [], [], 1
        for k, n in enumerate(sizes):
            index.append(f"least(q.i{k} + {bits >> k & 1}, {n - 1}) * {stride}")
            weight.append(f"q.f{k}" if bits >> k & 1 else f"(1 - q.f{k})")
            stride *= n
        corners.append(f"CASE WHEN {' * '.join(weight)} = 0 THEN 0.0D ELSE {' * '.join(weight)} * get(q.t, {' + '.join(index)}) END")
    scaled = [f"least(greatest(double({x}), 0.0D), 1.0D) * {n - 1}" for x, n in zip(at, sizes, strict=True)]
    held = let("named_struct('t', " + table + "".join(f", 'x{k}', {x}" for k, x in enumerate(scaled)) + ")", "p", "named_struct('t', p.t" + "".join(f", 'i{k}', int(p.x{k}), 'f{k}', p.x{k} - int(p.x{k})" for k in range(len(sizes))) + ")")
    return let(held, "q", " + ".join(corners))
