"""Number codecs, paths and readable sizes as SQL that Spark and DuckDB share."""

from __future__ import annotations

from collections.abc import Callable

from lumenframe.functions.hashing import Steps

#: The least and largest exponents and the digits of half floats; the bias, digits and top of shared-exponent colours.
HALF_LOW, HALF_HIGH, HALF_BITS = -14, 15, 10
SHARED_BIAS, SHARED_BITS, SHARED_TOP = 15, 8, 65280.0


def _power(e: str) -> str:
    return f"power(CAST(2 AS DOUBLE), {e})"


def exponent(x: str, low: int, high: int) -> str:
    """The largest whole e from low to high with 2^e at most x, low below that: a count of powers, since logarithms may be off at them."""
    return f"CAST({low} " + " ".join(f"+ CASE WHEN {x} >= {2.0**e:.17g} THEN 1 ELSE 0 END" for e in range(low + 1, high + 1)) + " AS BIGINT)"


def logged(name: str, x: str, low: int, high: int, plus: int = 0) -> Steps:
    """Steps to the same number, plus some, in few operations, for Spark: a logarithm, put right by a comparison with the powers about it."""
    near = f"floor(log2(greatest(least({x}, {2.0**high:.17g}D), {2.0**low:.17g}D)))"
    right = f"CASE WHEN {x} >= {_power(f'({name}_g + 1)')} THEN 1 WHEN {x} < {_power(f'{name}_g')} THEN -1 ELSE 0 END"
    return [(f"{name}_g", near), (name, f"CAST(CASE WHEN {x} IS NULL THEN {low} ELSE least(greatest({name}_g + {right}, {low}), {high}) END + {plus} AS BIGINT)")]


def counted(name: str, x: str, low: int, high: int, plus: int = 0) -> Steps:
    """exponent as a step, plus some."""
    return [(name, f"({exponent(x, low, high)} + {plus})" if plus else exponent(x, low, high))]


def to_half(name: str, x: str, exponents: Callable[..., Steps] = counted) -> Steps:
    """Steps to the 16 bits of the half float nearest to x, ties to even; infinite from 65520 on."""
    n = name
    return [
        (f"{n}_a", f"abs({x})"),
        *exponents(f"{n}_e", f"{n}_a", HALF_LOW, HALF_HIGH),
        (f"{n}_q", f"(least({n}_a, 70000.0) * {_power(f'({HALF_BITS} - {n}_e)')})"),
        (f"{n}_f", f"CAST(floor({n}_q) AS BIGINT)"),
        (f"{n}_r", f"({n}_f + CASE WHEN {n}_q - {n}_f > 0.5 OR ({n}_q - {n}_f = 0.5 AND {n}_f % 2 = 1) THEN 1 ELSE 0 END)"),
        (n, f"CAST(least(({n}_e - ({HALF_LOW})) * {1 << HALF_BITS} + {n}_r, 31744) + CASE WHEN {x} < 0 THEN 32768 ELSE 0 END AS BIGINT)"),
    ]


def from_half(bits: str) -> str:
    """The number that 16 bits stand for; the largest exponent is infinite."""
    e, m = f"(CAST(floor({bits} / 1024.0) AS BIGINT) & 31)", f"({bits} & 1023)"
    size = f"CASE WHEN {e} = 0 THEN {m} * {_power('-24')} WHEN {e} = 31 THEN CAST('Infinity' AS DOUBLE) ELSE (1024 + {m}) * {_power(f'({e} - 25)')} END"
    return f"((CASE WHEN {bits} >= 32768 THEN -1.0 ELSE 1.0 END) * ({size}))"


def shared_exponent(name: str, r: str, g: str, b: str, exponents: Callable[..., Steps] = counted) -> Steps:
    """Steps to the colour that survives 8 bits a channel with one exponent: name_r, name_g and name_b.

    Channels are rounded to the nearest step of the largest one, held at 255 steps; a colour too small for a step is black.
    """
    n = name
    top = f"least(greatest(abs({r}), abs({g}), abs({b})), {SHARED_TOP})"
    near = lambda x: f"floor({x} * {_power(f'({SHARED_BITS} - {n}_e)')} + 0.5)"
    step = _power(f"({n}_d - {SHARED_BITS})")
    channel = lambda x: f"(CASE WHEN {n}_t < {0.5 * 2.0 ** -(SHARED_BIAS + SHARED_BITS):.17g} THEN 0.0 ELSE sign({x}) * least(floor(abs({x}) / {step} + 0.5), 255.0) * {step} END)"
    return [(f"{n}_t", top), *exponents(f"{n}_e", f"{n}_t", -SHARED_BIAS - 1, 15, 1), (f"{n}_d", f"({n}_e + CASE WHEN {near(f'{n}_t')} >= 256 THEN 1 ELSE 0 END)"), *((f"{n}_{k}", channel(x)) for k, x in zip("rgb", (r, g, b), strict=True))]


def file_name(path: str) -> str:
    """What follows the last slash: "." if nothing does, "/" of the root itself."""
    return f"(CASE WHEN {path} = '/' THEN '/' WHEN {path} LIKE '%/' THEN '.' ELSE reverse(split_part(reverse({path}), '/', 1)) END)"


def folder(path: str) -> str:
    """What precedes the last slash: "/" right below the root, nothing without a slash."""
    rest = f"length({path}) - length(split_part(reverse({path}), '/', 1)) - 1"
    return f"(CASE WHEN {path} NOT LIKE '%/%' OR {path} = '/' THEN '' WHEN {rest} <= 0 THEN '/' ELSE substr({path}, 1, {rest}) END)"


def joined(a: str, b: str) -> str:
    """A path in a folder, with a slash between them unless one has it or either is empty."""
    return f"(CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN {a} LIKE '%/' OR {b} LIKE '/%' THEN concat({a}, {b}) ELSE concat({a}, '/', {b}) END)"


def thousands(x: str) -> str:
    """A whole number that is not negative, in groups of three digits."""
    parts = lambda k: f"lpad(CAST(CAST(floor({x} / {1000**k}.0) AS BIGINT) % 1000 AS STRING), 3, '0')"
    lead = lambda k: f"CAST(CAST(floor({x} / {1000**k}.0) AS BIGINT) AS STRING)"
    cases = " ".join(f"WHEN {x} < {1000 ** (k + 1)} THEN concat({', '.join([lead(k), *(p for j in range(k - 1, -1, -1) for p in (chr(39) + ',' + chr(39), parts(j)))])})" for k in range(1, 5))
    return f"(CASE WHEN {x} < 1000 THEN CAST({x} AS STRING) {cases} END)"


def aligned(start: str, count: str, least: int, step: int) -> str:
    """How many of count samples from start run before a convergence test is due.

    Tests follow samples above `least` whose number is one less than a multiple of step, a power of two.
    """
    first = (least + 1) | (step - 1)
    due = f"greatest({first}, ({start} - {start} % {step} + {step - 1}))"
    return f"CAST(CASE WHEN {start} + {count} <= {first} THEN {count} ELSE least({due} - {start} + 1, {count}) END AS BIGINT)"


def tested(sample: str, least: int, step: int) -> str:
    """1 where a convergence test follows the sample."""
    return f"(CASE WHEN {sample} > {least} AND {sample} % {step} = {step - 1} THEN 1 ELSE 0 END)"
