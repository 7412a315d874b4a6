"""Scalar operators as SQL expressions that Spark and other engines read alike.

Each takes and gives texts of expressions, so an operator composes with any other and stays inside code generation.
Division by zero, roots of negatives and the like have a defined result (mostly 0), never an error or a null.
"""

from __future__ import annotations

#: Differences up to this count as equal: a fixed value (the machine epsilon of 32-bit floats).
EPSILON = "1.1920929e-07"


def divide(a: str, b: str) -> str:
    """a / b, 0 where b is 0."""
    return f"(CASE WHEN {b} <> 0 THEN {a} / {b} ELSE 0.0 END)"


def power(a: str, b: str) -> str:
    """a ^ b; 0 for a negative base with a broken exponent and for a zero base."""
    return f"(CASE WHEN {b} = 0 THEN 1.0 WHEN {a} = 0 THEN 0.0 WHEN {a} < 0 AND {b} <> floor({b}) THEN 0.0 ELSE power({a}, {b}) END)"


def logarithm(a: str, b: str) -> str:
    """The logarithm of a to base b; 0 where there is none."""
    return f"(CASE WHEN {a} <= 0 OR {b} <= 0 OR {b} = 1 THEN 0.0 ELSE ln({a}) / ln({b}) END)"


def wrap(value: str, high: str, low: str) -> str:
    """value moved by whole ranges into low .. high; low where the range is empty."""
    span = f"({high} - {low})"
    return f"(CASE WHEN {span} <> 0 THEN {value} - {span} * floor(({value} - {low}) / {span}) ELSE {low} END)"


def pingpong(a: str, b: str) -> str:
    """a folded to and fro between 0 and b."""
    x = f"(({a} - {b}) / ({b} * 2.0))"
    return f"(CASE WHEN {b} <> 0 THEN abs(({x} - floor({x})) * {b} * 2.0 - {b}) ELSE 0.0 END)"


def smooth_min(a: str, b: str, c: str) -> str:
    """The minimum, rounded off where a and b are nearer than c."""
    h = f"(greatest({c} - abs({a} - {b}), 0.0) / {c})"
    return f"(CASE WHEN {c} <> 0 THEN least({a}, {b}) - {h} * {h} * {h} * {c} / 6.0 ELSE least({a}, {b}) END)"


def clamp(x: str, low: str = "0.0", high: str = "1.0") -> str:
    """x between low and high."""
    return f"least(greatest({x}, {low}), {high})"


def floored_modulo(a: str, b: str) -> str:
    """The remainder with the sign of b."""
    return f"(CASE WHEN {b} <> 0 THEN {a} - floor({a} / {b}) * {b} ELSE 0.0 END)"


def modulo(a: str, b: str) -> str:
    """The remainder with the sign of a."""
    return f"(CASE WHEN {b} <> 0 THEN {a} % {b} ELSE 0.0 END)"


UNARY = {
    "sine": "sin({a})",
    "cosine": "cos({a})",
    "tangent": "tan({a})",
    "arcsine": "asin(least(greatest({a}, -1.0), 1.0))",
    "arccosine": "acos(least(greatest({a}, -1.0), 1.0))",
    "arctangent": "atan({a})",
    "round": "floor({a} + 0.5)",
    "absolute": "abs({a})",
    "floor": "floor({a})",
    "ceil": "ceil({a})",
    "fraction": "({a} - floor({a}))",
    "sqrt": "sqrt(greatest({a}, 0.0))",
    "inv_sqrt": "(CASE WHEN {a} > 0 THEN 1.0 / sqrt({a}) ELSE 0.0 END)",
    "sign": "sign({a})",
    "exponent": "exp({a})",
    "radians": "radians({a})",
    "degrees": "degrees({a})",
    "sinh": "sinh({a})",
    "cosh": "cosh({a})",
    "tanh": "tanh({a})",
    "trunc": "(CASE WHEN {a} >= 0 THEN floor({a}) ELSE ceil({a}) END)",
}
BINARY = {
    "add": lambda a, b: f"({a} + {b})",
    "subtract": lambda a, b: f"({a} - {b})",
    "multiply": lambda a, b: f"({a} * {b})",
    "divide": divide,
    "power": power,
    "logarithm": logarithm,
    "minimum": lambda a, b: f"least({a}, {b})",
    "maximum": lambda a, b: f"greatest({a}, {b})",
    "less_than": lambda a, b: f"(CASE WHEN {a} < {b} THEN 1.0 ELSE 0.0 END)",
    "greater_than": lambda a, b: f"(CASE WHEN {a} > {b} THEN 1.0 ELSE 0.0 END)",
    "modulo": modulo,
    "floored_modulo": floored_modulo,
    "arctan2": lambda a, b: f"atan2({a}, {b})",
    "snap": lambda a, b: f"(floor({divide(a, b)}) * {b})",
    "pingpong": pingpong,
}
TERNARY = {
    "wrap": wrap,
    "compare": lambda a, b, c: f"(CASE WHEN abs({a} - {b}) <= greatest({c}, {EPSILON}) THEN 1.0 ELSE 0.0 END)",
    "multiply_add": lambda a, b, c: f"({a} * {b} + {c})",
    "smooth_min": smooth_min,
    "smooth_max": lambda a, b, c: f"(-{smooth_min(f'(-{a})', f'(-{b})', c)})",
}


def math(op: str, a: str, b: str = "0.0", c: str = "0.0") -> str:
    """Any scalar operator by name."""
    if op in UNARY:
        return UNARY[op].format(a=a)
    return BINARY[op](a, b) if op in BINARY else TERNARY[op](a, b, c)


def map_range(kind: str, x: str, from_low: str, from_high: str, to_low: str, to_high: str, steps: str = "4.0") -> str:
    """x of one range carried to another: linear, stepped, smoothstep or smootherstep; 0 where the first range is empty."""
    t = divide(f"({x} - {from_low})", f"({from_high} - {from_low})")
    if kind == "stepped":
        t = f"(CASE WHEN {steps} > 0 THEN floor({t} * ({steps} + 1.0)) / {steps} ELSE 0.0 END)"
    elif kind == "smoothstep":
        t = f"({clamp(t)} * {clamp(t)} * (3.0 - 2.0 * {clamp(t)}))"
    elif kind == "smootherstep":
        s = clamp(t)
        t = f"({s} * {s} * {s} * ({s} * ({s} * 6.0 - 15.0) + 10.0))"
    return f"(CASE WHEN {from_high} <> {from_low} THEN {to_low} + {t} * ({to_high} - {to_low}) ELSE 0.0 END)"


def clamp_range(x: str, low: str, high: str) -> str:
    """x between two bounds in either order."""
    return f"(CASE WHEN {low} > {high} THEN {clamp(x, high, low)} ELSE {clamp(x, low, high)} END)"
