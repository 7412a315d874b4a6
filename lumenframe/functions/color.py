"""Colour mixes and conversions as SQL expressions by channel."""

from __future__ import annotations

from lumenframe.functions.scalar import clamp, divide
from lumenframe.functions.vector import Vector, each


def lerp(a: str, b: str, t: str) -> str:
    """From a to b."""
    return f"({a} + ({b} - {a}) * {t})"


def _dodge(a: str, b: str, t: str) -> str:
    d = f"(1.0 - {t} * {b})"
    return f"(CASE WHEN {a} = 0 THEN 0.0 WHEN {d} <= 0 THEN 1.0 ELSE least({a} / {d}, 1.0) END)"


def _burn(a: str, b: str, t: str) -> str:
    d = f"(1.0 - {t} + {t} * {b})"
    return f"(CASE WHEN {d} <= 0 THEN 0.0 ELSE {clamp(f'(1.0 - (1.0 - {a}) / {d})')} END)"


def _overlay(a: str, b: str, t: str) -> str:
    return f"(CASE WHEN {a} < 0.5 THEN {a} * (1.0 - {t} + 2.0 * {t} * {b}) ELSE 1.0 - (1.0 - {t} + 2.0 * {t} * (1.0 - {b})) * (1.0 - {a}) END)"


def _soft(a: str, b: str, t: str) -> str:
    screen = f"(1.0 - (1.0 - {b}) * (1.0 - {a}))"
    return f"((1.0 - {t}) * {a} + {t} * ((1.0 - {a}) * {b} * {a} + {a} * {screen}))"


CHANNEL = {
    "blend": lambda a, b, t: lerp(a, b, t),
    "add": lambda a, b, t: lerp(a, f"({a} + {b})", t),
    "mul": lambda a, b, t: lerp(a, f"({a} * {b})", t),
    "sub": lambda a, b, t: lerp(a, f"({a} - {b})", t),
    "screen": lambda a, b, t: f"(1.0 - (1.0 - {t} + {t} * (1.0 - {b})) * (1.0 - {a}))",
    "div": lambda a, b, t: f"(CASE WHEN {b} <> 0 THEN (1.0 - {t}) * {a} + {t} * {a} / {b} ELSE {a} END)",
    "diff": lambda a, b, t: lerp(a, f"abs({a} - {b})", t),
    "dark": lambda a, b, t: lerp(a, f"least({a}, {b})", t),
    "light": lambda a, b, t: lerp(a, f"greatest({a}, {b})", t),
    "overlay": _overlay,
    "dodge": _dodge,
    "burn": _burn,
    "soft": _soft,
    "linear": lambda a, b, t: f"({a} + {t} * (2.0 * {b} - 1.0))",
    "exclusion": lambda a, b, t: f"greatest({lerp(a, f'({a} + {b} - 2.0 * {a} * {b})', t)}, 0.0)",
    "clamp": lambda a, b, t: clamp(a),
}


def mix(op: str, a: Vector, b: Vector, t: str) -> Vector:
    """A mix by channel; the factor is held between 0 and 1."""
    return each(lambda x, y: CHANNEL[op](x, y, clamp(t)), a, b)


def rgb_to_hsv(c: Vector) -> Vector:
    """Hue, saturation and value; a grey has hue and saturation 0."""
    r, g, b = c
    high, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    d = f"({high} - {low})"
    h = f"(CASE WHEN {d} = 0 THEN 0.0 WHEN {r} = {high} THEN ({g} - {b}) / {d} WHEN {g} = {high} THEN 2.0 + ({b} - {r}) / {d} ELSE 4.0 + ({r} - {g}) / {d} END) / 6.0"
    return f"(CASE WHEN {h} < 0 THEN {h} + 1.0 ELSE {h} END)", divide(d, high), high


def hsv_to_rgb(c: Vector) -> Vector:
    """The colour of hue, saturation and value."""
    h, s, v = c
    part = lambda k: f"({v} - {v} * {s} * greatest(0.0, least(1.0, least(({h} * 6.0 + {k}) - 6.0 * floor(({h} * 6.0 + {k}) / 6.0), 4.0 - (({h} * 6.0 + {k}) - 6.0 * floor(({h} * 6.0 + {k}) / 6.0))))))"
    return part("5.0"), part("3.0"), part("1.0")


def rgb_to_hsl(c: Vector) -> Vector:
    """Hue, saturation and lightness; a grey has hue and saturation 0."""
    high, low = f"greatest({c[0]}, {c[1]}, {c[2]})", f"least({c[0]}, {c[1]}, {c[2]})"
    light = f"least(1.0, ({high} + {low}) / 2.0)"
    room = f"(CASE WHEN {light} > 0.5 THEN 2.0 - {high} - {low} ELSE {high} + {low} END)"
    return rgb_to_hsv(c)[0], divide(f"({high} - {low})", room), light


def hsl_to_rgb(c: Vector) -> Vector:
    """The colour of hue, saturation and lightness."""
    h, s, light = c
    chroma = f"((1.0 - abs(2.0 * {light} - 1.0)) * {s})"
    shares = (f"abs({h} * 6.0 - 3.0) - 1.0", f"2.0 - abs({h} * 6.0 - 2.0)", f"2.0 - abs({h} * 6.0 - 4.0)")
    r, g, b = (f"(({clamp(x)} - 0.5) * {chroma} + {light})" for x in shares)
    return r, g, b


def xyy_to_xyz(x: str, y: str, luma: str) -> Vector:
    """Chromaticity and luminance as tristimulus values; X and Z are 0 where y is 0."""
    return f"({divide(x, y)} * {luma})", luma, f"({divide(f'(1.0 - {x} - {y})', y)} * {luma})"


def bright_contrast(c: Vector, bright: str, contrast: str) -> Vector:
    """Channels spread about the middle by contrast, moved by brightness and held above 0."""
    r, g, b = (f"greatest((1.0 + {contrast}) * {x} + {bright} - {contrast} * 0.5, 0.0)" for x in c)
    return r, g, b


def gamma(c: Vector, exponent: str) -> Vector:
    """Positive channels to the power of the exponent; all white where it is 0."""
    r, g, b = (f"(CASE WHEN {exponent} = 0 THEN 1.0 WHEN {x} > 0 THEN power({x}, {exponent}) ELSE {x} END)" for x in c)
    return r, g, b


def invert(c: Vector, factor: str) -> Vector:
    """From the colour to its complement."""
    r, g, b = (lerp(x, f"(1.0 - {x})", factor) for x in c)
    return r, g, b


def adjust_hsv(c: Vector, hue: str, saturation: str, value: str, factor: str, hsv: Vector | None = None) -> Vector:
    """Hue turned by hue + 0.5, saturation and value multiplied, and the result blended in, held above 0.

    hsv names the colour's own hue, saturation and value where an earlier select has them.
    """
    h, s, v = hsv or rgb_to_hsv(c)
    turned = f"({h} + {hue} + 0.5)"
    new = hsv_to_rgb((f"({turned} - floor({turned}))", clamp(f"({s} * {saturation})"), f"({v} * {value})"))
    r, g, b = (f"greatest({lerp(x, y, factor)}, 0.0)" for x, y in zip(c, new, strict=True))
    return r, g, b


def mix_hsv(op: str, a: Vector, b: Vector, t: str, hsv_a: Vector | None = None, hsv_b: Vector | None = None) -> Vector:
    """The mixes by hue, saturation, value or colour (hue and saturation). Greys give and take no hue.

    hsv_a and hsv_b name the colours' own hue, saturation and value where an earlier select has them.
    """
    t = clamp(t)
    (ha, sa, va), (hb, sb, vb) = hsv_a or rgb_to_hsv(a), hsv_b or rgb_to_hsv(b)
    if op == "value":
        return hsv_to_rgb((ha, sa, lerp(va, vb, t)))
    if op == "saturation":
        new, tinted = hsv_to_rgb((ha, lerp(sa, sb, t), va)), sa
    else:
        new, tinted = hsv_to_rgb((hb, sa if op == "hue" else sb, va)), sb
        new = each(lambda x, y: lerp(x, y, t), a, new)
    r, g, b_ = (f"(CASE WHEN {tinted} <> 0 THEN {y} ELSE {x} END)" for x, y in zip(a, new, strict=True))
    return r, g, b_


def luminance(c: Vector) -> str:
    """Relative luminance by the weights of linear sRGB primaries."""
    return f"(0.2126729 * {c[0]} + 0.7151522 * {c[1]} + 0.0721750 * {c[2]})"


def srgb_to_linear(x: str) -> str:
    """A display value as linear light."""
    return f"(CASE WHEN {x} < 0.04045 THEN greatest({x}, 0.0) / 12.92 ELSE power(({x} + 0.055) / 1.055, 2.4) END)"


def linear_to_srgb(x: str) -> str:
    """Linear light as a display value."""
    return f"(CASE WHEN {x} < 0.0031308 THEN greatest({x}, 0.0) * 12.92 ELSE 1.055 * power({x}, 0.4166666666666667) - 0.055 END)"
