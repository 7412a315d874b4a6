"""Procedural textures without noise, as SQL expressions of a point."""

from __future__ import annotations

from lumenframe.functions.scalar import clamp
from lumenframe.functions.vector import Vector

TURN = "6.283185307179586"
QUARTER = "1.5707963267948966"
#: Moves points off whole numbers, where a cell begins: fixed values.
NUDGE, SHRINK = "0.000001", "0.999999"


def smooth(t: str) -> str:
    """Hermite step of t held between 0 and 1."""
    return f"({clamp(t)} * {clamp(t)} * (3.0 - 2.0 * {clamp(t)}))"


def wave(p: Vector, rings: bool, direction: str, profile: str, phase: str = "0.0") -> str:
    """Bands along x, y, z or the diagonal, or rings about an axis or a point ("all"), as sin, saw or tri."""
    q = tuple(f"(({c} + {NUDGE}) * {SHRINK})" for c in p)
    if rings:
        used = [c for c, k in zip(q, "xyz", strict=True) if k != direction]
        n = f"(sqrt({' + '.join(f'{c} * {c}' for c in used)}) * 20.0 + {phase})"
    elif direction == "all":
        n = f"(({q[0]} + {q[1]} + {q[2]}) * 10.0 + {phase})"
    else:
        n = f"({q['xyz'.index(direction)]} * 20.0 + {phase})"
    turns = f"({n} / {TURN})"
    return {
        "sin": f"(0.5 + 0.5 * sin({n} - {QUARTER}))",
        "saw": f"({turns} - floor({turns}))",
        "tri": f"(abs({turns} - floor({turns} + 0.5)) * 2.0)",
    }[profile]


def brick_mortar(x: str, y: str, width: str = "0.5", height: str = "0.25", mortar: str = "0.02", soft: str = "0.1", shift: str = "0.5", every: int = 2, squash: str = "1.0", squash_every: int = 2) -> str:
    """How much of a point is mortar: 0 inside a brick, 1 at its edge; rows are shifted and squashed every so many rows.

    All numbers are doubles: engines multiply decimals by whole numbers or by doubles, so points at an edge would fall to either side.
    """
    width, height, mortar, soft, shift, squash = (f"CAST({n} AS DOUBLE)" for n in (width, height, mortar, soft, shift, squash))
    down = lambda v: f"CAST(floor({v}) AS DOUBLE)"
    row = down(f"{y} / {height}")
    wide = f"(CASE WHEN {row} % {squash_every} <> 0 THEN {width} ELSE {width} * {squash} END)" if every and squash_every else f"({width})"
    moved = f"({x} + (CASE WHEN {row} % {every} <> 0 THEN CAST(0 AS DOUBLE) ELSE {wide} * {shift} END))" if every and squash_every else f"({x})"
    inside = f"({moved} - {wide} * {down(f'{moved} / {wide}')})"
    up = f"({y} - {height} * {row})"
    edge = f"least({inside}, {up}, {wide} - {inside}, {height} - {up})"
    return f"(CASE WHEN {edge} >= {mortar} THEN 0.0 WHEN {soft} = 0.0 THEN 1.0 ELSE {smooth(f'((1.0 - {edge} / {mortar}) / {soft})')} END)"
