"""Integer hashes of 32 bits as SQL on 64-bit integers, so that nothing overflows.

A hash is a chain of steps, each of which uses what the steps before it named. `staged` writes a chain as nested
selects: each step is computed once a row, inside code generation, where one expression would double from step to step.
"""

from __future__ import annotations

#: The word size, and the start, counts of rotation and multipliers that the published hashes have.
WORD = 1 << 32
JENKINS_START = 0xDEADBEEF + 13
JENKINS_TURNS = (14, 11, 25, 16, 4, 14, 24)
PCG_FACTOR, PCG_STEP = 1664525, 1013904223
PROSPECTOR = ((16, 0x21F0AAAD), (15, 0xD35A2D97))
PROSPECTOR_MASK = 0xE6FE3BEB
WANG_FACTOR = 0x27D4EB2D
LATTICE_FACTOR = 1103515245

Steps = list[tuple[str, str]]


def cut(x: str) -> str:
    """The lower 32 bits."""
    return f"(({x}) & {WORD - 1})"


def xor(a: str, b: str) -> str:
    """Exclusive or, by operators that engines share."""
    return f"(({a} | {b}) - ({a} & {b}))"


def right(x: str, bits: int) -> str:
    """x without its lowest bits."""
    return f"({x} >> {bits})"


def left(x: str, bits: int) -> str:
    """x moved up; what leaves the word is lost."""
    return f"(({x} & {(1 << 32 - bits) - 1}) << {bits})"


def times(x: str, factor: int) -> str:
    """x * factor modulo 2^32, by halves of 16 bits."""
    return cut(f"({x} & 65535) * {factor} + (({right(x, 16)} * {factor}) & 65535) * 65536")


def staged(source: str, keep: str, steps: Steps) -> str:
    """A select of `keep` and of each step's value over source."""
    sql = f"SELECT {keep} FROM {source}"
    for name, value in steps:
        sql = f"SELECT *, {value} AS {name} FROM ({sql}) AS s"
    return sql


def jenkins(name: str, *keys: str) -> Steps:
    """Steps of the final mix of one to three 32-bit integers; the last step's name is `name`."""
    at = [(cut(f"{(JENKINS_START + 4 * len(keys)) % WORD} + {k}")) for k in keys] + [str((JENKINS_START + 4 * len(keys)) % WORD)] * (3 - len(keys))
    steps = [(f"{name}_{v}", f"CAST({x} AS BIGINT)") for v, x in zip("abc", at, strict=True)]
    value = {v: f"{name}_{v}" for v in "abc"}
    # the register that changes and the one it is mixed with, round after round
    for i, turn in enumerate(JENKINS_TURNS):
        to, by = "cab"[i % 3], "bca"[i % 3]
        rotated = f"({left(value[by], turn)} + {right(value[by], 32 - turn)})"
        mixed = cut(f"{xor(value[to], value[by])} - {rotated} + {WORD}")
        value[to] = name if i == len(JENKINS_TURNS) - 1 else f"{name}_{i}"
        steps.append((value[to], mixed))
    return steps


def pcg2d(name: str, x: str, y: str) -> Steps:
    """Steps of the two-dimensional multiply-add hash; the results are name_x and name_y, of 31 bits."""
    n = name
    add = lambda a, b: cut(f"{a} + {times(b, PCG_FACTOR)}")
    # the shift keeps the sign, as on signed words
    fold = lambda a: xor(a, f"({right(a, 16)} + (CASE WHEN {a} >= {WORD >> 1} THEN 4294901760 ELSE 0 END))")
    return [
        (f"{n}_0", cut(f"{times(x, PCG_FACTOR)} + {PCG_STEP}")),
        (f"{n}_1", cut(f"{times(y, PCG_FACTOR)} + {PCG_STEP}")),
        (f"{n}_2", add(f"{n}_0", f"{n}_1")),
        (f"{n}_3", add(f"{n}_1", f"{n}_2")),
        (f"{n}_4", fold(f"{n}_2")),
        (f"{n}_5", fold(f"{n}_3")),
        (f"{n}_6", add(f"{n}_4", f"{n}_5")),
        (f"{n}_7", add(f"{n}_5", f"{n}_6")),
        (f"{n}_x", f"({n}_6 & {(WORD >> 1) - 1})"),
        (f"{n}_y", f"({n}_7 & {(WORD >> 1) - 1})"),
    ]


def _times_word(x: str, y: str) -> str:
    # both are words: by halves of 16 bits of the first
    return cut(f"({x} & 65535) * {y} + (({right(x, 16)} * {y}) & 65535) * 65536")


def _pcg(name: str, keys: tuple[str, ...], rounds: tuple[tuple[int, int, int], ...]) -> Steps:
    """The multiply-add hash of several words: each round adds to one word the product of two, before and after a fold by the upper half."""
    steps = [(f"{name}_s{i}", cut(f"{times(f'CAST({k} AS BIGINT)', PCG_FACTOR)} + {PCG_STEP}")) for i, k in enumerate(keys)]
    at = [f"{name}_s{i}" for i in range(len(keys))]
    fold = lambda a: xor(a, f"({right(a, 16)} + (CASE WHEN {a} >= {WORD >> 1} THEN 4294901760 ELSE 0 END))")
    for turn in (0, 1):
        for n, (to, a, b) in enumerate(rounds):
            steps.append((f"{name}_{turn}r{n}", cut(f"{at[to]} + {_times_word(at[a], at[b])}")))
            at[to] = f"{name}_{turn}r{n}"
        if not turn:
            steps += [(f"{name}_f{i}", fold(x)) for i, x in enumerate(at)]
            at = [f"{name}_f{i}" for i in range(len(keys))]
    return [*steps, *[(f"{name}_{k}", f"({x} & {(WORD >> 1) - 1})") for k, x in zip("xyzw", at, strict=False)]]


def pcg3d(name: str, x: str, y: str, z: str) -> Steps:
    """Steps of the three-dimensional multiply-add hash; results of 31 bits."""
    return _pcg(name, (x, y, z), ((0, 1, 2), (1, 2, 0), (2, 0, 1)))


def pcg4d(name: str, x: str, y: str, z: str, w: str) -> Steps:
    """Steps of the four-dimensional multiply-add hash; results of 31 bits."""
    return _pcg(name, (x, y, z, w), ((0, 1, 3), (1, 2, 0), (2, 0, 1), (3, 1, 2)))


def prospector(name: str, x: str) -> Steps:
    """Steps of the xorshift-multiply hash."""
    steps, at = [(f"{name}_0", cut(x))], f"{name}_0"
    for i, (bits, factor) in enumerate(PROSPECTOR):
        steps.append((f"{name}_x{i}", xor(at, right(at, bits))))
        steps.append((f"{name}_m{i}", times(f"{name}_x{i}", factor)))
        at = f"{name}_m{i}"
    steps.append((f"{name}_f", xor(at, right(at, 15))))
    return [*steps, (name, xor(f"{name}_f", str(PROSPECTOR_MASK)))]


def wang(name: str, x: str, seed: int) -> Steps:
    """Steps of the seeded add-shift hash."""
    n = name
    return [
        (f"{n}_0", cut(x)),
        (f"{n}_1", xor(f"{n}_0", str(61))),
        (f"{n}_2", xor(f"{n}_1", str(seed))),
        (f"{n}_3", cut(f"{n}_2 * 9")),
        (f"{n}_4", xor(f"{n}_3", right(f"{n}_3", 4))),
        (n, times(f"{n}_4", WANG_FACTOR)),
    ]


def lattice(name: str, x: str, y: str) -> Steps:
    """Steps of the hash of two coordinates by one multiplier."""
    n = name
    return [
        (f"{n}_0", cut(x)),
        (f"{n}_1", cut(y)),
        (f"{n}_2", times(xor(right(f"{n}_0", 1), f"{n}_1"), LATTICE_FACTOR)),
        (f"{n}_3", times(xor(right(f"{n}_1", 1), f"{n}_0"), LATTICE_FACTOR)),
        (f"{n}_4", xor(f"{n}_2", right(f"{n}_3", 3))),
        (n, times(f"{n}_4", LATTICE_FACTOR)),
    ]


def string_hash(x: str) -> str:
    """The multiply-add hash of a text's UTF-8 bytes, as one Spark expression."""
    byte = f"CAST(conv(substr(hex(encode({x}, 'utf-8')), 2 * i - 1, 2), 16, 10) AS BIGINT)"
    return f"CASE WHEN octet_length({x}) = 0 THEN CAST(0 AS BIGINT) ELSE aggregate(sequence(1, octet_length({x})), CAST(0 AS BIGINT), (a, i) -> (a * 37 + {byte}) & {WORD - 1}) END"
