"""Low-discrepancy sequences with hashed Owen scrambling, as columns of 64-bit integers that hold 32 bits.

Direction numbers come from their recurrence, so the sequence has no table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = (1 << 32) - 1
#: Fixed values. Degree, coefficients and first odd numbers of the polynomials of dimensions 1 to 3.
POLYNOMIALS = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)))
#: Fixed values. Multipliers of the base-2 scramble, and its divisor from 32 bits to a number below 1.
OWEN = (0x3D20ADEA, 0x05526C56, 0x53A22864)
BELOW_ONE = 4294967808.0
#: Fixed values. By number of dimensions: what the seed is mixed with for the order of samples, and for each dimension.
ORDER_SEEDS = {1: 0xBFF95BFE, 2: 0xF8ADE99A, 3: 0xCAA726AC, 4: 0xC2C1A055}
VALUE_SEEDS = {1: (0x635C77BD,), 2: (0xE0AAAF76, 0x94964D4E), 3: (0x9E78E391, 0x67C33241, 0x78C395C5), 4: (0x39468210, 0xE9D8A845, 0x5F32B482, 0x1524CC56)}
#: Fixed values. The published integer hash: shifts and multipliers, and what its result is mixed with.
HASH, HASH_MASK = ((16, 0x21F0AAAD), (15, 0xD35A2D97)), 0xE6FE3BEB


def directions(dimension: int) -> list[int]:
    """The 32 direction numbers of a dimension, lowest bit first."""
    if dimension == 0:
        return [1 << i for i in range(32)]
    degree, coefficients, first = POLYNOMIALS[dimension - 1]
    v = [m << (31 - i) for i, m in enumerate(first)]
    for i in range(degree, 32):
        x = v[i - degree] ^ v[i - degree] >> degree
        for k in range(1, degree):
            if coefficients >> (degree - 1 - k) & 1:
                x ^= v[i - k]
        v.append(x)
    return [int(f"{x:032b}"[::-1], 2) for x in v]


def word(x: Column) -> Column:
    """The lower 32 bits."""
    return x.bitwiseAND(F.lit(WORD))


def times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32, by halves of x, so that nothing overflows."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return word(low * factor + F.shiftleft((high * factor).bitwiseAND(F.lit(0xFFFF)), 16))


def reversed_bits(x: Column) -> Column:
    """The 32 bits in opposite order, by swapping ever larger halves."""
    for bits, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        x = F.shiftright(x, bits).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), bits))
    return x


def _let(x: Column, *steps: Callable[[Column], Column]) -> Column:
    """x after some steps, each of which is computed once: a column stands for its whole expression wherever it is used."""
    for f in steps:
        x = F.get(F.transform(F.array(x), f), F.lit(0))
    return x


def _folded(shift: int) -> Callable[[Column], Column]:
    return lambda x: x.bitwiseXOR(F.shiftright(x, shift))


def _multiplied(factor: int) -> Callable[[Column], Column]:
    return lambda x: x.bitwiseXOR(times(x, factor))


def prospect(x: Column) -> Column:
    """The integer hash of x."""
    (first, one), (second, two) = HASH
    return _let(x, _folded(first), lambda y: times(y, one), _folded(second), lambda y: times(y, two), _folded(second)).bitwiseXOR(F.lit(HASH_MASK))


def scrambled(x: Column, seed: Column) -> Column:
    """A nested scramble of a number whose bits are reversed: a bit is flipped by what lies below it."""
    one, two, three = OWEN
    return _let(x, _multiplied(one), lambda y: word(word(y + seed) * F.shiftright(seed, 16).bitwiseOR(F.lit(1))), _multiplied(two), _multiplied(three))


def index_mask(samples: int) -> int:
    """The bits of a reversed index that a run of so many samples uses."""
    top = 1
    while top <= samples - 1:
        top *= 2
    return int(f"{top - 1:032b}"[::-1], 2)


def coordinate(index: Column, dimension: int, seed: Column) -> Column:
    """A number in [0, 1): the direction numbers at the bits of a reversed index, summed modulo 2 and scrambled."""
    bits = directions(dimension)
    picked = lambda n: reduce(Column.bitwiseXOR, [F.shiftright(n, 31 - i).bitwiseAND(F.lit(1)) * bits[i] for i in range(32)])
    return _let(scrambled(_let(index, picked), seed), reversed_bits) / F.lit(BELOW_ONE)


def samples(index: Column, dimensions: int, number: Column, seed: Column, count: int) -> Column:
    """An array of 1 to 4 coordinates: sample `index` of a run of `count`, of the set of dimensions `number`, under a seed.

    The index is shuffled by the scramble within the run, so sets are independent while every run of a power of two
    stays stratified in each of its dimensions.
    """
    own = seed.bitwiseXOR(prospect(number))
    held = _let(F.struct(own.alias("own"), reversed_bits(index).alias("at")), _ordered(ORDER_SEEDS[dimensions], index_mask(count)))
    return F.get(F.transform(F.array(held), lambda s: F.array(*[coordinate(s["at"], d, s["own"].bitwiseXOR(F.lit(k))) for d, k in enumerate(VALUE_SEEDS[dimensions])])), F.lit(0))


def _ordered(key: int, mask: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["own"].alias("own"), scrambled(s["at"], s["own"].bitwiseXOR(F.lit(key))).bitwiseAND(F.lit(mask)).alias("at"))
