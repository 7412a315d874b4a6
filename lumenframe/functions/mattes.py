"""Mattes: names as 32-bit ids, ids as numbers, manifests of names, and pixels' strongest ids by share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.sequences import times, word

#: Fixed values. Multipliers and turns of the published hash of byte blocks, its step, and its last mix.
BLOCK, TURNS, STEP = (0xCC9E2D51, 0x1B873593), (15, 13), (5, 0xE6546B64)
MIX = ((16, 0x85EBCA6B), (13, 0xC2B2AE35))


def _let(x: Column, f) -> Column:  # noqa: ANN001
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _turned(x: Column, bits: int) -> Column:
    return word(F.shiftleft(x, bits)).bitwiseOR(F.shiftright(x, 32 - bits))


def _block(x: Column) -> Column:
    first, second = BLOCK
    return _let(_let(x, lambda k: times(k, first)), lambda k: times(_turned(k, TURNS[0]), second))


def _folded(shift: int):  # noqa: ANN202
    return lambda x: x.bitwiseXOR(F.shiftright(x, shift))


def murmur(text: Column, seed: int = 0) -> Column:
    """The 32-bit hash of a text's UTF-8 bytes, as a 64-bit integer; null for null.

    Bytes go in blocks of four, the first lowest; what is left over is a block of its own that is not turned in.
    """

    def run(s: Column) -> Column:
        # hexadecimal digits: two a byte, from which a block's number is read backwards
        digits = s["hex"]
        byte = lambda at: F.conv(F.substr(digits, 2 * at + 1, F.lit(2)), 16, 10).cast("long")
        number = lambda at, n: sum((F.shiftleft(byte(at + k), 8 * k) for k in range(1, n)), byte(at))
        whole = F.filter(F.sequence(F.lit(0), s["n"], F.lit(4)), lambda i: i + 4 <= s["n"])
        step = lambda h, i: _let(h.bitwiseXOR(_block(number(i, 4))), lambda x: word(_turned(x, TURNS[1]) * STEP[0] + STEP[1]))
        body = F.aggregate(whole, F.lit(seed).cast("long"), step)
        at, left = s["n"] - s["n"] % 4, s["n"] % 4
        tail = F.when(left == 1, number(at, 1)).when(left == 2, number(at, 2)).when(left == 3, number(at, 3))
        out = body.bitwiseXOR(F.coalesce(_block(tail), F.lit(0))).bitwiseXOR(s["n"].cast("long"))
        for shift, factor in MIX:
            out = _let(_let(out, _folded(shift)), _multiplied(factor))
        return _let(out, _folded(16))

    held = F.struct(F.hex(F.encode(text, "UTF-8")).alias("hex"), F.octet_length(text).alias("n"))
    return F.when(text.isNotNull(), _let(held, run))


def _multiplied(factor: int):  # noqa: ANN202
    return lambda x: times(x, factor)


def as_number(hashed: Column) -> Column:
    """A 32-bit id as the number whose single-precision bits it is. Exponents that stand for no plain number become the nearest that do."""

    def run(h: Column) -> Column:
        power = F.least(F.greatest(F.shiftright(h, 23).bitwiseAND(F.lit(255)), F.lit(1)), F.lit(254)) - 127
        sign = F.when(F.shiftright(h, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
        return sign * (1 + h.bitwiseAND(F.lit((1 << 23) - 1)) / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), power)

    return _let(hashed, run)


def scientific(x: Column) -> Column:
    """A number with seven digits, ties to the even one, as C prints them; Spark's own format rounds ties up.

    Numbers of 24 bits that lie half way between two texts have eight digits, so longer texts show them.
    """
    tie = r"^(-?\d\.\d{5}[02468])50{8}(e.*)$"
    long = F.format_string("%.15e", x)
    return F.when(long.rlike(tie), F.regexp_replace(long, tie, "$1$2")).otherwise(F.format_string("%.6e", x))


def manifest(names: DataFrame, scene: str, name: str) -> DataFrame:
    """(scene, manifest) with each scene's distinct names and their ids as JSON, in the order of names; nulls leave.

    Names are made distinct before they meet; what meets in one row is the manifest itself.
    """
    known = names.where(F.col(name).isNotNull()).select(scene, name).distinct()
    pair = F.concat(F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(':"'), F.lower(F.lpad(F.hex(murmur(F.col(name))), 8, "0")), F.lit('"'))
    rows = known.select(scene, name, pair.alias("pair"))
    lists = rows.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct(name, "pair"))).alias("all"))
    return lists.select(scene, F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["pair"]), ","), F.lit("}")).alias("manifest"))


def finalise(slots: DataFrame, pixel: str, slot: str, ident: str, weight: str, samples: Column) -> DataFrame:
    """(pixel, layer, id_0, weight_0, id_1, weight_1): two slots a layer from 1 on, weights as shares of the samples.

    Slots that a pixel lacks are 0. Ids stay as they are.
    """
    d = slots.withColumn("layer", F.floor((F.col(slot) - 1) / 2).cast("int")).withColumn("side", (F.col(slot) - 1) % 2)
    pick = lambda side, c: F.coalesce(F.max(F.when(F.col("side") == side, c)), F.lit(0.0))
    share = F.col(weight) / samples
    return d.groupBy(pixel, "layer").agg(*[pick(k, c).alias(f"{n}_{k}") for k in (0, 1) for n, c in (("id", F.col(ident)), ("weight", share))])
