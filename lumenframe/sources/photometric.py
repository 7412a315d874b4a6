"""Photometric files: candela distributions of lamps from their text, made whole by their symmetries, and looked up by direction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.tables import let
from lumenframe.operators.lineage import once

#: Fixed values. From candela to watts of an even source, by a luminous efficacy of 177.83; how near angles count as equal.
TO_WATTS, CLOSE = 0.0706650768394, 1e-4
#: Files of profiles up to which lookups broadcast them.
FEW = 1000


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each file under a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parse(files: DataFrame, key: str = "file", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profiles, rejects): rows of (key, type, v, h, values) as the files have them, and (key, reason) of what is no such file.

    After the line that starts with TILT= come numbers, parted by blanks or commas: with TILT=INCLUDE a table of tilts,
    which is passed over, then thirteen of the header, the vertical and the horizontal angles in degrees, and a value for
    each pair, by horizontal angle. Values are scaled by the header's three factors and TO_WATTS. Counts and the type must be whole
    numbers; what follows the last value is ignored. Null texts are rejected.
    """
    d = once(files.select(F.col(key), F.col(text).alias("raw")), t=F.expr("replace(raw, '\\r', '\\n')"))
    d = once(d.drop("raw"), at=F.expr("instr(t, '\\nTILT=')"))
    d = once(d, rest=F.expr("CASE WHEN at > 0 THEN substring(t, at + 1) END")).drop("t")
    tail = "CASE WHEN rest LIKE 'TILT=INCLUDE%' THEN substring(rest, 13) WHEN instr(rest, '\\n') > 0 THEN substring(rest, instr(rest, '\\n')) END"
    d = once(d, w=F.expr(f"filter(split(replace({tail}, ',', ' '), '[ \\\\t\\\\n\\\\x0B\\\\f]+'), x -> x <> '')"), tilted=F.expr("rest LIKE 'TILT=INCLUDE%'"), ended=F.expr("instr(rest, '\\n') = 0")).drop("rest")
    d = once(d.withColumnRenamed("w", "all"), w=F.expr("CASE WHEN tilted THEN CASE WHEN try_cast(get(all, 1) AS INT) >= 0 THEN slice(all, 3 + 2 * try_cast(get(all, 1) AS INT), size(all)) END ELSE all END")).drop("all", "tilted")
    number = lambda i: F.expr(f"try_cast(CASE WHEN get(w, {i}) RLIKE '^[+-]?[0-9]+$' THEN get(w, {i}) END AS INT)")
    d = once(d, nv=number(3), nh=number(4), type=number(5), counted=number(0).isNotNull() & number(6).isNotNull())
    d = once(d, n=F.expr("transform(slice(w, 1, greatest(13 + nv + nh + nv * nh, 0)), x -> try_cast(x AS DOUBLE))"))
    reason = F.when(F.col("at").isNull() | (F.col("at") == 0), "no line TILT=").when(F.col("ended"), "nothing after the line TILT=").when(F.col("w").isNull() | F.col("nv").isNull() | F.col("nh").isNull() | F.col("type").isNull() | ~F.col("counted"), "a count is no whole number")
    reason = reason.when((F.col("nv") < 1) | (F.col("nh") < 1), "no angles").when(~F.col("type").isin(1, 2, 3), "unknown type").when(F.size("n") < F.expr("13 + nv + nh + nv * nh"), "too few numbers").when(F.expr("exists(n, x -> x IS NULL)"), "a word where a number should be")
    d = once(d, reason=reason)
    rows = "transform(sequence(0, nh - 1), j -> transform(slice(n, 14 + nv + nh + j * nv, nv), x -> x * n[2] * n[10] * n[11] * " + f"{TO_WATTS}D))"
    good = d.where("reason IS NULL").selectExpr(key, "type", "slice(n, 14, nv) AS v", "slice(n, 14 + nv, nh) AS h", f"{rows} AS values")
    return good, d.where("reason IS NOT NULL").select(key, "reason")


def _close(a: str, b: str) -> str:
    return f"abs(({a}) - ({b})) < {CLOSE}D"


def whole(profiles: DataFrame, key: str = "file") -> DataFrame:
    """profiles as (key, v, h, values) in radians over as much of the sphere as their symmetry gives: type 1 by vertical and
    horizontal angles about the vertical axis, types 2 and 3 turned to that form."""
    last = "{0}[size({0}) - 1].a"
    entries = lambda h, v: f"transform({h}, (a, j) -> named_struct('a', a, 'r', {v}[j]))"
    shifted = lambda e, to: f"transform({e}, x -> named_struct('a', {to}, 'r', x.r))"
    back = lambda e, to, skip: f"transform(reverse(slice({e}, {'2' if skip == 'first' else '1'}, greatest(size({e}) - 1, 0))), x -> named_struct('a', {to}, 'r', x.r))"
    # type 1: stored from 90 on, one angle for all, a quadrant, a half, or without the last angle
    c = let(entries("h", "values"), "e0", let(f"CASE WHEN {_close('e0[0].a', '90')} THEN {shifted('e0', 'x.a - 90')} ELSE e0 END", "e1", let("CASE WHEN size(e1) = 1 THEN array(named_struct('a', 0.0D, 'r', e1[0].r), named_struct('a', 360.0D, 'r', e1[0].r)) ELSE e1 END", "e2", let(f"CASE WHEN {_close(last.format('e2'), '90')} THEN concat(e2, {back('e2', '180 - x.a', 'last')}) ELSE e2 END", "e3", let(f"CASE WHEN {_close(last.format('e3'), '180')} THEN concat(e3, {back('e3', '360 - x.a', 'last')}) ELSE e3 END", "e4", f"CASE WHEN {_close('e4[0].a', '0')} AND NOT {_close(last.format('e4'), '360')} AND ({_close('e4[size(e4) - 1].a - e4[size(e4) - 2].a', '360 - ' + last.format('e4'))} OR {_close('e4[1].a - e4[0].a', '360 - ' + last.format('e4'))}) THEN concat(e4, array(named_struct('a', 360.0D, 'r', e4[0].r))) ELSE e4 END")))))
    # type 3: from -90 to 90, or mirrored about 0
    a = let(entries("h", "values"), "e0", f"concat({shifted('reverse(e0)', '180 - x.a')}, CASE WHEN {_close('e0[0].a', '0')} THEN {shifted('slice(e0, 2, size(e0))', '180 + x.a')} ELSE slice(e0, 1, 0) END)")
    # type 2: the polar axis lies flat, so both angles change places; each is mirrored about 0 or moved
    turned = "transform(v, (a, i) -> named_struct('a', a, 'r', transform(values, row -> row[i])))"
    b = let(turned, "e0", f"CASE WHEN {_close('e0[0].a', '0')} THEN concat({back('e0', '90 - x.a', 'first')}, {shifted('e0', '90 + x.a')}) ELSE {shifted('e0', 'x.a + 90')} END")
    flip = lambda x: f"concat(reverse(slice({x}, 2, size({x}))), {x})"
    mirrored = _close("h[0]", "0")
    b = f"transform({b}, x -> named_struct('a', x.a, 'r', CASE WHEN {mirrored} THEN {flip('x.r')} ELSE x.r END))"
    vb = f"CASE WHEN {mirrored} THEN concat(transform(reverse(slice(h, 2, size(h))), x -> 90 - x), transform(h, x -> 90 + x)) ELSE transform(h, x -> x + 90) END"
    d = once(profiles, e=F.expr(f"CASE type WHEN 1 THEN {c} WHEN 2 THEN {b} ELSE {a} END"), up=F.expr(f"CASE type WHEN 1 THEN v WHEN 2 THEN {vb} ELSE transform(v, x -> x + 90) END"))
    turn = math.pi / 180
    return d.selectExpr(key, f"transform(up, x -> x * {turn!r}D) AS v", f"transform(e, x -> x.a * {turn!r}D) AS h", "transform(e, x -> x.r) AS values")


def _cubic(a: str, b: str, c: str, d: str, x: str) -> str:
    """A smooth curve through b and c that leaves and arrives with the slopes of their neighbours."""
    return f"(0.5D * ((({d} + 3 * ({b} - {c}) - {a}) * {x} + (2 * {a} - 5 * {b} + 4 * {c} - {d})) * {x} + ({c} - {a})) * {x} + {b})"


def strength(h: str, v: str) -> str:
    """SQL of the strength into a direction by a profile's columns h, v and values: 0 outside its angles.

    Cubic along both angles. Beyond the poles the values repeat mirrored; around a whole turn they repeat; beyond
    other ends they stay.
    """
    value = lambda j, i: f"get(get(s.values, {j}), {i})"

    def column(j: str) -> str:
        low = f"CASE WHEN s.i > 0 THEN {value(j, 's.i - 1')} WHEN s.v[0] < 1e-7D THEN {value(j, '1')} ELSE {value(j, 's.i')} END"
        high = f"CASE WHEN s.i + 2 < size(s.v) THEN {value(j, 's.i + 2')} WHEN s.v[size(s.v) - 1] > pi() - 1e-7D THEN {value(j, 'size(s.v) - 2')} ELSE {value(j, 's.i + 1')} END"
        return let(f"named_struct('a', {low}, 'b', {value(j, 's.i')}, 'c', {value(j, 's.i + 1')}, 'd', {high})", "q", _cubic("q.a", "q.b", "q.c", "q.d", "s.y"))

    around = "(s.h[0] < 1e-7D AND s.h[size(s.h) - 1] > 2 * pi() - 1e-7D)"
    low = f"CASE WHEN s.j > 0 THEN {column('s.j - 1')} WHEN {around} THEN {column('size(s.h) - 2')} ELSE {column('s.j')} END"
    high = f"CASE WHEN s.j + 2 < size(s.h) THEN {column('s.j + 2')} WHEN {around} THEN {column('1')} ELSE {column('s.j')} END"
    inner = let(f"named_struct('a', {low}, 'b', {column('s.j')}, 'c', {column('s.j + 1')}, 'd', {high})", "r", f"greatest({_cubic('r.a', 'r.b', 'r.c', 'r.d', 's.x')}, 0.0D)")
    part = lambda angles, x, i: f"({x} - {angles}[{i}]) / ({angles}[{i} + 1] - {angles}[{i}])"
    placed = let(f"named_struct('h', h, 'v', v, 'values', values, 'j', size(filter(slice(h, 2, size(h)), x -> x < {h})), 'i', size(filter(slice(v, 2, size(v)), x -> x < {v})))", "p", f"named_struct('h', p.h, 'v', p.v, 'values', p.values, 'j', p.j, 'i', p.i, 'x', {part('p.h', h, 'p.j')}, 'y', {part('p.v', v, 'p.i')})")
    return f"CASE WHEN {v} < v[0] OR {v} >= v[size(v) - 1] OR {h} < h[0] OR {h} >= h[size(h) - 1] THEN 0.0D ELSE {let(placed, 's', inner)} END"


def look_up(directions: DataFrame, profiles: DataFrame, at_h: str, at_v: str, key: str = "file") -> DataFrame:
    """directions (key and two angles in radians) with strength; a file without a profile gives 100.

    One row of arrays a file is joined: broadcast up to FEW files, else dealt by file.
    """
    rows = F.broadcast(profiles) if profiles.count() <= FEW else profiles
    d = directions.join(rows, key, "left").withColumn("strength", F.expr(f"CASE WHEN values IS NULL THEN 100.0D ELSE {strength(at_h, at_v)} END"))
    return d.drop("h", "v", "values")
