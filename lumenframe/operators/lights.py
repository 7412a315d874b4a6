"""Choosing among many lights by a tree of bounds: built level by level, descended by all shading points at once.

Lights are rows of (light, x, y, z, radius, energy, ax, ay, az, theta_o, theta_e): a ball, the axis of the cone in which its
normals lie, that cone's half angle, and the angle about a normal into which it shines. Points are rows of (point, px, py, pz,
nx, ny, nz) with normals of length 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.lineage import cut, numbered, once

#: Children of a node, as bits of their number.
BITS = 3
#: Nodes of a level up to which it is broadcast.
FEW = 10_000
#: Fixed values. A cone that holds another one up to this angle is not widened; cosine below which two axes count as opposite.
HOLDS, OPPOSITE = 5e-4, -0.9995

_BOUNDS = "energy double, lx double, ly double, lz double, hx double, hy double, hz double, ax double, ay double, az double, o double, e double"


def _let(value: str, name: str, body: str) -> str:
    """body with a name for a value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in fields.items()) + ")"


def merged(a: str, b: str) -> str:
    """SQL of the bounds that hold those of a and b: energies add up, boxes and cones grow.

    The wider cone stays if it holds the other; else the axis turns towards the other's by half of what is missing.
    """
    box = {f"{s}{k}": f"{f}(w.{s}{k}, n.{s}{k})" for s, f in (("l", "least"), ("h", "greatest")) for k in "xyz"}
    keep = lambda theta: _struct(energy="w.energy + n.energy", **box, ax="w.ax", ay="w.ay", az="w.az", o=theta, e="greatest(w.e, n.e)")
    side = {k: f"n.a{k} - w.a{k} * d.c" for k in "xyz"}
    # across an opposite axis any direction will do: the axis that the wide one leans on least, made square to it
    least = "CASE WHEN abs(w.ax) <= abs(w.ay) AND abs(w.ax) <= abs(w.az) THEN {} WHEN abs(w.ay) <= abs(w.az) THEN {} ELSE {} END"
    lean = least.format("w.ax", "w.ay", "w.az")
    square = {k: f"({least.format(*['1.0D' if j == k else '0.0D' for j in 'xyz'])} - ({lean}) * w.a{k})" for k in "xyz"}
    length = lambda v: "sqrt(" + " + ".join(f"({v[k]}) * ({v[k]})" for k in "xyz") + ")"
    turn = lambda v, on, by: {f"a{k}": f"w.a{k} * {on} + CASE WHEN {length(v)} > 0 THEN ({v[k]}) / {length(v)} ELSE 0.0D END * {by}" for k in "xyz"}
    bent = _struct(energy="w.energy + n.energy", **box, **turn(side, "cos(d.o - w.o)", "sin(d.o - w.o)"), o="d.o", e="greatest(w.e, n.e)")
    across = _struct(energy="w.energy + n.energy", **box, **turn(square, "0.0D", "1.0D"), o="d.o", e="greatest(w.e, n.e)")
    cosine = "least(1.0D, greatest(-1.0D, w.ax * n.ax + w.ay * n.ay + w.az * n.az))"
    angles = _struct(c=cosine, d=f"acos({cosine})", o=f"(acos({cosine}) + w.o + n.o) * 0.5D")
    chosen = f"CASE WHEN w.o + {HOLDS}D >= least(pi(), d.d + n.o) THEN {keep('w.o')} WHEN d.o >= pi() THEN {keep('pi()')} WHEN d.c < {OPPOSITE}D THEN {across} ELSE {bent} END"
    return _let(f"CASE WHEN {b}.o > {a}.o THEN {b} ELSE {a} END", "w", _let(f"CASE WHEN {b}.o > {a}.o THEN {a} ELSE {b} END", "n", _let(angles, "d", chosen)))


def importances(children: str) -> str:
    """SQL of an array of (most, least): what each child may give at most and at least to the point px .. nz.

    Energy by squared distance, by the cosines of the smallest and largest angles at which the child's ball may stand to
    the normal, and to its own cone. A child behind the surface, or that shines away from it, has none.
    """
    mid = {k: f"(c.l{k} + c.h{k}) / 2" for k in "xyz"}
    one = _struct(energy="c.energy", o="c.o", e="c.e", vx=f"{mid['x']} - px", vy=f"{mid['y']} - py", vz=f"{mid['z']} - pz", ax="c.ax", ay="c.ay", az="c.az", rr="(" + " + ".join(f"(c.h{k} - c.l{k}) * (c.h{k} - c.l{k})" for k in "xyz") + ") / 4", face=" + ".join(f"abs(n{k}) * (c.h{k} - c.l{k}) / 2" for k in "xyz"))
    two = _struct(energy="c.energy", o="c.o", e="c.e", rr="c.rr", dd="c.vx * c.vx + c.vy * c.vy + c.vz * c.vz", n="nx * c.vx + ny * c.vy + nz * c.vz", a="-(c.ax * c.vx + c.ay * c.vy + c.az * c.vz)", face="c.face")
    inside = "c.dd <= c.rr"
    three = _struct(energy="c.energy", o="c.o", e="c.e", face="c.n + c.face", far="greatest(c.dd, c.rr / 4)", cu=f"CASE WHEN {inside} THEN -1.0D ELSE sqrt(greatest(1 - c.rr / c.dd, 0)) END", ci="CASE WHEN c.dd > 0 THEN least(1.0D, greatest(-1.0D, c.n / sqrt(c.dd))) ELSE 1.0D END", ct="CASE WHEN c.dd > 0 THEN least(1.0D, greatest(-1.0D, c.a / sqrt(c.dd))) ELSE 1.0D END")
    sine = lambda x: f"sqrt(greatest(1 - {x} * {x}, 0))"
    four = _struct(energy="c.energy", o="c.o", e="c.e", face="c.face", far="c.far", cu="c.cu", ct="c.ct", near_in=f"CASE WHEN c.ci >= c.cu THEN 1.0D ELSE c.ci * c.cu + {sine('c.ci')} * {sine('c.cu')} END", far_in=f"greatest(c.ci * c.cu - {sine('c.ci')} * {sine('c.cu')}, 0)", near=f"c.ct * c.cu + {sine('c.ct')} * {sine('c.cu')}", away=f"c.ct * c.cu - {sine('c.ct')} * {sine('c.cu')}")
    out = f"CASE WHEN c.ct >= c.cu OR c.near >= cos(c.o) THEN 1.0D WHEN c.o + c.e > pi() OR c.near > cos(c.o + c.e) THEN c.near * cos(c.o) + {sine('c.near')} * sin(c.o) END"
    most = f"CASE WHEN c.face > 0 AND c.near_in >= 0 THEN coalesce(abs(c.near_in * c.energy * ({out}) / c.far), 0.0D) ELSE 0.0D END"
    least = f"CASE WHEN c.e < c.o OR c.ct < 0 OR c.cu < 0 OR c.away < cos(c.e - c.o) THEN 0.0D ELSE abs(c.far_in * c.energy * (c.away * cos(c.o) - {sine('c.away')} * sin(c.o)) / c.far) END"
    five = _struct(most=most, least=least)
    six = _struct(most="c.most", least="CASE WHEN c.most > 0 THEN c.least ELSE 0.0D END")
    sql = children
    for step in (one, two, three, four, five, six):
        sql = f"transform({sql}, c -> {step})"
    return sql


def chances(children: str) -> str:
    """SQL of the probabilities of the children: the mean of their shares in both bounds; all 0 if none gives anything."""
    most, least = "aggregate(i, 0.0D, (s, x) -> s + x.most)", "aggregate(i, 0.0D, (s, x) -> s + x.least)"
    some = "size(filter(i, x -> x.most > 0))"
    return _let(importances(children), "i", _let(_struct(most=most, least=least, some=some), "t", "transform(i, x -> CASE WHEN t.most > 0 THEN (x.most / t.most + CASE WHEN t.least > 0 THEN x.least / t.least WHEN x.most > 0 THEN 1 / t.some ELSE 0.0D END) / 2 ELSE 0.0D END)"))


def build(lights: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the tree, from the leaves up, and (light, rank). A level is rows of (node, energy .. e, children); the last has the root, node 0.

    Lights are numbered along a curve through their cells, so that neighbours are near; each 8 make a leaf, each 8 leaves
    a node, and so on: a level is one aggregation of what is below it, with groups of 8 rows. Lights without energy or
    with null columns are in no tree; without any light there is no level.
    """
    known = lights.where("energy > 0 AND x + y + z + radius + ax + ay + az + theta_o + theta_e IS NOT NULL")
    box = known.agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    if box[0] is None:
        return [], known.select("light", F.lit(0).cast("long").alias("rank"))
    code = F.lit(0).cast("long")
    for i, c in enumerate("xyz"):
        low, high = box[2 * i], box[2 * i + 1]
        cell = F.least(F.floor((F.col(c) - low) / max(high - low, 1e-300) * 1024), F.lit(1023))
        for bit in range(10):
            code = code + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1)), 3 * bit + i)
    ordered, count = numbered(known.withColumn("code", code), ["code", "light"], "rank")
    level = ordered.selectExpr("rank AS node", "light", "double(energy) AS energy", *[f"double({c} {s} radius) AS {n}{c}" for n, s in (("l", "-"), ("h", "+")) for c in "xyz"], *[f"double(a{c} / greatest(sqrt(ax * ax + ay * ay + az * az), 1e-300)) AS a{c}" for c in "xyz"], "double(theta_o) AS o", "double(theta_e) AS e")
    names = [x.split()[0] for x in _BOUNDS.split(", ")]
    ranks, levels = level.select("light", F.col("node").alias("rank")), []
    while not levels or count > 1:
        count = -(-count // (1 << BITS))
        child = F.struct(F.col("node").alias("id"), F.col("light"), F.struct(*names).alias("b"))
        groups = level.groupBy(F.shiftright("node", BITS).alias("node")).agg(F.array_sort(F.collect_list(child)).alias("kids"))
        fold = F.expr(f"aggregate(slice(kids, 2, {(1 << BITS) - 1}), kids[0].b, (a, k) -> {_let('k.b', 'b', merged('a', 'b'))})")
        d = cut(groups.withColumn("b", fold).select("node", *[F.col(f"b.{n}").alias(n) for n in names], F.expr("transform(kids, k -> named_struct('id', k.id, 'light', k.light))").alias("ids"), F.expr("transform(kids, k -> k.b)").alias("children")))
        levels.append(d)
        level = d.select("node", F.lit(None).cast(ranks.schema["light"].dataType).alias("light"), *names)
    return levels, ranks


def _with(points: DataFrame, level: DataFrame) -> DataFrame:
    """points with the children of their node. A level of a few nodes is broadcast; a larger one is joined by node, one row each."""
    kids = level.select("node", "ids", "children")
    return once(points.join(F.broadcast(kids) if level.count() <= FEW else kids, "node"), chances=F.expr(chances("children")))


def pick(points: DataFrame, levels: list[DataFrame], rand: str) -> DataFrame:
    """points with light and pdf: one light each, by a number in [0, 1), and the probability that it was chosen.

    All points go down the tree together, a join a level: their number picks a child by the children's chances and is
    stretched to [0, 1) again. Points that no light reaches have no row. Points are dealt to all tasks first: a row is small
    beside its work, and a file of many points would be one task.
    """
    d = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("node", F.lit(0).cast("long")).withColumn("pdf", F.lit(1.0)).withColumn("__left", F.col(rand).cast("double"))
    if not levels:
        return d.where("false").withColumn("light", F.lit(None).cast("long")).drop("node", "__left")
    start = _struct(upto="0", before="0", at="-1", chance="0")
    step = "CASE WHEN s.at >= 0 OR x.p <= 0 THEN s ELSE " + _struct(upto="s.upto + x.p", before="s.upto", at="CASE WHEN __left < s.upto + x.p OR x.last THEN x.i ELSE -1 END", chance="x.p") + " END"
    last = "array_max(transform(chances, (p, i) -> CASE WHEN p > 0 THEN i END))"
    tagged = _let(last, "n", "transform(chances, (p, i) -> named_struct('p', p, 'i', i, 'last', i = n))")
    for level in reversed(levels):
        d = once(_with(d, level), found=F.expr(f"aggregate({tagged}, {start}, (s, x) -> {step})")).where("found.at >= 0")
        d = d.withColumn("__left", F.expr("least(greatest((__left - found.before) / found.chance, 0), 0.9999999999999999D)")).withColumn("pdf", F.col("pdf") * F.col("found.chance"))
        d = d.withColumn("kid", F.get("ids", F.col("found.at").cast("int"))).withColumn("node", F.col("kid.id")).withColumn("light", F.col("kid.light")).drop("found", "kid", "ids", "children", "chances")
    return d.drop("node", "__left")


def pdf(pairs: DataFrame, levels: list[DataFrame], ranks: DataFrame) -> DataFrame:
    """pairs of a point and a light with pdf, the probability that `pick` chooses it: the product of its path's chances. Lights outside the tree have 0."""
    d = pairs.join(ranks, "light", "left").withColumn("pdf", F.when(F.col("rank").isNull(), 0.0).otherwise(1.0))
    for n, level in reversed(list(enumerate(levels))):
        d = d.withColumn("node", F.coalesce(F.shiftright("rank", BITS * (n + 1)), F.lit(0))).withColumn("kid", F.shiftright("rank", BITS * n))
        place = F.expr("get(transform(filter(transform(ids, (k, i) -> named_struct('id', k.id, 'i', i)), x -> x.id = kid), x -> x.i), 0)")
        d = _with(d, level).withColumn("pdf", F.col("pdf") * F.coalesce(F.get("chances", place), F.lit(0.0))).drop("node", "kid", "ids", "children", "chances")
    return d.drop("rank")


def measure(o: str = "o", e: str = "e") -> Column:
    """The solid angle into which a cone of normals shines, weighted by the cosine."""
    w = F.least(F.lit(math.pi), F.col(o) + F.col(e))
    cos, sin = F.cos(F.col(o)), F.sin(F.col(o))
    return 2 * math.pi * (1 - cos) + math.pi / 2 * (2 * w * sin - F.cos(F.col(o) - 2 * w) - 2 * F.col(o) * sin + cos)
