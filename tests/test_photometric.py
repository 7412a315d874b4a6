"""Photometric files against plain Python: all three types and symmetries, tilts, rejects, interpolation."""

import math
import random

import pytest
from lumenframe.sources import photometric as ph

SCALE = 0.0706650768394


def text(kind, v, h, values, tilt="NONE"):
    head = f"IESNA\nTILT={tilt}\n" + ("1 2 0 90 1.0 0.5\n" if tilt == "INCLUDE" else "")
    return head + f"1 1000 2.0 {len(v)} {len(h)} {kind} 1 0 0 0\n0.5 1.0 60\n{' '.join(map(str, v))}\n{', '.join(map(str, h))}\n" + "\n".join(" ".join(map(str, r)) for r in values)


def whole(kind, v, h, rows):
    """(v, h, rows) in degrees over the whole turn."""
    near = lambda a, b: abs(a - b) < 1e-4
    rows = [[x * SCALE for x in r] for r in rows]
    if kind == 3:
        e = [(180 - a, r) for a, r in reversed(list(zip(h, rows, strict=True)))]
        if near(h[0], 0):
            e += [(180 + a, r) for a, r in list(zip(h, rows, strict=True))[1:]]
        return [a + 90 for a in v], [a for a, _ in e], [r for _, r in e]
    if kind == 2:
        rows, v, h = [list(c) for c in zip(*rows, strict=True)], h, v
        both = lambda a: [90 - x for x in reversed(a[1:])] + [90 + x for x in a] if near(a[0], 0) else [x + 90 for x in a]
        if near(v[0], 0):
            rows = [list(reversed(r[1:])) + r for r in rows]
        if near(h[0], 0):
            rows = list(reversed(rows[1:])) + rows
        return both(v), both(h), rows
    e = [(a - 90 if near(h[0], 90) else a, r) for a, r in zip(h, rows, strict=True)]
    if len(e) == 1:
        e = [(0.0, e[0][1]), (360.0, e[0][1])]
    for end in (90, 180):
        if near(e[-1][0], end):
            e += [(2 * end - a, r) for a, r in reversed(e[:-1])]
    if near(e[0][0], 0) and not near(e[-1][0], 360):
        gap = 360 - e[-1][0]
        if near(e[-1][0] - e[-2][0], gap) or near(e[1][0] - e[0][0], gap):
            e.append((360.0, e[0][1]))
    return v, [a for a, _ in e], [r for _, r in e]


def cubic(a, b, c, d, x):
    return 0.5 * (((d + 3 * (b - c) - a) * x + (2 * a - 5 * b + 4 * c - d)) * x + (c - a)) * x + b


def strength(v, h, rows, at_h, at_v):
    v, h = [math.radians(x) for x in v], [math.radians(x) for x in h]
    if not (v[0] <= at_v < v[-1] and h[0] <= at_h < h[-1]):
        return 0.0
    j, i = max(0, sum(a < at_h for a in h) - 1), max(0, sum(a < at_v for a in v) - 1)
    x, y = (at_h - h[j]) / (h[j + 1] - h[j]), (at_v - v[i]) / (v[i + 1] - v[i])
    around = h[0] < 1e-7 and h[-1] > 2 * math.pi - 1e-7

    def down(k):
        r = rows[k]
        a = r[i - 1] if i else r[1] if v[0] < 1e-7 else r[i]
        d = r[i + 2] if i + 2 < len(v) else r[len(v) - 2] if v[-1] > math.pi - 1e-7 else r[i + 1]
        return cubic(a, r[i], r[i + 1], d, y)

    a = down(j - 1) if j else down(len(h) - 2) if around else down(j)
    d = down(j + 2) if j + 2 < len(h) else down(1) if around else down(j)
    return max(cubic(a, down(j), down(j + 1), d, x), 0.0)


LAMPS = [(1, [0, 45, 90], [0]), (1, [0, 90, 180], [0, 30, 90]), (1, [0, 60, 120, 180], [0, 90, 180]), (1, [0, 90], [90, 180, 270]), (1, [0, 20, 90], [0, 90, 180, 270]), (1, [0, 20, 90], [0, 100, 360]), (1, [10, 20, 90], [5, 100, 200]), (2, [0, 30, 90], [0, 45, 90]), (2, [-90, 0, 90], [-90, -20, 90]), (3, [-90, 0, 90], [-90, 0, 90]), (3, [0, 30, 90], [0, 30, 90])]


@pytest.fixture(scope="module")
def lamps(spark):
    rnd = random.Random(2)
    made = [(i, kind, v, h, [[rnd.randrange(100) + 0.5 for _ in v] for _ in h]) for i, (kind, v, h) in enumerate(LAMPS)]
    d = spark.createDataFrame([(i, text(kind, v, h, rows, "INCLUDE" if i % 2 else "NONE") + " 7 more") for i, kind, v, h, rows in made], "file long, text string")
    good, bad = ph.parse(d)
    assert bad.count() == 0
    return made, ph.whole(good)


def test_symmetries(lamps):
    made, profiles = lamps
    got = {r["file"]: r for r in profiles.collect()}
    for i, kind, v, h, rows in made:
        down, across, values = whole(kind, v, h, rows)
        assert got[i]["v"] == pytest.approx([math.radians(x) for x in down]) and got[i]["h"] == pytest.approx([math.radians(x) for x in across])
        assert [x for r in got[i]["values"] for x in r] == pytest.approx([x for r in values for x in r])


def test_lookups(spark, lamps):
    made, profiles = lamps
    rnd = random.Random(3)
    at = [(i, rnd.uniform(-0.1, 6.4), rnd.uniform(-0.1, 3.3)) for i in range(len(made)) for _ in range(60)] + [(i, 0.0, 0.0) for i in range(len(made))] + [(99, 1.0, 1.0)]
    got = ph.look_up(spark.createDataFrame(at, "file long, to_h double, to_v double"), profiles, "to_h", "to_v").collect()
    assert len(got) == len(at)
    for r in got:
        want = 100.0 if r["file"] == 99 else strength(*whole(*made[r["file"]][1:]), r["to_h"], r["to_v"])
        assert r["strength"] == pytest.approx(want, abs=1e-9)


def test_rejects(spark):
    ok = text(1, [0, 90], [0], [[1, 2]])
    bad = ["Hello, World!", None, "", "x\nTILT=NONE", ok.replace(" 1 1 0 0 0", " 4 1 0 0 0"), ok[:-2], ok.replace("1 1000", "1.5 1000"), ok.replace("2.0", "two"), ok.replace("2 1 1 1 0", "0 1 1 1 0"), "TILT=NONE\n" + ok.split("\n", 2)[2]]
    good, rejects = ph.parse(spark.createDataFrame([(i, t) for i, t in enumerate([ok, ok.replace("\n", "\r\n"), *bad])], "file long, text string"))
    assert sorted(r["file"] for r in good.collect()) == [0, 1]
    assert {r["file"]: r["reason"] for r in rejects.collect()} == {2: "no line TILT=", 3: "no line TILT=", 4: "no line TILT=", 5: "nothing after the line TILT=", 6: "unknown type", 7: "too few numbers", 8: "a count is no whole number", 9: "a word where a number should be", 10: "no angles", 11: "no line TILT="}


def test_files(spark, tmp_path):
    (tmp_path / "a.ies").write_text(text(1, [0, 90], [0], [[1, 2]]))
    (tmp_path / "b.ies").write_text("nothing")
    good, bad = ph.parse(ph.read(spark, str(tmp_path)))
    assert [r["file"].rpartition("/")[2] for r in good.collect()] == ["a.ies"] and [r["file"].rpartition("/")[2] for r in bad.collect()] == ["b.ies"]
