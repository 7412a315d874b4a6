"""The texts of geometry and shading expressions, evaluated by DuckDB, against plain Python on random inputs."""

import math
import random

import duckdb
import numpy as np
import pytest
from lumenframe.functions import geometry, hashing, shading
from lumenframe.functions.scalar import map_range

P, D = ("px", "py", "pz"), ("dx", "dy", "dz")
NAMES = [*P, *D, "u", "v", "c", "w"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    return [[rnd.uniform(-2, 2), rnd.uniform(-2, 2), rnd.uniform(-5, -2), rnd.uniform(-0.4, 0.4), rnd.uniform(-0.4, 0.4), rnd.uniform(0.5, 1.5), rnd.random(), rnd.random(), rnd.uniform(-1, 1), rnd.uniform(-7, 7)] for _ in range(300)]


@pytest.fixture(scope="module")
def run(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (n INTEGER, " + ", ".join(f"{x} DOUBLE" for x in NAMES) + ")")
    con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * (1 + len(NAMES)))})", [[i, *r] for i, r in enumerate(rows)])

    def go(steps, *out):
        typed = [(n, f"CAST({x} AS DOUBLE)") for n, x in steps]
        return np.array(con.execute(f"SELECT {', '.join(out)} FROM ({hashing.staged('t', 'n, ' + ', '.join(NAMES), typed)}) ORDER BY n").fetchall(), dtype=float)

    return go


def text(v):
    return tuple(str(float(x)) for x in v)


def test_flat_shapes(run, rows):
    q, n, u, v = np.array([0.2, 0.1, 0.5]), np.array([0.2, -0.3, 0.9]), np.array([1.6, 0, 0.3]), np.array([0, 1.8, 0])
    p, d = np.array(rows)[:, :3], np.array(rows)[:, 3:6]
    t = ((q - p) @ n) / (d @ n)
    assert run(geometry.plane("t", P, D, text(q), text(n)), "t")[:, 0] == pytest.approx(np.where(t >= 0, t, -1))
    near = np.linalg.norm(p + t[:, None] * d - q, axis=1) <= 1.3
    assert run(geometry.disc("t", P, D, text(q), text(n), "1.3"), "t")[:, 0] == pytest.approx(np.where((t >= 0) & near, t, -1)) and near.any() and not near.all()
    m = np.cross(u, v)
    t = ((q - p) @ m) / (d @ m)
    o = p + t[:, None] * d - q
    a, b = o @ u / (u @ u), o @ v / (v @ v)
    for ellipse, inside in ((False, (abs(a) <= 0.5) & (abs(b) <= 0.5)), (True, a * a + b * b <= 0.25)):
        assert run(geometry.quad("t", P, D, text(q), text(u), text(v), ellipse), "t")[:, 0] == pytest.approx(np.where((t >= 0) & inside, t, -1)) and inside.any()


def test_triangle(run, rows):
    a, b, c = (np.array(x) for x in ([-1.5, -1.0, 0.2], [1.6, -0.7, 0.4], [0.1, 1.9, -0.3]))
    want = []
    for r in np.array(rows):
        k = np.linalg.solve(np.column_stack([b - a, c - a, -r[3:6]]), r[:3] - a)
        want.append(k[2] if k[0] >= 0 and k[1] >= 0 and k[0] + k[1] <= 1 and k[2] >= 0 else -1)
    assert run(geometry.triangle("t", P, D, text(a), text(b), text(c)), "t")[:, 0] == pytest.approx(want) and 20 < sum(x >= 0 for x in want) < 290


def test_round_shapes_and_boxes(run, rows):
    q, want, span, tube = np.array([0.2, 0.1, 0.5]), [], [], []
    for r in np.array(rows):
        o, d = r[:3] - q, r[3:6]
        roots = [x.real for x in np.roots([d @ d, 2 * o @ d, o @ o - 1.1**2]) if abs(x.imag) < 1e-12 and x.real >= 0]
        want.append(min(roots, default=-1))
        lo = [sorted(((x - r[k]) / r[3 + k], (y - r[k]) / r[3 + k])) for k, (x, y) in enumerate(((-1.0, 1.1), (-0.9, 0.8), (-0.5, 1.5)))]
        i, j = max(0.0, *(x for x, _ in lo)), min(y for _, y in lo)
        span.append((i, j) if i <= j else (-1, -1))
        e = np.array([1 / 1.44, 1 / 0.49])
        roots = np.roots([(d[:2] ** 2) @ e, 2 * (r[:2] * d[:2]) @ e, (r[:2] ** 2) @ e - 1])
        tube.append((*sorted(roots.real), 1) if abs(roots.imag).max() < 1e-12 else (0, 0, 0))
    assert run(geometry.sphere("t", P, D, text(q), "1.1"), "t")[:, 0] == pytest.approx(want, abs=1e-6)
    assert run(geometry.box("t", P, D, ("-1.0", "-0.9", "-0.5"), ("1.1", "0.8", "1.5")), "t_in", "t_out") == pytest.approx(np.array(span))
    assert run(geometry.cylinder("t", P, D, "1.2", "0.7"), "t_in", "t_out", "t_hit") == pytest.approx(np.array(tube), abs=1e-6)


def turn(axis, angle):
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def test_rotations_and_mappings(run, rows):
    x, centre = np.array(rows)[:, :3], np.array([0.2, 0.1, 0.5])
    want = [turn(r[3:6], r[9]) @ (r[:3] - centre) + centre for r in np.array(rows)]
    assert run(geometry.rotate("r", P, D, "w", text(centre)), "r_x", "r_y", "r_z") == pytest.approx(np.array(want))
    assert run(geometry.rotate("r", P, ("0.0", "0.0", "0.0"), "w", text(centre)), "r_x", "r_y", "r_z") == pytest.approx(x)
    euler = turn([0, 0, 1], -0.8) @ turn([0, 1, 0], 0.5) @ turn([1, 0, 0], 0.3)
    angles, move, size = ("0.3", "0.5", "-0.8"), np.array([0.1, 0.2, 0.7]), np.array([1.5, 0.5, 2.0])
    assert run(geometry.euler("r", P, angles), "r_x", "r_y", "r_z") == pytest.approx(x @ euler.T)
    assert run(geometry.euler("r", P, angles, True), "r_x", "r_y", "r_z") == pytest.approx(x @ euler)
    normal = (x / size) @ euler.T
    for kind, want in (("point", (x * size) @ euler.T + move), ("texture", ((x - move) @ euler) / size), ("vector", (x * size) @ euler.T), ("normal", normal / np.linalg.norm(normal, axis=1, keepdims=True))):
        assert run(geometry.mapping(kind, "m", P, text(move), angles, text(size)), "m_x", "m_y", "m_z") == pytest.approx(want)


def integral(f):
    x, w = np.polynomial.legendre.leggauss(200)
    return 2 * math.pi * float(sum(b * f(a) for a, b in zip(x, w, strict=True)))


def test_phase_functions_integrate_to_one():
    con = duckdb.connect()
    value = lambda s: con.execute(f"SELECT CAST({s} AS DOUBLE)").fetchone()[0]
    for f in (lambda c: shading.henyey_greenstein(str(c), "0.4"), lambda c: shading.rayleigh(str(c)), lambda c: shading.draine(str(c), "0.3", "0.7")):
        assert integral(lambda c, f=f: value(f(f"({c})"))) == pytest.approx(1, abs=1e-6)
    assert value(shading.fresnel("1.0", "1.5")) == pytest.approx(0.04) and value(shading.fresnel("0.1", "0.6")) == 1
    assert [value(shading.ramp(x, (0.0, 1.0, 0.5))) for x in ("-1.0", "0.25", "0.75", "2.0")] == pytest.approx([0, 0.5, 0.75, 0.5])
    assert value(shading.ramp("0.75", (0.0, 1.0, 0.5), False)) == 1 and value(shading.to_byte("0.5")) == 128
    assert [value(x) for x in shading.clamped_light(("3.0", "-1.0", "0.0"), "2.0")] == [1.5, -0.5, 0] and value(shading.clamped_light(("3.0", "0.0", "0.0"), "0.0")[0]) == 3
    assert value(map_range("linear", "0.5", "1.0", "1.0", "3.0", "4.0")) == 0


def test_warps_and_projections(run, rows):
    s = run(shading.cosine_hemisphere("s", "u", "v"), "s_x", "s_y", "s_z", "s_pdf")
    assert np.linalg.norm(s[:, :3], axis=1) == pytest.approx(1) and s[:, 3] == pytest.approx(s[:, 2] / math.pi)
    a, b = 2 * np.array(rows)[:, 6] - 1, 2 * np.array(rows)[:, 7] - 1
    assert np.hypot(s[:, 0], s[:, 1]) == pytest.approx(np.maximum(abs(a), abs(b)))  # squares become rings
    ball = run(shading.around("s", "(1.0 - 2.0 * u)", "v"), "s_x", "s_y", "s_z")
    assert np.linalg.norm(ball, axis=1) == pytest.approx(1) and abs(ball.mean(axis=0)).max() < 0.2
    u, v = shading.equirectangular(D)
    back = run([("e", u), ("f", v), *geometry.named("b", shading.from_equirectangular("e", "f"))[0]], "b_x", "b_y", "b_z")
    d = np.array(rows)[:, 3:6]
    assert back == pytest.approx(d / np.linalg.norm(d, axis=1, keepdims=True), abs=1e-9)


def test_magic(run, rows):
    got = run(shading.magic("m", P, 2, "0.9"), "m_x", "m_y", "m_z")
    for r, g in zip(np.array(rows), got, strict=True):
        px, py, pz = (math.fmod(x, 2 * math.pi) for x in r[:3])
        x, y, z = 0.9 * math.sin((px + py + pz) * 5), 0.9 * math.cos((-px + py - pz) * 5), -0.9 * math.cos((-px - py + pz) * 5)
        y = -0.9 * math.cos(x - y + z)
        x = 0.9 * math.cos(x - y - z)
        assert g == pytest.approx([0.5 - k / 1.8 for k in (x, y, z)])


def test_hashes_of_three_and_four():
    word, con = 0xFFFFFFFF, duckdb.connect()
    signed = lambda v: v - (1 << 32) if v >> 31 else v
    rnd = random.Random(8)
    for n, steps, rounds in ((3, hashing.pcg3d, ((0, 1, 2), (1, 2, 0), (2, 0, 1))), (4, hashing.pcg4d, ((0, 1, 3), (1, 2, 0), (2, 0, 1), (3, 1, 2)))):
        for key in [tuple(rnd.randrange(1 << 32) for _ in range(n)) for _ in range(20)] + [(0,) * n, (word,) * n]:
            v = [(x * 1664525 + 1013904223) & word for x in key]
            for turn in range(2):
                for to, a, b in rounds:
                    v[to] = (v[to] + v[a] * v[b]) & word
                if not turn:
                    v = [(x ^ signed(x) >> 16) & word for x in v]
            sql = hashing.staged("(SELECT 1 AS one) AS o", "one", steps("h", *map(str, key)))
            assert con.execute(f"SELECT {', '.join(f'h_{k}' for k in 'xyzw'[:n])} FROM ({sql})").fetchone() == tuple(x & 0x7FFFFFFF for x in v)
