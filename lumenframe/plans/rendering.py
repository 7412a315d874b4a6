"""Queries of intersections, rotations, shading functions, passes and schedules: one text that Spark and DuckDB read.

tests/test_rendering.py holds the texts against plain Python.
"""

from __future__ import annotations

from lumenframe.functions import geometry, hashing, scalar, shading
from lumenframe.functions.hashing import Steps
from lumenframe.functions.vector import Vector

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
#: A ray's start and direction, an angle, and uniform numbers, from a line of an order.
INPUTS = {
    "px": "l_extendedprice / 30000.0 - 1.7", "py": "l_quantity / 20.0 - 1.23", "pz": "-4.0 - l_discount",
    "dx": "l_discount * 3.0 - 0.16", "dy": "l_tax * 4.0 - 0.17", "dz": "0.9 + l_tax",
    "w": "l_quantity / 9.0 - 2.71", "u": "CAST(l_partkey % 97 AS DOUBLE) / 97.0", "v": "CAST(l_suppkey % 89 AS DOUBLE) / 89.0", "c": "CAST(l_partkey % 61 AS DOUBLE) / 30.5 - 0.99",
}
P, D = ("px", "py", "pz"), ("dx", "dy", "dz")
FREE = tuple(INPUTS)


def chain(steps: Steps, *names: str) -> str:
    """The named results of steps over the inputs, rounded."""
    inputs = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in INPUTS.items())
    typed = [(n, f"CAST({x} AS DOUBLE)") for n, x in steps]
    columns = ", ".join(f"round({n} + 0.0000137291, 4) + 0.0 AS {n}" for n in names)
    return f"SELECT {KEYS}, {columns} FROM ({hashing.staged(f'(SELECT {KEYS}, {inputs} FROM lineitem) AS i', f'{KEYS}, ' + ', '.join(INPUTS), typed)}) AS s"


def all_of(name: str) -> tuple[str, str, str]:
    """The three components of a vector result."""
    return f"{name}_x", f"{name}_y", f"{name}_z"


CENTRE, SIDE_U, SIDE_V = ("0.2", "0.1", "0.5"), ("1.6", "0.0", "0.3"), ("0.0", "1.8", "0.0")
A, B, C = ("-1.5", "-1.0", "0.2"), ("1.6", "-0.7", "0.4"), ("0.1", "1.9", "-0.3")
ANGLES: Vector = ("0.3", "w", "-0.8")
STOPS = (0.1, 0.7, 0.2, 0.9, 0.4)
ONE = lambda **columns: [(n, x) for n, x in columns.items()]


def _mapped(kind: str) -> str:
    return chain(geometry.mapping(kind, "m", P, ("0.1", "0.2", "w"), ANGLES, ("1.5", "0.5", "2.0")), *all_of("m"))


QUERIES = {
    "ray_plane": chain(geometry.plane("t", P, D, CENTRE, ("0.2", "-0.3", "0.9")), "t"),
    "ray_disc": chain(geometry.disc("t", P, D, CENTRE, ("0.2", "-0.3", "0.9"), "1.3"), "t"),
    "ray_quad": chain(geometry.quad("t", P, D, CENTRE, SIDE_U, SIDE_V), "t", "t_u", "t_v"),
    "ray_ellipse": chain(geometry.quad("t", P, D, CENTRE, SIDE_U, SIDE_V, True), "t"),
    "ray_triangle": chain(geometry.triangle("t", P, D, A, B, C), "t", "t_u", "t_v"),
    "ray_sphere": chain(geometry.sphere("t", P, D, CENTRE, "1.1"), "t"),
    "ray_box": chain(geometry.box("t", P, D, ("-1.0", "-0.9", "-0.5"), ("1.1", "0.8", "1.5")), "t_in", "t_out"),
    "ray_cylinder": chain(geometry.cylinder("t", P, D, "1.2", "0.7"), "t_in", "t_out", "t_hit"),
    "vector_rotate_axis": chain(geometry.rotate("r", P, D, "w", CENTRE), *all_of("r")),
    "vector_rotate_euler": chain(geometry.euler("r", P, ANGLES) + geometry.euler("q", P, ANGLES, True), *all_of("r"), *all_of("q")),
    **{f"mapping_{kind}": _mapped(kind) for kind in ("point", "texture", "vector", "normal")},
    "fresnel": chain(ONE(glass=shading.fresnel("c", "1.45"), inside=shading.fresnel("c", "0.6896551724137931"), facing=shading.facing("c", "v"), layer=shading.fresnel("c", "(1.0 / greatest(1.0 - v, 0.00001))")), "glass", "inside", "facing", "layer"),
    "phase_functions": chain(ONE(hg=shading.henyey_greenstein("c", "(v - 0.5)"), rayleigh=shading.rayleigh("c"), draine=shading.draine("c", "0.4", "v"), lambert=shading.lambert("c")), "hg", "rayleigh", "draine", "lambert"),
    "sample_disc": chain(shading.disc("s", "u", "v"), "s_x", "s_y"),
    "sample_cosine_hemisphere": chain(shading.cosine_hemisphere("s", "u", "v"), *all_of("s"), "s_pdf"),
    "sample_hemisphere": chain(shading.around("s", "u", "v"), *all_of("s")),
    "sample_sphere": chain(shading.around("s", "(1.0 - 2.0 * u)", "v"), *all_of("s")),
    "sample_cone": chain(shading.around("s", "(1.0 - u * (1.0 - 0.8))", "v"), *all_of("s")),
    "sample_exponential": chain(ONE(exponential="(-ln(1.0 - u) / 1.7)", pdf="(1.7 * (1.0 - u))", geometric="floor(ln(1.0 - u) / ln(1.0 - 0.3))"), "exponential", "pdf", "geometric"),
    "mis_weights": chain(ONE(balance=shading.balance("u", "v"), power=shading.power_weight("u", "v"), largest="(CASE WHEN u >= v THEN 1.0 ELSE 0.0 END)"), "balance", "power", "largest"),
    "roulette": chain([("chance", shading.continuation("u", "v * 0.5", "0.05")), ("goes_on", "(CASE WHEN CAST(l_orderkey % 1009 AS DOUBLE) / 1009.0 < chance THEN 1.0 ELSE 0.0 END)"), ("weight", "(CASE WHEN goes_on = 1.0 THEN u / chance ELSE 0.0 END)")], "chance", "goes_on", "weight"),
    "light_termination": chain([("chance", "(greatest(abs(u), abs(v)) * 2.5)"), ("kept", "(CASE WHEN chance >= 1 THEN u WHEN CAST(l_orderkey % 1013 AS DOUBLE) / 1013.0 >= chance THEN 0.0 ELSE u / chance END)")], "chance", "kept"),
    "indirect_clamp": chain(list(zip(("r", "g", "b"), shading.clamped_light(("u", "c", "v * 3.0"), "1.25"), strict=True)), "r", "g", "b"),
    "equirectangular": chain([("e_u", shading.equirectangular(D)[0]), ("e_v", shading.equirectangular(D)[1]), *geometry.named("back", shading.from_equirectangular("e_u", "e_v"))[0]], "e_u", "e_v", *all_of("back")),
    "float_to_byte": chain(ONE(byte=shading.to_byte("c"), back=f"({shading.to_byte('u')} / 255.0)"), "byte", "back"),
    "convert_types": chain(ONE(vector_to_float="((px + py + pz) / 3.0)", color_to_float="(0.2126729 * u + 0.7151522 * v + 0.0721750 * c)", float_to_int="(CASE WHEN w >= 0 THEN floor(w) ELSE ceil(w) END)"), "vector_to_float", "color_to_float", "float_to_int"),
    "ramp_lookup": chain(ONE(smooth=shading.ramp("c", STOPS), steps=shading.ramp("c", STOPS, False)), "smooth", "steps"),
    "vector_map_range": chain([(f"{kind}_{k}", scalar.map_range(kind, x, "-2.0", "2.5", "0.1", f"1.{i}")) for kind in ("linear", "stepped", "smoothstep", "smootherstep") for i, (k, x) in enumerate(zip("xyz", P, strict=True))], *[f"{kind}_{k}" for kind in ("linear", "stepped", "smoothstep", "smootherstep") for k in "xyz"]),
    "mix_float_vector": chain([("mixed", "(px + (py - px) * least(greatest(c, 0.0), 1.0))"), *[(f"uniform_{k}", f"({a} + ({b} - {a}) * w)") for k, a, b in zip("xyz", P, D, strict=True)], *[(f"each_{k}", f"({a} + ({b} - {a}) * {t})") for k, a, b, t in zip("xyz", P, D, ("u", "v", "c"), strict=True)]], "mixed", *all_of("uniform"), *all_of("each")),
    **{f"tex_magic_{n}": chain(shading.magic("m", P, n, "0.9"), *all_of("m")) for n in (0, 2, 5, 10)},
    "tex_gradient_sphere": chain([("r", "greatest(0.999999 - sqrt(u * u + v * v + c * c), 0.0)"), ("quadratic_sphere", "(r * r)")], "quadratic_sphere"),
    "ray_valid": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0",
    "hash_pcg3d": "SELECT o_orderkey, pcg_x, pcg_y, pcg_z FROM (" + hashing.staged("orders", "o_orderkey, o_custkey", hashing.pcg3d("pcg", "o_orderkey", "o_custkey", "(o_orderkey % 1000)")) + ") AS h",
    "hash_pcg4d": "SELECT o_orderkey, pcg_x, pcg_y, pcg_z, pcg_w FROM (" + hashing.staged("orders", "o_orderkey, o_custkey", hashing.pcg4d("pcg", "o_orderkey", "o_custkey", "(o_orderkey % 1000)", "7")) + ") AS h",
    "hash_prospector_seeded": "SELECT o_orderkey, mixed FROM (" + hashing.staged("orders", "o_orderkey, o_custkey", [("seeded", hashing.xor("o_orderkey", "o_custkey")), *hashing.prospector("mixed", "seeded")]) + ") AS h",
    "lcg_stream": "SELECT o_orderkey, s_3 AS state, round(CAST(s_3 AS DOUBLE) / CAST(4294967296 AS DOUBLE), 6) AS value FROM (" + hashing.staged("orders", "o_orderkey", [("s_0", hashing.cut("o_orderkey")), *[(f"s_{i + 1}", hashing.cut(f"{hashing.times(f's_{i}', 1103515245)} + 12345")) for i in range(3)]]) + ") AS h",
    "vertex_normals": "SELECT vertex, round(x / len, 4) + 0.0 AS x, round(y / len, 4) + 0.0 AS y, round(z / len, 4) + 0.0 AS z FROM (SELECT vertex, x, y, z, sqrt(x * x + y * y + z * z) AS len FROM (SELECT l_suppkey AS vertex, sum(l_discount - 0.0503) AS x, sum(l_tax - 0.0307) AS y, sum(l_quantity / 50.0) AS z FROM lineitem GROUP BY l_suppkey) AS s) AS n WHERE len > 0",
    "time_parse": "SELECT o_orderkey, h * 3600 + m * 60 + s AS seconds FROM (SELECT o_orderkey, CAST(substr(t, 1, 2) AS BIGINT) AS h, CAST(substr(t, 4, 2) AS BIGINT) AS m, CAST(substr(t, 7, 2) AS BIGINT) AS s FROM (SELECT o_orderkey, concat(lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), ':', lpad(CAST(o_custkey % 60 AS STRING), 2, '0'), ':', lpad(CAST(o_orderkey % 59 AS STRING), 2, '0')) AS t FROM orders) AS a) AS b",
    "film_light_passes": "SELECT l_suppkey, count(*) AS sample_count, "
    + ", ".join(f"round(sum(CASE WHEN l_linenumber % 4 = {i} AND l_returnflag {op} 'N' THEN l_extendedprice / 1000 ELSE 0.0 END) / count(*), 4) AS {kind}_{part}" for i, kind in enumerate(("diffuse", "glossy", "transmission", "volume")) for part, op in (("direct", "="), ("indirect", "<>")))
    + ", "
    + ", ".join(f"round(sum(CASE WHEN l_linenumber % 4 = {i} THEN l_discount ELSE 0.0 END) / count(*), 5) AS {kind}_color" for i, kind in enumerate(("diffuse", "glossy", "transmission")))
    + ", round(sum(CASE WHEN l_linestatus = 'O' THEN l_tax ELSE 0.0 END) / count(*), 5) AS emission, round(sum(CASE WHEN l_linestatus = 'F' THEN l_tax ELSE 0.0 END) / count(*), 5) AS background, round(sum(l_quantity) / count(*), 4) AS motion_weight FROM lineitem GROUP BY l_suppkey",
    "film_combined_alpha": "SELECT l_suppkey, round(r * 1.5 / n, 4) AS r, round(g * 1.5 / n, 5) AS g, round(b * 1.5 / n, 5) AS b, round(least(greatest(1.0 - t / n, 0.0), 1.0), 4) AS alpha FROM (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice / 1000) AS r, sum(l_discount) AS g, sum(l_tax) AS b, sum(l_quantity / 50.0) AS t FROM lineitem GROUP BY l_suppkey) AS f",
}
