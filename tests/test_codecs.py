"""Codecs, paths and batch alignment, evaluated by DuckDB, against numpy and known values."""

import random

import duckdb
import numpy as np
from lumenframe.functions import codecs, hashing


def ask(expression, rows, names, kinds):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (row_id INTEGER, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ")")
    con.executemany("INSERT INTO t VALUES (" + ", ".join("?" * (1 + len(names))) + ")", [[i, *r] for i, r in enumerate(rows)])
    if isinstance(expression, tuple):
        steps, out = expression
        source = hashing.staged("t", "row_id, " + ", ".join(names), steps)
        return con.execute(f"SELECT {', '.join(out)} FROM ({source}) ORDER BY row_id").fetchall()
    return [r[0] for r in con.execute(f"SELECT {expression} FROM t ORDER BY row_id").fetchall()]


def test_half_floats():
    rnd = random.Random(2)
    xs = [1.0, 2.0, 10.0, 100.0, -0.5, 0.0, 65504.0, 65519.9, 65520.0, 1e9, -1e9, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 6.1e-5, 2049.0, 2051.0] + [rnd.uniform(-1, 1) * 10.0 ** rnd.randrange(-8, 5) for _ in range(400)]
    got = [r[0] for r in ask((codecs.to_half("h", "x"), ["h"]), [[x] for x in xs], ["x"], ["DOUBLE"])]
    assert got[:5] == [0x3C00, 0x4000, 0x4900, 0x5640, 0xB800]
    with np.errstate(over="ignore"):
        assert got == [int(np.float64(x).astype(np.float16).view(np.uint16)) for x in xs]
    bits = [*range(0, 65536, 37), 31744, 64512, 1023, 1024]
    bits = [b for b in bits if not (b & 31744 == 31744 and b & 1023)]
    assert ask(codecs.from_half("b"), [[b] for b in bits], ["b"], ["BIGINT"]) == [float(np.uint16(b).view(np.float16)) for b in bits]


def test_shared_exponents():
    cases = [((7.334898, 5.811583, 2.414717), (7.34375, 5.8125, 2.40625)), ((0.08750992, 0.05150064, 0.24991725), (0.087890625, 0.05078125, 0.25)), ((4e-6, 30257.0, 1.0), (0, 30208, 0)), ((-3e38, 3e38, 0.0), (-65280, 65280, 0)), ((0.0, 0.0, 0.0), (0, 0, 0)), ((5.9e-8, 0.0, 0.0), (0, 0, 0))]
    got = ask((codecs.shared_exponent("c", "r", "g", "b"), ["c_r", "c_g", "c_b"]), [c for c, _ in cases], "rgb", ["DOUBLE"] * 3)
    assert got == [want for _, want in cases]


def test_paths_and_numbers():
    paths = ["/tmp/foo.txt", "/", "/tmp/foo.txt/", "foo.txt", "", "/foo.txt"]
    assert ask(codecs.file_name("p"), [[p] for p in paths], ["p"], ["VARCHAR"]) == ["foo.txt", "/", ".", "foo.txt", "", "foo.txt"]
    assert ask(codecs.folder("p"), [[p] for p in paths], ["p"], ["VARCHAR"]) == ["/tmp", "", "/tmp/foo.txt", "", "", "/"]
    pairs = [("", ""), ("", "foo.txt"), ("foo", ""), ("foo", "bar"), ("foo/", "bar"), ("foo", "/bar"), ("foo/", "/bar")]
    assert ask(codecs.joined("a", "b"), pairs, "ab", ["VARCHAR"] * 2) == ["", "foo.txt", "foo", "foo/bar", "foo/bar", "foo/bar", "foo//bar"]
    numbers = [0, 7, 999, 1000, 1001, 999999, 1234567, 10**9, 123456789012345]
    assert ask(codecs.thousands("n"), [[n] for n in numbers], ["n"], ["BIGINT"]) == [f"{n:,}" for n in numbers]


def test_batches_end_where_a_test_is_due():
    known = {(0, 4): 4, (0, 7): 7, (0, 15): 15, (0, 16): 16, (0, 17): 16, (0, 20): 16, (0, 60): 16, (9, 8): 7, (9, 20): 7, (9, 60): 7, (12, 6): 4, (12, 20): 4, (12, 60): 4, (15, 4): 1, (15, 6): 1, (15, 10): 1, (58, 2): 2, (16, 3): 3, (16, 4): 4, (16, 5): 4, (16, 10): 4, (15, 2): 1, (16, 2): 2, (17, 2): 2, (18, 2): 2}
    assert ask(codecs.aligned("s", "n", 11, 4), list(known), "sn", ["BIGINT"] * 2) == list(known.values())
    due = ask(codecs.tested("s", 11, 4), [[s] for s in range(60)], "s", ["BIGINT"])
    assert [s for s, d in enumerate(due) if d] == [15, 19, 23, 27, 31, 35, 39, 43, 47, 51, 55, 59]
