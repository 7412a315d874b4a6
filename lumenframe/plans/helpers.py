"""Queries of codecs, paths, and readable numbers: one text that Spark and DuckDB read, but for the exponents of codecs.

tests/test_codecs.py holds the texts against numpy and known values.
"""

from __future__ import annotations

from collections.abc import Callable

from lumenframe.functions import codecs, hashing

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_NUMBERS = f"(SELECT {KEYS}, l_extendedprice / 7.0 - 2000.0 AS x, l_quantity / 3.0 AS y, CAST(l_discount AS DOUBLE) / 900.0 AS z FROM lineitem) AS i"
_PATH = "concat('/', replace(p_type, ' ', '/'), CASE WHEN p_size % 5 = 0 THEN '/' ELSE '' END)"


def _codecs(exponents: Callable[..., hashing.Steps]) -> dict[str, str]:
    return {
        "codec_half": f"SELECT {KEYS}, hx, hz, {codecs.from_half('hx')} AS x, {codecs.from_half('hz')} AS z FROM ({hashing.staged(_NUMBERS, KEYS + ', x, z', codecs.to_half('hx', 'x', exponents) + codecs.to_half('hz', 'z', exponents))}) AS h",
        "codec_shared_exponent": f"SELECT {KEYS}, c_r + 0.0 AS c_r, c_g + 0.0 AS c_g, c_b + 0.0 AS c_b FROM ({hashing.staged(_NUMBERS, KEYS + ', x, y, z', codecs.shared_exponent('c', 'x', 'y', 'z', exponents))}) AS h",
    }


QUERIES = _codecs(codecs.counted) | {
    "path_parts": f"SELECT p_partkey, {codecs.file_name('path')} AS name, {codecs.folder('path')} AS folder, {codecs.joined('path', 'p_name')} AS joined FROM (SELECT p_partkey, p_name, {_PATH} AS path FROM part) AS p",
    "str_thousands": f"SELECT doc_id, {codecs.thousands('n')} AS size FROM (SELECT doc_id, n_chars * n_chars * (doc_id % 2 * 999 + 1) AS n FROM documents) AS d",
}
#: What Spark runs for the same names: the count of powers outgrows the code that it compiles well.
SPARK = QUERIES | _codecs(codecs.logged)
