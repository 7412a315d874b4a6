"""Words and windows of words as 64-bit hashes, computed over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK = 1 << 19
#: An odd multiplier (a power's inverse exists modulo 2^64) and the seeds of the byte table: fixed values.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SECOND = 0xD1342543DE82EF95


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, np.uint64(base))
        if n:
            p[0] = 1
        return np.multiply.accumulate(p)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mixed(np.arange(256, dtype=np.uint64), 1)
_UP, _DOWN = _powers(BASE, BLOCK + 1), _powers(INVERSE, BLOCK + 1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(BASE, n), _powers(INVERSE, n)
    return _UP[:n], _DOWN[:n]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in data: each word's start and end, and the offsets of words by text."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blocks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A string column some texts at a time: their rows, their bytes and their offsets in these. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        yield slice(row, stop), data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and their offsets by text."""
    starts, ends, by = spans(data, offsets)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * down[starts]), by


def windows(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of that many words. Those that cross from one text to the next are the caller's to leave out."""
    if len(hashes) < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(hashes, salt) * up[: len(hashes)], dtype=np.uint64)])
        return mixed((sums[length:] - sums[:-length]) * down[: len(hashes) - length + 1], salt)


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each of lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
