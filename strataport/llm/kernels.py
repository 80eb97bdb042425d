"""Vectorised text kernels over the byte buffers of Arrow string columns.

A word's 64-bit hash is a polynomial over mixed bytes, from prefix sums, so no Python object is made for a word. Work is
cut into pieces of about a megabyte: memory doesn't grow with a batch, and long texts take 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_PIECE = 1 << 20
_R = U(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = U(pow(int(_R), -1, 1 << 64))
STEP = U(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(r: np.uint64) -> np.ndarray:
    out = np.full(_PIECE + 1, r, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mixed((np.arange(256, dtype=U) + U(1)) * STEP)[_LOWER]
_tables: list[np.ndarray] = []

#: Words of letters, digits and all that isn't ASCII.
ALNUM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
#: Words between ASCII white space.
SPACED = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, column = np.int64, column
    else:
        kind = np.int32
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null row may cover bytes
        gone = np.asarray(column.is_null())
        if (np.diff(offsets)[gone] > 0).any():
            return buffers(column.fill_null(b"" if pa.types.is_binary(column.type) else ""))
    return raw, offsets


def groups(offsets: np.ndarray, most: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of some rows: hash, first and past-the-last byte of each word, and the first word of each row (one more
    than rows). ``data`` are the rows' bytes."""

    __slots__ = ("data", "end", "first", "hash", "start")

    def __init__(self, data, start, end, hash_, first):
        self.data, self.start, self.end, self.hash, self.first = data, start, end, hash_, first

    def __len__(self) -> int:
        return len(self.hash)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def last(self) -> np.ndarray:
        """Past-the-last word of the row of each word."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, lower-cased (A-Z), joined by a space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j])).lower()


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of all rows that ``offsets`` has, for bytes of which ``inside`` says whether they belong to a word."""
    if not _tables:
        _tables.extend([_powers(_R), _powers(_R_INVERSE)])
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = raw[lo:hi]
    rel = offsets - lo
    n = len(data)
    ok = inside[data]
    edge = np.empty(n, bool)  # whether a word starts here
    if n:
        edge[0] = ok[0]
        np.logical_and(ok[1:], ~ok[:-1], out=edge[1:])
        cut = rel[(rel > 0) & (rel < n)]
        edge[cut] = ok[cut]
    start = np.flatnonzero(edge)
    stop = np.empty(n, bool)  # whether a word's last byte is here
    if n:
        stop[-1] = ok[-1]
        np.logical_and(ok[:-1], ~ok[1:], out=stop[:-1])
        stop[cut - 1] = ok[cut - 1]
    end = np.flatnonzero(stop) + 1
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(end, base + _PIECE, "right"))
        if j <= i:  # a word longer than a piece: folded piece by piece
            out[i] = _long(data[base : int(end[i])])
            i += 1
            continue
        part = _BYTE[data[base : int(end[j - 1])]]
        part *= _tables[0][: len(part)]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part, out=total[1:])
        s = start[i:j] - base
        h = (total[end[i:j] - base] - total[s]) * _tables[1][s]
        out[i:j] = mixed(h ^ ((end[i:j] - start[i:j]).astype(U) * STEP))
        i = j
    return Words(data, start, end, out, np.searchsorted(start, rel))


def _long(data: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        total = U(len(data)) * STEP
        for k in range(0, len(data), _PIECE):
            part = _BYTE[data[k : k + _PIECE]]
            total = mixed(np.array([total * _R + (part * _tables[0][: len(part)]).sum(dtype=U)]))[0]
    return total


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= STEP
        h += hashes[j : n + j]
    return mixed(h)


def grams_of(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of a table of word hashes."""
    h = np.zeros(len(rows), U)
    for j in range(rows.shape[1]):
        h *= STEP
        h += rows[:, j]
    return mixed(h)
