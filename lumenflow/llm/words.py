"""Words and shingles of many texts at once, on the UTF-8 bytes that Arrow holds.

A word is a run of bytes other than 0x20 and 0x09-0x0D. A hash is two polynomials of the bytes modulo the
prime 2^31 - 1 at two random points, taken from running sums, so a batch costs a few passes over its bytes.
Two different strings of at most n bytes share a hash with chance (n / 2^31)^2 at most, whatever they hold.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes of text worked on at a time; a longer text is a block of its own
ROWS = 1 << 10  # rows of a batch copied at a time

PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)
SEGMENT = 1 << 23  # bytes whose terms add up below 2^63
_POINTS = (950_706_376, 1_583_458_089)  # both generate all residues
_CODE = np.arange(1, 257, dtype=np.uint64)
_LOWER_CODE = _CODE.copy()
_LOWER_CODE[65:91] = _CODE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def give_back() -> None:
    """Return freed memory to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Block(NamedTuple):
    """Rows ``first`` to ``last`` of a batch; row r's bytes are data[offsets[r-first]:offsets[r-first+1]]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def blocks(texts: pa.Array, limit: int = BLOCK, rows: int = ROWS) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts; null is read as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for start in range(0, len(texts), rows):
        part = texts.slice(start, rows).cast(pa.large_binary()).fill_null(b"")
        n = len(part)
        _, places, content = part.buffers()
        at = np.frombuffer(places, np.int64, n + 1, part.offset * 8)
        data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield Block(start + first, start + last, data[at[first] : at[last]], at[first : last + 1] - at[first])
            first = last
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def folded(x: np.ndarray) -> np.ndarray:
    """Smaller values with the same remainders modulo 2^31 - 1."""
    out = x >> _BITS
    out += x & _P
    return out


def reduced(x: np.ndarray) -> np.ndarray:
    """Remainders modulo 2^31 - 1."""
    x = folded(folded(x))
    return np.minimum(x, x - _P)  # the difference wraps to a large value where x is the smaller one


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, reduced(out * np.uint64(pow(base, len(out), PRIME)))))
    return out[:n]


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each point its powers 0..n and those of its inverse."""
    if not _tables or len(_tables[0][0]) <= n:
        size = max(n + 1, BLOCK + 1)
        made = [(_power_table(x, size), _power_table(pow(x, -1, PRIME), size)) for x in _POINTS]
        if size > 16 * BLOCK:
            return made
        _tables[:] = made
    return _tables


class Prefix:
    """Hashes of any substring of ``data`` from running sums."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        code = (_LOWER_CODE if lower else _CODE)[data]
        self.lanes = []
        for up, down in powers(n):
            sums = np.zeros(n + 1, np.uint64)
            np.multiply(code, up[:n], out=sums[1:])
            for first in range(0, n, SEGMENT):
                part = sums[first : first + SEGMENT + 1]
                np.cumsum(part, out=part)
                if n > SEGMENT:
                    part[:] = reduced(part)
            self.lanes.append((sums, down))
        self.lift = _P if n > SEGMENT else np.uint64(0)  # reduced sums may fall

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lanes = []
        for sums, down in self.lanes:
            part = sums[end]
            part += self.lift
            part -= sums[start]
            part = folded(part)  # below 1.5 * 2^32, so the product stays below 2^64
            part *= down[start]
            lanes.append(reduced(part))
        return mix(lanes[0] << np.uint64(32) | lanes[1])


def words(block: Block, lower: bool = False) -> Words:
    start, end = spans(block)
    row = np.searchsorted(block.offsets, start, "right") - 1
    return Words(start, end, row, Prefix(block.data, lower).of(start, end))


def spans(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    data, n = block.data, len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    open_ = solid.copy()
    open_[1:] &= ~solid[:-1] | edge[1:n]
    close = solid.copy()
    close[:-1] &= ~solid[1:] | edge[1:n]
    return np.flatnonzero(open_), np.flatnonzero(close) + 1


def shingles(found: Words, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each row, laid end to end, and where each row's begin.

    A row with fewer than ``width`` words has its whole sequence as one shingle; without words, none.
    """
    count = np.bincount(found.row, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(count)))
    n = len(found.hash)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.maximum(count - width + 1, 0)
    total = np.where(count > 0, np.maximum(full, 1), 0)
    out_begin = np.concatenate(([0], np.cumsum(total)))
    out = np.zeros(out_begin[-1], np.uint64)
    if n >= width:
        joined = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            joined += mix(found.hash[k : n - width + 1 + k] + np.uint64(k)) * factor[k]
        keep = found.row[: n - width + 1] == found.row[width - 1 :]
        target = np.repeat(out_begin[:-1][full > 0], full[full > 0])
        inside = np.arange(len(target)) - np.repeat(np.cumsum(full[full > 0]) - full[full > 0], full[full > 0])
        out[target + inside] = mix(joined[keep])
    for r in np.flatnonzero((count > 0) & (full == 0)):
        part = found.hash[begin[r] : begin[r + 1]]
        value = (mix(part + np.arange(len(part), dtype=np.uint64)) * factor[: len(part)]).sum(dtype=np.uint64)
        out[out_begin[r]] = mix(np.array([value + np.uint64(len(part))], np.uint64))[0]
    fresh = np.ones(len(out), bool)
    for r in range(rows):
        a, b = out_begin[r], out_begin[r + 1]
        if b - a > 1:
            out[a:b].sort()
    fresh[1:] = out[1:] != out[:-1]
    fresh[out_begin[:-1][total > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], kept[out_begin]
