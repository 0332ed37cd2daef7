"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D (no byte of a multi-byte
UTF-8 character falls in there). A column is cut into chunks of about ``CHUNK`` bytes
of whole documents, and each chunk is hashed with a handful of numpy passes: prefix
sums of ``table[byte] * B^i`` modulo 2^64 give every word's polynomial hash by one
subtraction. Two words share a hash only by a 64-bit collision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240105).integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
#: multipliers of the words of a k-gram, by position
GRAM = np.random.default_rng(35).integers(1, 2 ** 63, 64, dtype=np.uint64) | _U(1)

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n, kept between calls."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("_pow", _BASE), ("_inv", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


@dataclass
class Chunk:
    """Words of consecutive documents: document ``d`` of the chunk (row ``row0 + d`` of
    the column) has the words ``first[d]:first[d + 1]``. ``sizes`` are bytes; ``stems``, one
    array for each length asked for, hash the first bytes of longer words and are 0 for others."""

    row0: int
    docs: int
    first: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray
    stems: tuple[np.ndarray, ...] = ()


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(col: pa.Array, lower: bool = False, between: np.ndarray = _SEP,
           stems: tuple[int, ...] = ()) -> Iterator[Chunk]:
    """Word hashes of a string column (null counts as empty text), chunk by chunk; ``between``
    marks the bytes that are in no word."""
    raw, offsets = string_buffers(col)
    n, d = len(offsets) - 1, 0
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + CHUNK, side="right")) - 1)
        off = offsets[d:e + 1] - offsets[d]
        buf = raw[offsets[d]:offsets[e]]
        yield _hash_chunk(d, _LOWER[buf] if lower else buf, off, between, stems)
        d = e


def _hash_chunk(row0: int, buf: np.ndarray, off: np.ndarray, between: np.ndarray,
                stems: tuple[int, ...]) -> Chunk:
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.uint64)
        return Chunk(row0, len(off) - 1, np.zeros(len(off), np.int64), none, np.zeros(0, np.int64),
                     (none,) * len(stems))
    word = ~between[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    begins = word & edge[:n]
    begins[1:] |= word[1:] & ~word[:-1]
    stops = word & edge[1:]
    stops[:-1] |= word[:-1] & ~word[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _powers(n)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[buf] * up, out=acc[1:])
    sizes = ends - starts
    h = (acc[ends] - acc[starts]) * down[starts]
    h = mix(h + sizes.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    heads = tuple(np.where(sizes > k, mix((acc[np.minimum(starts + k, n)] - acc[starts]) * down[starts] + _U(k)), _U(0))
                  for k in stems)
    return Chunk(row0, len(off) - 1, np.searchsorted(starts, off), h, sizes, heads)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (runs across documents included)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j:j + n] * GRAM[j]
    return mix(out)


def whole(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a whole word sequence, as signed integers."""
    n = len(hashes)
    if n == 0:
        return 0, 0
    up, _ = _powers(n)
    a = int((hashes * up).sum(dtype=np.uint64))
    b = int((mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)) * up).sum(dtype=np.uint64))
    return signed(a), signed(b)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def list_column(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """A list column from one array per row."""
    off = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, type=kind))
