"""Vectorised tokenisation and hashing of UTF-8 bytes.

Texts are joined into one byte array per chunk, so that words, windows and lines
of thousands of documents are found and hashed by a handful of numpy calls.

The hash of a byte range is a polynomial over the integers modulo 2**64 with a
random 64-bit value per byte, read off a running sum: ``hash(l, r) =
(S[r] - S[l]) * P**-l``. A final mixing step spreads it over all 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  another C library may not have it
except (OSError, AttributeError):
    _LIBC = None

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 1 for bytes of words that white space ends (bytes 9 to 13 and 32 end them).
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: 1 for ASCII letters, digits and every byte of a character beyond ASCII.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@lru_cache(2)
def _powers_upto(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = max(1 << 16, 1 << max(0, (n - 1).bit_length()))
    return _powers_upto(size, _INVERSE if inverse else _BASE)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class ByteHash:
    """Hashes of ranges of one byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * powers(len(data)), out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * powers(len(self.sums), True)[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


class Chunk:
    """Some documents as one byte array; ``\\n`` stands between neighbours.

    ``start[i]:end[i]`` is document i in ``data``; nulls are empty.
    """

    def __init__(self, texts: list[bytes], first: int = 0, lower: bool = False):
        self.first = first
        self.n = len(texts)
        raw = b"\n".join(texts) + b"\n"
        self.bytes = raw.translate(LOWER) if lower else raw
        self.data = np.frombuffer(self.bytes, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self._hash: ByteHash | None = None

    @property
    def hash(self) -> ByteHash:
        if self._hash is None:
            self._hash = ByteHash(self.data)
        return self._hash

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of every maximal run of bytes that ``inside`` marks.

        ``\\n`` must not be inside, so that no word crosses documents.
        """
        mark = inside[self.data].view(np.int8)
        edge = np.diff(mark, prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return start, end, self.document(start)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, "left")

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of the ``\\n``-split lines of every document."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        return start, end, self.document(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def chunks(texts: list[bytes], lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield Chunk(texts[first:i], first, lower)
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield Chunk(texts[first:], first, lower)


def trim() -> None:
    """Gives freed memory back to the system; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def small_batches(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, to bound a worker's memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * size / max(size, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    trim()


def per_document(values: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(document, weights=values, minlength=n).astype(np.int64)


def cover(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """True where any of the ranges covers a position of 0..n-1."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def window_hash(unit: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` units, given the units' hashes."""
    n = len(unit) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + unit[k : k + n]
    return mix(out)
