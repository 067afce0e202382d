"""Words of Arrow text batches as NumPy arrays, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Documents are handled in chunks of about this many bytes (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 17

_rng = np.random.default_rng(20240601)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for low, high in ranges:
        out[low:high + 1] = False
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
# Bytes that belong to a word, after A-Z became a-z.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


# glibc alone has it; others give free memory back by themselves.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give free memory back: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, np.uint64(base), dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_powers = _Powers()


@dataclass
class Words:
    """The words of some documents.

    ``start``/``end`` are byte places in ``data`` (already lower-cased),
    ``first[d]`` to ``first[d + 1]`` are the words of document ``d``.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word: a polynomial over its bytes, mixed."""
        n = len(self.data)
        _powers.reach(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * _powers.up[:n], out=prefix[1:])
        return mix((prefix[self.end] - prefix[self.start]) * _powers.down[self.start])

    def text(self, word: int, count: int) -> bytes:
        """``count`` words from ``word`` on, joined by single spaces."""
        data = self.data
        return b" ".join(data[s:e].tobytes() for s, e in
                         zip(self.start[word:word + count].tolist(), self.end[word:word + count].tolist()))

    def fits(self, length: int) -> np.ndarray:
        """The words at which ``length`` words of the same document begin."""
        counts = np.diff(self.first)
        room = np.repeat(self.first[1:], counts) - np.arange(self.first[0], self.first[-1])
        return room >= length


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words, without regard to document ends."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(length):
        out = out * _STEP + hashes[j:j + n]
    return mix(out)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string or binary column; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        # Arrow allows bytes under a null; take them out.
        filled = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        return binary_parts(filled)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``CHUNK_BYTES`` with their bytes and offsets."""
    if len(column) == 0:
        return
    data, offsets = binary_parts(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, stop, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def split(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """The words of documents that lie one after the other in ``data``."""
    data = LOWER[data]
    inside = member[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        edges = np.zeros(len(data) + 1, dtype=bool)
        edges[offsets] = True
        opens[1:] &= ~inside[:-1] | edges[1:-1]
        closes[:-1] &= ~inside[1:] | edges[1:-1]
    start = np.flatnonzero(opens)
    return Words(data, start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))
