"""Vectorised numpy kernels over an Arrow column of texts: words, word hashes, hashes of word windows.

A whole batch is one byte array; no Python code runs per word or per document.
Words are hashed eight bytes at a time by a step that is not linear in any
ring, long ones by BLAKE2b; windows chain the hashes of their words the same
way. A second family shares neither step nor constants with the first. Equal
inputs have equal hashes in every task.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
_CHUNK = 1 << 18
_LONG = 256  # bytes from which a word is hashed by itself
_WORD_BASE = _U(0xD6E8FEB86659FD93)
_WORD_INVERSE = _U(pow(int(_WORD_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(29))


@functools.lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(10, int(n).bit_length()))[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from stage to stage, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def bounded(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of ``column`` (or one row): bounds the kernels' memory."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            stop = max(int(np.searchsorted(size, before + most, "right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop
        give_back()


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


class Words:
    """Words of a batch: byte bounds, hash, document, and the first word of each document.

    Words are what is between ``blanks``, by default the bytes x20 and x09 to x0D.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, blanks: np.ndarray | None = None, hashes: bool = True) -> None:
        space = (raw == 32) | ((raw >= 9) & (raw <= 13)) if blanks is None else blanks
        n, docs = len(raw), len(offsets) - 1
        first = np.empty(n, bool)
        if n:
            first[0] = True
            first[1:] = space[:-1]
            first[offsets[:-1][offsets[:-1] < n]] = True
            first &= ~space
            last = np.empty(n, bool)
            last[-1] = True
            last[:-1] = space[1:]
            cuts = offsets[1:]
            last[cuts[(cuts > 0)] - 1] = True
            last &= ~space
            self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.start = self.stop = np.zeros(0, np.int64)
        if hashes:
            self.hash = range_hashes(raw, self.start, self.stop)
        self.bounds = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(docs), np.diff(self.bounds))

    def second_windows(self, raw: np.ndarray, size: int) -> np.ndarray:
        """Window hashes of the second family, over the bytes and over the words."""
        return window_hashes(range_hashes(raw, self.start, self.stop, second=True), size, second=True)


def mix_second(x: np.ndarray) -> np.ndarray:
    """Another bijective finaliser."""
    x = x * _U(0xA0761D6478BD642F)
    x = (x << _U(27)) | (x >> _U(37))
    x = x ^ (x >> _U(31))
    x = x * _U(0xE7037ED1A0B428DB)
    return x ^ (x >> _U(33))


TAILS = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), _U, padded, strides=(1,))


def range_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, second: bool = False, long: int = _LONG) -> np.ndarray:
    """Hash of every byte range, of one of two families. Ranges of at least ``long`` bytes are hashed by themselves."""
    length = stop - start
    step = mix_second if second else mix
    out = step(length.astype(_U) + _U(0x9E3779B97F4A7C15))
    view = eight_bytes(raw)
    for a in range(0, len(start), _CHUNK):
        size = length[a : a + _CHUNK]
        live = np.flatnonzero((size > 0) & (size < long))
        at, left, value = start[a : a + _CHUNK][live], size[live], out[a : a + _CHUNK][live]
        while len(live):
            chunk = view[at] & TAILS[np.minimum(left, 8)]
            value = step(value + chunk) if second else step(value ^ chunk)
            more = left > 8
            out[a + live[~more]] = value[~more]
            live, at, left, value = live[more], at[more] + 8, left[more] - 8, value[more]
    for i in np.flatnonzero(length >= long).tolist():
        digest = hashlib.blake2b(raw[start[i] : stop[i]], digest_size=16).digest()
        out[i] = int.from_bytes(digest[8:] if second else digest[:8], "little")
    return out


def same_bytes(raw: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``raw`` equal those of ``other``, byte by byte."""
    out = np.ones(len(start), bool)
    view, there = eight_bytes(raw), eight_bytes(other)
    live = np.flatnonzero((length > 0) & (length < _LONG))
    at, to, left = start[live], other_start[live], length[live]
    while len(live):
        equal = (view[at] ^ there[to]) & TAILS[np.minimum(left, 8)] == 0
        out[live[~equal]] = False
        more = equal & (left > 8)
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    for i in np.flatnonzero(length >= _LONG).tolist():
        out[i] = np.array_equal(raw[start[i] : start[i] + length[i]], other[other_start[i] : other_start[i] + length[i]])
    return out


def window_hashes(symbols: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of ``symbols[i : i + size]`` for every i; windows may cross documents, see ``whole_windows``."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, base, shift = symbols[:n].copy(), _U(0x8EBC6AF09C88C6E3) if second else _WORD_BASE, _U(25) if second else _U(32)
    for k in range(1, size):
        out ^= out >> shift
        out *= base
        out += symbols[k : n + k]
    return mix_second(out) if second else mix(out)


def long_window_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Polynomials modulo 2**64 by prefix sums, at a cost that doesn't depend on ``size``: only to route or to preselect, decisions compare symbols."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(len(symbols) + 1, _U)
    np.cumsum(symbols * powers(_WORD_BASE, len(symbols)), out=total[1:])
    return mix((total[size:] - total[:n]) * powers(_WORD_INVERSE, n))


def whole_windows(bounds: np.ndarray, size: int) -> np.ndarray:
    """Mask over window starts: those that stay in one document. ``bounds``: first symbol of each document and the end."""
    n = max(int(bounds[-1]) - size + 1, 0)
    ok = np.ones(n, bool)
    if n:
        inside = np.zeros(int(bounds[-1]) + 1, np.int32)
        stops = bounds[1:]
        starts = np.maximum(bounds[:-1], stops - size + 1)
        np.add.at(inside, starts, 1)
        np.add.at(inside, stops, -1)
        ok = np.cumsum(inside[:-1])[:n] == 0
    return ok


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask of ``n`` positions covered by windows of ``size`` at ``starts``."""
    edge = np.zeros(n + size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0
