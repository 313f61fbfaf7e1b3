"""Arrow buffers as flat numpy arrays: code points, word hashes and sorted hash arrays.

Everything works on whole columns of texts at once; no Python loop runs per
word or per character.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time, which bounds the memory of the arrays derived from them.
SLICE_BYTES = 1 << 20

_U = np.uint64
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def trimmed(batches: Iterable) -> Iterator:
    """The batches; after each one and the last, memory that is no longer needed goes back to the system, as workers live on between tasks."""
    for batch in batches:
        yield batch
        trim()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def as_array(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) pieces of about ``limit`` bytes; one long text stays whole."""
    texts = as_array(texts)
    if not len(texts):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, texts.slice(a, b - a)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the n+1 offsets between them."""
    texts = pc.fill_null(as_array(texts).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts as uint32 and the n+1 offsets between them."""
    data, byte_offsets = raw_bytes(texts)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return cps, lead[byte_offsets].astype(np.int64)


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[9, 10, 12, 13, 32]] = True
_rng = np.random.default_rng(20_240_229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = 1 << 12


@functools.cache
def _powers(base: int) -> np.ndarray:
    """base**0 .. base**(_POWERS-1) modulo 2**64."""
    out = np.full(_POWERS, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, made anew, as each would be kept by every worker."""
    high = np.full(-(-n // _POWERS), pow(base, _POWERS, 1 << 64), np.uint64)
    high[:1] = 1
    return np.multiply.outer(np.multiply.accumulate(high), _powers(base)).ravel()[:n]


def word_hashes(texts: pa.Array, by: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and how many words each text has.

    ``by="word"``: runs of ASCII letters and digits and of non-ASCII characters.
    ``by="space"``: runs of anything but blank, tab, line feed, form feed, return.
    """
    data, offsets = raw_bytes(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = _WORD_BYTE[data] if by == "word" else ~_SPACE_BYTE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    starts[first] = inside[first]  # a word doesn't run on into the next text
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[:-1] &= ~inside | starts
    ends[0] = False
    a, b = np.flatnonzero(starts), np.flatnonzero(ends)
    sums = np.zeros(n + 1, np.uint64)
    values = _power(_BASE, n)
    values *= _BYTE_VALUE[data]
    np.cumsum(values, out=sums[1:])
    del values
    h = mix64((sums[b] - sums[a]) * _power(_INVERSE, n)[a] + (b - a).astype(np.uint64))
    return h, np.searchsorted(a, offsets[1:]) - np.searchsorted(a, offsets[:-1])


class SortedHashArray:
    """Values by 64-bit key: keys mixed and sorted, found through a directory of their leading bits.

    ``find(keys)`` gives the row of each key in the arrays passed to
    ``take``-style users, or -1.  Building keeps one row per key.
    """

    def __init__(self, keys: np.ndarray):
        hashed = mix64(np.asarray(keys, dtype=np.uint64))
        order = np.argsort(hashed, kind="stable")
        self.hashes = hashed[order]
        self.order = order.astype(np.int32 if len(order) < 1 << 31 else np.int64)
        bits = max(1, min(22, int(len(keys)).bit_length()))
        self.shift = _U(64 - bits)
        self.start = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(self.order.dtype)

    def arrange(self, values: np.ndarray) -> np.ndarray:
        """Values, one for each key, in the order of the hashes, for ``find(keys, arranged=True)``."""
        return values[self.order]

    def forget_order(self) -> None:
        """Only arranged values will be used."""
        self.order = None

    def find(self, keys: np.ndarray, arranged: bool = False) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        if not len(self.hashes) or not len(keys):
            return out
        h = mix64(np.asarray(keys, dtype=np.uint64))
        cell = (h >> self.shift).astype(np.int64)
        at, end = self.start[cell], self.start[cell + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            there = self.hashes[at[todo]]
            want = h[todo]
            hit = there == want
            out[todo[hit]] = at[todo[hit]] if arranged else self.order[at[todo[hit]]]
            at[todo] += 1
            todo = todo[(there < want) & (at[todo] < end[todo])]
        return out


def sum_by(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; a run may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
