"""Words and word-sequence hashes over whole Arrow batches, vectorised in numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 text equals the
pattern ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomial sums over random byte values
(odd base, modulo 2**64) followed by a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
CHUNK_BYTES = 1 << 20
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, dtype=_U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Sum over [start, end) shifted to the start, from inclusive running sums with a leading 0."""
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """Words of some documents in order. doc: index of each word's document; first: index of each document's first word, with one more at the end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on that has so many in its document: (positions, hashes)."""
        n = len(self.hashes)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(left >= k)
        return at, self.spans(at, at + k)

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        up, down = _WORDS.need(n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(self.hashes * up[:n], out=sums[1:])
        return mixed(_ranges(sums, lo, hi, down) + (hi - lo).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray, hashed: bool = True, folded: bool = False) -> Words:
    """data: UTF-8 bytes; offsets: where each document starts, with one more at the end (from 0)."""
    n = len(data)
    inside = _WORD[data]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    out = Words(data, starts, ends, first)
    if hashed:
        up, down = _BYTES.need(n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((_BYTE_FOLDED if folded else _BYTE)[data] * up[:n], out=sums[1:])
        out.hashes = mixed(_ranges(sums, starts, ends, down) + (ends - starts).astype(_U))
    return out


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES, most: int = 1 << 13) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about size bytes, most documents at most: (first row, end row, bytes, offsets from 0). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n, lo + most)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes, equal for equal ones wherever they stand."""
    n = len(data)
    up, down = _BYTES.need(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mixed(_ranges(sums, starts, ends, down) + (ends - starts).astype(_U))
