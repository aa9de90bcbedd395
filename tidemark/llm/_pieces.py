"""Token ids of space-separated pieces, looked up once per distinct piece and gathered for whole documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of distinct pieces and their ids kept in a worker; beyond that the table starts anew, which costs time, not results.
TABLE_BYTES = 80 << 20
#: What an entry takes beside its text and ids: the string's head, its place, a slot of the index.
_ENTRY = 190
#: Pieces given to encode at once.
_AT_ONCE = 1 << 15


class PieceTable:
    """encode: list of pieces -> (ids of all of them in a row, number of ids of each). most: bytes of the table between two calls."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = TABLE_BYTES) -> None:
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _add(self, new: list[str]) -> None:
        flat, sizes = self.encode(new)
        n = len(self.index)
        at = int(self.starts[n])
        if at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(len(flat), at) + (1 << 16), np.int32)])
        if n + len(new) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(new) + 1, len(self.starts)), np.int64)])
        self.ids[at : at + len(flat)] = flat
        self.starts[n + 1 : n + 1 + len(new)] = at + np.cumsum(sizes)
        self.index.update(zip(new, range(n, n + len(new)), strict=True))
        self.used += sum(map(len, new)) + _ENTRY * len(new) + 4 * len(flat)

    def gather(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        if self.used > self.most:
            self._clear()
        new = list(set(pieces).difference(self.index))
        for k in range(0, len(new), _AT_ONCE):
            self._add(new[k : k + _AT_ONCE])
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        lo = self.starts[at]
        sizes = self.starts[at + 1] - lo
        return picked(self.ids, lo, sizes), sizes


    def gather_array(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As gather, for an Arrow array of strings: only its distinct pieces become Python strings."""
        if self.used > self.most:
            self._clear()
        coded = pieces.dictionary_encode()
        distinct = strings(coded.dictionary)
        at = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        at[missing] = len(self.index) + np.arange(len(missing))
        for k in range(0, len(missing), _AT_ONCE):
            self._add([distinct[i] for i in missing[k : k + _AT_ONCE].tolist()])
        at = at[coded.indices.to_numpy()]
        lo = self.starts[at]
        sizes = self.starts[at + 1] - lo
        return picked(self.ids, lo, sizes), sizes


def strings(x: pa.Array) -> list[str]:
    """to_pylist of an array without nulls, by one string cut at line ends where no element holds one."""
    if not len(x) or x.nbytes > 1 << 30:
        return x.to_pylist()
    lists = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(pa.string()))
    out = pc.binary_join(lists, "\n")[0].as_py().split("\n")
    return out if len(out) == len(x) else x.to_pylist()


def picked(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ids from starts on, in a row."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum())), sizes


def row_slices(texts: list[str], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows with about size characters."""
    return length_slices(list(map(len, texts)), size)


def length_slices(lengths: list[int], size: int) -> Iterator[tuple[int, int]]:
    lo = used = 0
    for i, n in enumerate(lengths):
        if used and used + n > size:
            yield lo, i
            lo, used = i, 0
        used += n
    if lo < len(lengths):
        yield lo, len(lengths)


def id_lists(texts: list[str], cut: Callable[[str], list[str]], known: PieceTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: (ids of all their texts, number of ids of each text). cut: text -> its pieces."""
    for lo, hi in row_slices(texts):
        cuts = [cut(t) for t in texts[lo:hi]]
        ids, sizes = known.gather([p for c in cuts for p in c])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        of = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)
        yield ids, np.diff(ends[of])


def list_array(ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
