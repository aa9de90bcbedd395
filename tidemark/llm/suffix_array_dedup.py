"""Bytes that an earlier document has too, by suffix arrays with induced sorting.

A byte goes if a string of WINDOW bytes over it also starts in a document with a smaller id.

1. Every window has one anchor: of the GRAM-byte strings in it, the leftmost one with the least
   hash. Equal windows have equal anchors at equal places. About one byte in sixteen is an anchor;
   consecutive windows with the same one are its context, up to 2 * WINDOW - GRAM bytes.
2. Which anchors occur in two documents or more is asked for a block of a task's anchors at a time:
   for each range of hashes, 31 further bits of each anchor and its number in the block go to one
   place, and the numbers of the shared ones come back. Anchors equal by chance are found out later.
3. The contexts of shared anchors are dealt into shards by their anchor. A task sends equal contexts
   once, for the smallest id that has them, and marks them in the others.
4. A shard joins its distinct contexts into one text and builds its suffix array by induced sorting
   and the permuted common prefixes (_suffix_array). Suffixes that share WINDOW bytes follow each
   other; the smallest id among them owns the window, and every other document loses it. An anchor
   with one distinct context has no other suffix to be held against: what repeats there is the whole
   context, and all but its smallest id lose it.
5. An anchor with more than GROUP distinct contexts is dealt once more, by a longer string around
   it (WINDOW - PIECE + 1 bytes, in pieces of PIECE windows), and what is still too many by the whole
   window; such a group has one distinct context. So no shard grows with a frequent string.

Contexts are held equal by two 64-bit hashes, the suffixes of different ones by their bytes. A null
or empty text has no bytes and keeps none; texts of any length are read whole, in segments. Rows of
one id count as one document, whatever their texts; rows that repeat an id and a text get the same
result. Rows without an id come after all others and do not affect each other. Other columns are
left alone, an empty table gives an empty result. Ids are whole numbers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import delete, partitions, ready, table, written
from tidemark.llm._suffix_array import common_prefixes, suffix_array
from tidemark.llm._words import byte_hashes, chunks, mixed

NAME = "op13_suffix_array_dedup"
WINDOW, GRAM, GROUP, PIECE = 50, 20, 4096, 8
_BLOCK, _SEGMENT, _HELD, _SHARD, _SLICE = 1 << 19, 1 << 21, 1 << 18, 1 << 19, 1 << 14
_NO_ID = (1 << 63) - 1
_U = np.uint64
_PLACE = _U((1 << 22) - 1)


def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes (8 or more) from each position on."""
    n = len(x) - gram + 1
    x = np.ascontiguousarray(x)
    eight = np.ndarray((len(x) - 7,), dtype="<u8", buffer=x.data, strides=(1,))
    out = np.zeros(n, dtype=_U)
    for k in [*range(0, gram - 8, 8), gram - 8]:
        out ^= eight[k : k + n]
        out *= _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return mixed(out)


@dataclass
class Anchors:
    """doc; start: first byte of the context; size: its length; off: where the anchor is in it; hash. In order of position."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    off: np.ndarray
    hash: np.ndarray


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Anchors:
    """Contexts of some documents; start counts from the first byte of data. A document is cut into segments from its own start."""
    parts = []
    if len(data) <= _SEGMENT + window:
        parts.append(_anchors(data, offsets, window, gram))
    else:
        for d in range(len(offsets) - 1):
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            for at in range(lo, max(lo + 1, hi - window + 1), _SEGMENT):
                a = _anchors(data[at : min(hi, at + _SEGMENT + window - 1)], np.array([0, min(hi, at + _SEGMENT + window - 1) - at]), window, gram)
                a.doc += d
                a.start += at
                parts.append(a)
    return Anchors(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Anchors)))


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Anchors:
    if len(data) < window:
        z = np.zeros(0, np.int64)
        return Anchors(z, z.copy(), z.copy(), z.copy(), np.zeros(0, _U))
    g = _gram_hashes(data, gram)
    least = (g & ~_PLACE) | np.arange(len(g), dtype=_U)
    width, span = 1, window - gram + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least & _PLACE).astype(np.int64)  # by start of a window
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    inside = np.zeros(len(place) + 1, dtype=np.int8)  # starts whose window stays within its document
    long = np.diff(offsets) >= window
    inside[offsets[:-1][long]] = 1
    inside[np.minimum(offsets[1:][long] - window + 1, len(place))] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new[1:] |= inside[1:] & ~inside[:-1]
    new[offsets[:-1][offsets[:-1] < len(new)]] = True
    head = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.append(new | ~inside, True))
    tail = stop[np.searchsorted(stop, head, "right")]
    x = place[head]
    return Anchors(np.searchsorted(offsets, head, "right") - 1, head, tail - head + window - 1, x - head, g[x])


def _planes(x: np.ndarray) -> bytes:
    """Ascending numbers as bytes of equal weight, differences only, for the shuffle to compress."""
    return np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def _pack(*arrays: np.ndarray) -> bytes:
    return struct.pack(f"<{len(arrays)}Q", *(a.nbytes for a in arrays)) + b"".join(a.tobytes() for a in arrays)


def _unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(types)}Q", raw)
    out, at = [], 8 * len(types)
    for size, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
        at += size
    return out


def _rows(rows: list[tuple], *types: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f"c{k}" for k in range(len(types))])


# Which anchors are shared


class _Block:
    """Anchors of a task, numbered; members are runs of anchors of one document."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.parts, self.used = buckets, [], 0

    def add(self, hashes: np.ndarray, key1: np.ndarray, key2: np.ndarray, number: np.ndarray) -> Iterator[list[tuple]]:
        """By anchor: hash, document, number within the document."""
        for lo in range(0, len(hashes), _BLOCK):
            part = tuple(x[lo : lo + _BLOCK] for x in (hashes, key1, key2, number))
            if self.used + len(part[0]) > _BLOCK:
                yield self.flush()
            self.parts.append(part)
            self.used += len(part[0])

    def flush(self) -> list[tuple]:
        """Rows (bucket, block, numbers or members, hashes or repeats); members have a bucket below 0."""
        if not self.used:
            return []
        h, key1, key2, number = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.used = [], 0
        n = len(h)
        new = np.ones(n, dtype=bool)
        new[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1]) | (number[1:] != number[:-1] + 1)
        run, head = np.cumsum(new) - 1, np.flatnonzero(new)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        leader = first[which]
        several = np.zeros(n, dtype=bool)
        several[leader[run != run[leader]]] = True
        repeats = np.flatnonzero(leader != np.arange(n))
        members = _pack(key1[head], key2[head], number[head].astype("<i4"), np.diff(np.append(head, n)).astype("<i4"))
        block = int.from_bytes(_digest(members), "little", signed=True)
        bucket = ((h[first] >> _U(32)) % _U(self.buckets)).astype(np.int64)
        order = np.lexsort((first, bucket))
        first, bucket = first[order], bucket[order]
        code = (h[first].astype(np.uint32) & np.uint32(0xFFFFFFFE)) | several[first].astype(np.uint32)
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        out = [(int(bucket[lo]), block, _planes(first[lo:hi]), code[lo:hi].tobytes()) for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(first)], strict=True)]
        return [*out, (-1 - block % self.buckets, block, members, _pack(repeats.astype("<i4"), leader[repeats].astype("<i4")))]


def _digest(raw: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(raw, digest_size=8).digest()


_ASKED = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
_ASKED_SQL = "bucket int, block long, a binary, b binary"


def _asked(keyed: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(buckets)
        for b in batches:
            key1, key2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, data, offsets in chunks(b.column(2)):
                a = anchors(data, offsets, window, gram)
                count = np.bincount(a.doc, minlength=len(offsets) - 1)
                number = np.arange(len(a.doc)) - np.repeat(np.cumsum(count) - count, count)
                for rows in block.add(a.hash, key1[lo + a.doc], key2[lo + a.doc], number):
                    yield _rows(rows, *_ASKED)
        yield _rows(block.flush(), *_ASKED)

    return keyed.select("key1", "key2", "text").mapInArrow(run, _ASKED_SQL)


def _answered(asked: DataFrame) -> DataFrame:
    """Per block: its members, and the numbers of its anchors that another document has."""

    def answer(rows: list[tuple]) -> list[tuple]:
        numbers = [_from_planes(r[2]) for r in rows]
        code = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
        order = np.argsort(code >> np.uint32(1), kind="stable")
        c = code[order]
        new = np.ones(len(c), dtype=bool)
        new[1:] = c[1:] >> np.uint32(1) != c[:-1] >> np.uint32(1)
        which = np.cumsum(new) - 1
        count = np.bincount(which, weights=1 + (c & np.uint32(1)))
        shared = np.zeros(len(c), dtype=bool)
        shared[order] = count[which] > 1
        ends = np.cumsum([len(x) for x in numbers])
        return [(1, r[1], _planes(x[shared[e - len(x) : e]]), b"") for r, x, e in zip(rows, numbers, ends.tolist(), strict=True) if shared[e - len(x) : e].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] < 0:
                    out.append((0, *r[1:]))
                    continue
                if held and held[0][0] != r[0]:
                    out += answer(held)
                    held = []
                held.append(r)
            yield _rows(out, *_ASKED)
        if held:
            yield _rows(answer(held), *_ASKED)

    n = partitions(asked.sparkSession)
    return asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ASKED_SQL)


def _shared(answered: DataFrame) -> DataFrame:
    """Per document and run of its anchors: key1, key2, first, bits of the shared ones."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def told(members: tuple, numbers: list[bytes]) -> list[tuple]:
        key1, key2, first, count = _unpack(members[2], "<i8", "<i8", "<i4", "<i4")
        repeats, leader = _unpack(members[3], "<i4", "<i4")
        on = np.zeros(int(count.sum()), dtype=bool)
        for raw in numbers:
            on[_from_planes(raw)] = True
        on[repeats] = on[leader]
        ends = np.cumsum(count)
        total = np.append(0, np.cumsum(on))
        some = np.flatnonzero(total[ends] > total[ends - count])
        return [(int(key1[k]), int(key2[k]), int(first[k]), np.packbits(on[ends[k] - count[k] : ends[k]]).tobytes()) for k in some.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, numbers = None, []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if members is None or members[1] != r[1]:
                    out += told(members, numbers) if numbers else []
                    members, numbers = r, []
                elif r[0]:
                    numbers.append(r[2])
            yield _rows(out, *types)
        if numbers:
            yield _rows(told(members, numbers), *types)

    n = partitions(answered.sparkSession)
    return answered.repartition(n, "block").sortWithinPartitions("block", "bucket").mapInArrow(run, "key1 long, key2 long, first int, bits binary")


# Contexts


@dataclass
class Contexts:
    """Contexts with the document and the places (first bytes) that each row stands for."""

    key1: np.ndarray
    key2: np.ndarray
    off: np.ndarray
    size: np.ndarray
    count: np.ndarray
    places: np.ndarray
    data: np.ndarray

    @classmethod
    def joined(cls, parts: list[Contexts]) -> Contexts:
        return parts[0] if len(parts) == 1 else cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))

    def take(self, rows: np.ndarray) -> Contexts:
        return Contexts(self.key1[rows], self.key2[rows], self.off[rows], self.size[rows], self.count[rows], _runs(self.places, self.count, rows), _runs(self.data, self.size, rows))

    def packed(self) -> bytes:
        return _pack(self.key1, self.key2, self.off.astype(np.uint8), self.size.astype(np.uint8), self.count.astype("<i4"), self.places.astype("<i4"), self.data)

    @classmethod
    def unpacked(cls, raw: bytes) -> Contexts:
        a = _unpack(raw, "<i8", "<i8", "u1", "u1", "<i4", "<i4", "u1")
        return cls(a[0], a[1], *(x.astype(np.int64) for x in a[2:6]), a[6])

    def hashes(self, core: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the core bytes at off, and of the whole context."""
        ends = np.cumsum(self.size)
        starts = ends - self.size
        out = np.empty((2, len(ends)), dtype=_U)
        for lo in range(0, len(ends), _SLICE):
            base, some = starts[lo], slice(lo, lo + _SLICE)
            a, z = starts[some] - base, ends[some] - base
            at = a + self.off[some]
            out[:, some] = byte_hashes(self.data[base : base + z[-1]], np.concatenate([at, a]), np.concatenate([at + core, z])).reshape(2, -1)
        return out


def _runs(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of some of consecutive runs."""
    starts = np.cumsum(sizes) - sizes
    parts = [values[:0]]
    for lo in range(0, len(rows), _SLICE):
        r = rows[lo : lo + _SLICE]
        n = sizes[r]
        parts.append(values[np.repeat(starts[r] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return np.concatenate(parts)


def _marks(key1: np.ndarray, key2: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> list[tuple]:
    """Rows (bucket below 0, key1, key2, stretches of bytes that go), stretches of a document joined where they meet."""
    if not len(low):
        return []
    order = np.lexsort((low, key2, key1))
    key1, key2, low, high = key1[order], key2[order], low[order], high[order]
    doc = np.ones(len(low), dtype=bool)
    doc[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
    which = np.cumsum(doc) - 1
    top = int(high.max()) + 1
    reach = np.maximum.accumulate(which * top + high) - which * top  # the furthest end so far in the document
    new = doc.copy()
    new[1:] |= low[1:] > reach[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(low)) - 1
    spans = np.stack([low[head], reach[tail]], axis=1).astype("<i8")
    edge = np.flatnonzero(doc[head])
    at = head[edge].tolist()
    return [(-1 - key1[i].item() % buckets, key1[i].item(), key2[i].item(), spans[lo:hi].tobytes()) for i, lo, hi in zip(at, edge.tolist(), [*edge[1:].tolist(), len(head)], strict=True)]


def _spread_places(c: Contexts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the rows' places."""
    return np.repeat(rows, c.count[rows]), _runs(c.places, c.count, rows)


def _reduced(c: Contexts, core: int, buckets: int) -> tuple[Contexts, np.ndarray, np.ndarray, list[tuple]]:
    """Equal contexts once for the smallest id: the rows that stay (one for each of its texts), hash of the core and number of the distinct context of each, and marks for the others."""
    group, whole = c.hashes(core)
    order = np.lexsort((c.key2, c.key1, whole, group))
    g, w, k1, k2 = group[order], whole[order], c.key1[order], c.key2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    which = np.cumsum(new) - 1
    later = k1 > k1[np.flatnonzero(new)][which]
    rows, at = _spread_places(c, order[later])
    marks = _marks(c.key1[rows], c.key2[rows], at, at + c.size[rows], buckets)
    stays = order[~later]
    which, k2 = which[~later], k2[~later]
    head = np.ones(len(stays), dtype=bool)
    head[1:] = (which[1:] != which[:-1]) | (k2[1:] != k2[:-1])
    kept = c.take(stays[head])
    if not head.all():  # places of a document that a task has met more than once, each once
        row = np.repeat(np.cumsum(head) - 1, c.count[stays])
        place = _runs(c.places, c.count, stays)
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        fresh = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]))
        kept.places, kept.count = place[fresh], np.bincount(row[fresh])
    return kept, g[~later][head], which[head], marks


def _dealt(c: Contexts, group: np.ndarray, buckets: int) -> list[tuple]:
    """Rows (bucket, -, -, contexts)."""
    bucket = (mixed(group) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edge = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    return [(int(b[lo]), None, None, c.take(order[lo:hi]).packed()) for lo, hi in zip(edge, [*edge[1:], len(b)], strict=True)]


_SENT = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
_SENT_SQL = "bucket int, key1 long, key2 long, data binary"


def _sent(joined: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """Contexts of shared anchors, dealt by anchor, and marks. joined: key1, key2, text, runs array<struct<first, bits>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Contexts] = []
        used = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, used
            if held:
                kept, group, _, marks = _reduced(Contexts.joined(held), gram, buckets)
                yield _rows(marks + _dealt(kept, group, buckets), *_SENT)
            held, used = [], 0

        for b in batches:
            key1, key2, runs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for lo, hi, data, offsets in chunks(b.column(2)):
                a = anchors(data, offsets, window, gram)
                first = np.searchsorted(a.doc, np.arange(hi - lo + 1))
                on = np.zeros(len(a.doc), dtype=bool)
                for i in range(lo, hi):
                    for r in runs[i].as_py():
                        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
                        at = first[i - lo] + r["first"]
                        bits = bits[: first[i - lo + 1] - at]
                        on[at : at + len(bits)] |= bits
                at = np.flatnonzero(on)
                for some in np.split(at, range(_HELD, len(at), _HELD)):
                    doc, start, size = a.doc[some], a.start[some], a.size[some]
                    text = data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    held.append(Contexts(key1[lo + doc], key2[lo + doc], a.off[some], size, np.ones(len(some), np.int64), start - offsets[doc], text))
                    used += len(some)
                    if used >= _HELD:
                        yield from flush()
        yield from flush()

    return joined.select("key1", "key2", "text", "runs").mapInArrow(run, _SENT_SQL)


# Shards


def owners(data: np.ndarray, size: np.ndarray, key: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """By window of the joined contexts: its context, and the smallest key among the contexts that have it. data: the contexts' bytes; size, key: by context."""
    n = len(size)
    ends = np.cumsum(size + 1)
    s = np.ones(len(data) + n + 1, dtype=np.uint16)  # 1 ends a context, 0 the text
    s[-1] = 0
    inside = np.ones(len(s), dtype=bool)
    inside[ends - 1] = inside[-1] = False
    s[inside] = data.astype(np.uint16) + np.uint16(2)
    context = np.append(np.repeat(np.arange(n), size + 1), n)
    left = np.append(ends, len(s))[context] - 1 - np.arange(len(s))
    fresh = np.zeros(len(s), dtype=bool)
    fresh[ends] = True
    order = suffix_array(s)
    shared = common_prefixes(s, order, left, fresh)
    new = shared[order] < window
    new[0] = True
    head = np.flatnonzero(new)
    of = np.append(key, _NO_ID)[context]
    of[left < window] = _NO_ID
    least = np.minimum.reduceat(of[order], head)
    owner = np.empty(len(s), dtype=np.int64)
    owner[order] = least[np.cumsum(new) - 1]
    is_window = left >= window
    return context[is_window], owner[is_window]


def _pieces(c: Contexts, window: int, piece: int) -> Contexts:
    """Each context cut into its pieces of windows; off is then where the bytes begin that all windows of a piece have."""
    total = c.size - window + 1
    row = np.repeat(np.arange(len(total)), total)
    at = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)  # start of a window within its context
    before = c.off[row] - at  # bytes before the anchor
    k = before // piece
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(row)))
    r, start, size = row[head], at[head], n + window - 1
    base = (np.cumsum(c.size) - c.size)[r] + start
    data = c.data[np.repeat(base - np.cumsum(size) + size, size) + np.arange(size.sum())]
    count = c.count[r]
    places = _runs(c.places, c.count, r) + np.repeat(start, count)
    return Contexts(c.key1[r], c.key2[r], before[head] - k[head] * piece, size, count, places, data)


def _sharded(sent: DataFrame, window: int, core: int, piece: int, group: int, buckets: int) -> DataFrame:
    """Marks, and contexts of anchors that go on in pieces."""

    def hot_of(g: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Rows whose group has too many distinct contexts. g and which ascend together."""
        if core >= window or not len(g):
            return np.zeros(len(g), dtype=bool)
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        of = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        return (which[np.append(head[1:], len(g)) - 1] - which[head] >= group)[of]

    def onward(c: Contexts) -> list[tuple]:
        p = _pieces(c, window, piece)
        kept, g, _, marks = _reduced(p, window - piece + 1, buckets)
        return marks + _dealt(kept, g, buckets)

    def sorted_out(c: Contexts, g: np.ndarray, which: np.ndarray) -> Iterator[list[tuple]]:
        """Marks by suffix arrays over whole groups of distinct contexts."""
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        edge = np.append(np.flatnonzero(new), len(g))
        several = which[edge[1:] - 1] > which[edge[:-1]]
        some = np.flatnonzero(np.repeat(several, np.diff(edge)))
        if not len(some):
            return
        bytes_before = np.cumsum(c.size[some]) - c.size[some]
        shard = bytes_before // _SHARD
        start = np.append(True, g[some][1:] != g[some][:-1])  # a group stays in the shard of its first row
        shard = shard[np.maximum.accumulate(np.where(start, np.arange(len(some)), 0))]
        for rows in np.split(some, np.flatnonzero(shard[1:] != shard[:-1]) + 1):
            w = which[rows]
            first = np.append(True, w[1:] != w[:-1])
            distinct = rows[first]
            d = c.take(distinct)
            context, owner = owners(d.data, d.size, d.key1, window)
            lost = owner < d.key1[context]
            at = np.arange(len(lost)) - np.searchsorted(context, context)
            edge_on = lost & ~np.append(False, lost[:-1] & (context[1:] == context[:-1]))
            edge_off = lost & ~np.append(lost[1:] & (context[1:] == context[:-1]), False)
            of, low, high = context[edge_on], at[edge_on], at[edge_off] + window
            row_of = np.cumsum(first) - 1  # distinct context of each row
            by = np.bincount(of, minlength=len(distinct))
            n = by[row_of]
            take = np.repeat((np.cumsum(by) - by)[row_of] - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = np.repeat(rows, n)
            count = c.count[row]
            place = _runs(c.places, c.count, row)
            yield _marks(np.repeat(c.key1[row], count), np.repeat(c.key2[row], count), place + np.repeat(low[take], count), place + np.repeat(high[take], count), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Contexts] = []
        used, limit, bucket = 0, 2 * _HELD, None
        hot: np.ndarray = np.zeros(0, _U)

        def reduce(done: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, used, limit, hot
            c, g, which, marks = _reduced(Contexts.joined(held), core, buckets)
            many = hot_of(g, which) | np.isin(g, hot)
            if many.any():
                hot = np.union1d(hot, g[many])
                at = np.flatnonzero(many)
                for lo in range(0, len(at), 1 << 15):
                    marks += onward(c.take(at[lo : lo + (1 << 15)]))
                rest = np.flatnonzero(~many)
                c, g, which = c.take(rest), g[rest], which[rest]
            yield _rows(marks, *_SENT)
            if done:
                for marks in sorted_out(c, g, which):
                    yield _rows(marks, *_SENT)
                held, used, limit, hot = [], 0, 2 * _HELD, np.zeros(0, _U)
            else:
                held, used = [c], len(c.key1)
                limit = max(limit, 2 * used)

        for b in batches:
            passed = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] < 0:
                    passed.append(r)
                    continue
                if r[0] != bucket and held:
                    yield from reduce(True)
                bucket = r[0]
                held.append(Contexts.unpacked(r[3]))
                used += len(held[-1].key1) + len(held[-1].places) // 16
                if used >= limit:
                    yield from reduce(False)
            if passed:
                yield _rows(passed, *_SENT)
        if held:
            yield from reduce(True)

    return sent.repartition(partitions(sent.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, _SENT_SQL)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept (the bytes that stay)."""
    if not 8 <= gram <= window - piece + 1 <= window or not 1 <= piece or window > 128:
        raise ValueError("8 <= gram, gram + piece <= window + 1, window <= 128")
    spark = ready(docs.sparkSession)
    buckets = partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = d.withColumns({"key1": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "key2": F.xxhash64("text")})
    shared = _shared(_answered(_asked(keyed, window, gram, buckets)))
    by_doc, by_doc_path = written(shared.groupBy("key1", "key2").agg(F.collect_list(F.struct("first", "bits")).alias("runs")), "anchors")
    joined = keyed.select("key1", "key2", "text").join(by_doc.hint("shuffle_hash"), ["key1", "key2"])
    done, path = written(_sharded(_sent(joined, window, gram, buckets), window, gram, piece, group, buckets), "shards")
    delete(spark, by_doc_path)
    marks = done.where("bucket < 0")
    for core, finer in ((window - piece + 1, 1), (window, 1)):
        more = done.where("bucket >= 0")
        if more.isEmpty():
            break
        done, path = written(_sharded(more, window, core, finer, group, buckets), "shards")
        marks = marks.unionByName(done.where("bucket < 0"))
    by_doc = marks.groupBy("key1", "key2").agg(F.collect_list("data").alias("spans"))
    marked = keyed.join(by_doc.hint("shuffle_hash"), ["key1", "key2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode()
                if not spans:
                    rows.append((len(raw), 0, 0, raw))
                    continue
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                s = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in spans])
                np.add.at(edge, s[:, 0], 1)
                np.add.at(edge, s[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                n = int(gone.sum())
                rows.append((len(raw), n, int((gone & ~np.append(False, gone[:-1])).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            columns = _rows(rows, pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *columns.columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
