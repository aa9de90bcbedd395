"""Benchmark passages in documents, found by shared q-grams in diagonal bands.

Texts are compared with A-Z lower-cased and runs of white space as one space, as UTF-8 bytes. A
benchmark item is cut into windows of WINDOW bytes that overlap by half; a document is
contaminated if it holds a stretch within the edit budget of some window, EDIT_PERCENT of its
length.

An occurrence with at most e edits keeps at least (m - Q + 1) - Q * e of the m - Q + 1 q-grams of
its window, on diagonals at most e apart. Shared q-grams are counted by document, window and
band of 2 * (e + 1) diagonals, bands overlapping by half, so one band holds them all. Bands that
meet the bound are verified by banded alignment. No window that meets the
budget is lost; a passage that holds no whole window is.

An item shorter than a q-gram has no budget for edits and is looked for verbatim, between
characters that are neither letters nor digits; its place is found by a hash of its whole length.

Equal windows are one, with the items that hold them. Shared q-grams are counted for a slice of
positions at a time, and bands that no later position can add to are settled behind it; equal
stretches are aligned once. So repetitive texts take time, not memory. Texts of more than SEGMENT
bytes are searched in segments that overlap by more than a window with its edits.

The benchmark is held in blocks of BLOCK_BYTES of text at most; a larger one is more passes over
the documents, each with one block, written in between, and a longer item is cut into blocks that
overlap by a window. Workers build the index of a block, so tasks carry its text alone. Empty or
null items, and items without an id, are no evidence and are skipped. Null and empty documents
match nothing, very long ones are searched whole, repeated rows are judged each, extra columns are
left alone, empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import ready, stored, table
from tidemark.llm._words import chunks, mixed

NAME = "op7_decontaminate"
Q, WINDOW, EDIT_PERCENT, BLOCK_BYTES = 12, 120, 6, 1 << 21
SEGMENT, PAIRS = 1 << 22, 1 << 21
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_BITS = 22


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as they are compared, and where each document then starts."""
    x = _FOLD[data]
    space = x == 32
    keep = np.ones(len(x), dtype=bool)
    if len(x):
        keep[1:] = ~(space[1:] & space[:-1])
        keep[offsets[(offsets > 0) & (offsets < len(x))]] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams(x: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each position on, as far as there are so many."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.ascontiguousarray(x)
    eight = np.ndarray((len(x) - 7,), dtype="<u8", buffer=x.data, strides=(1,)).copy()
    return mixed(eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[Q - 8 : Q - 8 + n])


_PART = np.ones(256, dtype=bool)
_PART[:128] = [chr(i).isalnum() for i in range(128)]


def pieces(x: np.ndarray, n: int) -> np.ndarray:
    """A number for the n bytes (fewer than Q) from each position on; up to 8 bytes it is their own."""
    count = len(x) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([x, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(x) + 8,), dtype="<u8", buffer=padded.data, strides=(1,)).copy()
    if n <= 8:
        return eight[:count] & np.uint64((1 << 8 * n) - 1)
    return mixed(eight[:count] * np.uint64(0x9E3779B97F4A7C15) ^ eight[n - 8 : n - 8 + count])


class Index:
    """Windows of some benchmark items and their q-grams; items shorter than a q-gram by length."""

    def __init__(self, items: Iterable[tuple[int, str]], edit_percent: int = EDIT_PERCENT) -> None:
        self.short: dict[int, dict[bytes, list[int]]] = {}
        of: dict[bytes, list[int]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            x = folded(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if len(x) < Q:
                if x:
                    self.short.setdefault(len(x), {}).setdefault(x, []).append(item)
                continue
            last = max(0, len(x) - WINDOW)
            for lo in sorted({*range(0, last, WINDOW // 2), last}):
                have = of.setdefault(x[lo : lo + WINDOW], [])
                if not have or have[-1] != item:
                    have.append(item)
        self.windows, self.items = list(of), list(of.values())
        self.size = np.array([len(w) for w in self.windows], dtype=np.int64)
        # a budget that leaves the bound at one shared q-gram at least
        self.budget = np.minimum(self.size * edit_percent // 100, (self.size - Q) // Q)
        self.bound = self.size - Q + 1 - Q * self.budget
        each = [grams(np.frombuffer(w, np.uint8)) for w in self.windows]
        keys = np.concatenate(each) if each else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(each)), [len(g) for g in each]).astype(np.int64) if each else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in each]) if each else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.window, self.place = window[order].astype(np.int32), place[order].astype(np.int32)
        self.short_keys = {n: np.unique([int(pieces(np.frombuffer(t, np.uint8), n)[0]) for t in ts]).astype(np.uint64) for n, ts in self.short.items()}
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def matches(self, x: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, end in the compared text) of each confirmed band, the best by document and item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, item, edits, end in self._short(x, offsets):
            best[doc, item] = min(best.get((doc, item), (edits, end)), (edits, end))
        if len(x) <= SEGMENT:
            self._banded(x, offsets, np.arange(len(offsets) - 1), offsets[:-1], best)
        else:
            for d in range(len(offsets) - 1):
                lo, hi = int(offsets[d]), int(offsets[d + 1])
                for at in range(lo, max(lo + 1, hi), SEGMENT):
                    part = x[at : min(hi, at + SEGMENT + 2 * WINDOW)]
                    self._banded(part, np.array([0, len(part)]), np.array([d]), np.array([lo - at]), best)
        return sorted((d, item, edits, end) for (d, item), (edits, end) in best.items())

    def _short(self, x: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Items shorter than a q-gram, at their first place in a document."""
        edge = np.ones(len(x) + 1, dtype=bool)  # a word may end before this byte
        if self.short and len(x):
            part = _PART[x]
            edge[1:-1] = ~(part[1:] & part[:-1])
            edge[offsets] = True
        for n, keys in self.short_keys.items():
            seen = set()
            for lo in range(0, len(x), SEGMENT):
                at = lo + np.flatnonzero(np.isin(pieces(x[lo : lo + SEGMENT + n - 1], n), keys))
                at = at[edge[at] & edge[at + n]]
                doc = np.searchsorted(offsets, at, "right") - 1
                for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                    if i + n > offsets[d + 1]:
                        continue
                    for item in self.short[n].get(x[i : i + n].tobytes(), ()):
                        if (d, item) not in seen:
                            seen.add((d, item))
                            yield d, item, 0, int(i + n - offsets[d])

    def _banded(self, x: np.ndarray, offsets: np.ndarray, docs: np.ndarray, origin: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds to best what the documents of x hold; docs: their numbers, origin: where in x they begin."""
        g = grams(x)
        if not len(self.keys) or not len(g):
            return
        at = np.flatnonzero(self.filter[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        ok = self.keys[k] == g[at]
        at, k = at[ok], k[ok]
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[doc + 1]
        at, k, doc = at[inside], k[inside], doc[inside]
        n = self.first[k + 1] - self.first[k]
        before = np.concatenate([[0], np.cumsum(n)])
        open_keys, open_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS, "right")) - 1)
            keys, counts = self._counted(at[lo:hi], k[lo:hi], doc[lo:hi])
            keys, which = np.unique(np.concatenate([open_keys, keys]), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([open_counts, counts])).astype(np.int64)
            window, band = keys >> 44, keys & ((1 << 30) - 1)
            # diagonals from the next position on: at - place + WINDOW, place below WINDOW
            still = (band + 1) * (self.budget[window] + 1) > (at[hi] if hi < len(at) else 1 << 40)
            open_keys, open_counts = keys[still], counts[still]
            self._settled(x, offsets, keys[~still & (counts >= self.bound[window])], docs, origin, best)
            lo = hi

    def _counted(self, at: np.ndarray, k: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams of some positions by window, document and band."""
        n = self.first[k + 1] - self.first[k]
        entry = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, doc, window = np.repeat(at, n), np.repeat(doc, n), self.window[entry].astype(np.int64)
        diagonal = at - self.place[entry] + WINDOW  # from 0 on
        band = diagonal // (self.budget[window] + 1)
        key = (window << 44) | (doc << 30) | band  # below 2**19, 2**14 and 2**30
        # bands b and b - 1 both hold the diagonals of step b; one may be at the edge
        return np.unique(np.concatenate([key + 1, key]), return_counts=True)

    def _settled(self, x: np.ndarray, offsets: np.ndarray, keys: np.ndarray, docs: np.ndarray, origin: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        if not len(keys):
            return
        window, doc, band = keys >> 44, (keys >> 30) & ((1 << 14) - 1), (keys & ((1 << 30) - 1)) - 1
        low = band * (self.budget[window] + 1) - WINDOW
        self._verified(x, offsets, window, doc, low, docs, origin, best)

    def _verified(self, x: np.ndarray, offsets: np.ndarray, window: np.ndarray, doc: np.ndarray, low: np.ndarray, docs: np.ndarray, origin: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        def take(i: int, edits: int, end: int) -> None:
            for item in self.items[window[i]]:
                k = (int(docs[doc[i]]), item)
                best[k] = min(best.get(k, (edits, end)), (edits, end))

        left: dict[tuple, list[int]] = {}  # equal stretches of text against a window
        for i in np.lexsort((low, doc)).tolist():
            w, d, at = int(window[i]), int(doc[i]), int(low[i])
            lo, hi, size, budget = int(offsets[d]), int(offsets[d + 1]), int(self.size[w]), int(self.budget[w])
            first = max(lo, at)
            known = [best.get((int(docs[d]), item)) for item in self.items[w]]
            if all(b is not None and b[0] == 0 and b[1] <= first + size - origin[d] for b in known):
                continue  # nothing better ends so early
            region = x[first : min(hi, at + size + 3 * budget + 2)].tobytes()
            if (p := region.find(self.windows[w])) >= 0:
                take(i, 0, int(first + p + size - origin[d]))
            else:
                around = x[max(lo, at - budget) : min(hi, at + size + 4 * budget + 2)].tobytes()
                left.setdefault((w, around, at - max(lo, at - budget), at + size + 4 * budget + 2 > hi), []).append(i)
        heads = [rows[0] for rows in left.values()]
        groups = list(left.values())
        for m, e in {(int(self.size[window[i]]), int(self.budget[window[i]])) for i in heads}:
            some = [g for g, i in enumerate(heads) if (self.size[window[i]], self.budget[window[i]]) == (m, e)]
            for s in range(0, len(some), 2000):
                part = np.array([heads[g] for g in some[s : s + 2000]])
                pattern = np.frombuffer(b"".join(self.windows[w] for w in window[part]), np.uint8).reshape(-1, m)
                edits, end = banded(x, pattern, low[part] - e, offsets[doc[part]], offsets[doc[part] + 1], 2 * (e + 1) + 2 * e, e)
                for g, head, d, z in zip(some[s : s + 2000], part.tolist(), edits.tolist(), end.tolist(), strict=True):
                    if d <= e:
                        for i in groups[g]:
                            take(i, d, int(z + low[i] - low[head] - origin[doc[i]]))


def banded(x: np.ndarray, pattern: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each pattern and any stretch of the text whose path stays on diagonals low .. low + width - 1, with where the stretch ends."""
    count, m = pattern.shape
    far = np.int32(budget + 1 + m)
    k = np.arange(width)
    at = low[:, None] + k  # text position before which row 0 stands
    cost = np.where((at >= start[:, None]) & (at <= end[:, None]), 0, far).astype(np.int32)
    for i in range(m):
        j = at + i
        real = (j >= start[:, None]) & (j < end[:, None])
        same = real & (x[np.clip(j, 0, len(x) - 1)] == pattern[:, i : i + 1])
        new = np.where(real, cost + ~same, far)  # both move on
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a byte of the pattern is left out
        new[(at + i + 1 < start[:, None]) | (at + i + 1 > end[:, None])] = far
        cost = np.minimum.accumulate(new - k, axis=1) + k  # a byte of the text is left out
        cost = np.where((at + i + 1 < start[:, None]) | (at + i + 1 > end[:, None]), far, cost).astype(np.int32)
    best = cost.argmin(axis=1)
    return cost[np.arange(count), best], low + best + m


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size; one block is on the driver at a time. A longer item is cut, its parts overlap by a window of characters."""
    held: list[tuple[int, str]] = []
    used = 0
    step = max(1, size // 4)  # characters of a part, four bytes each at most
    for item, text in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).toLocalIterator():
        for lo in range(0, max(1, len(text)), step) if len(text.encode()) > size else (0,):
            part = text[lo : lo + step + 2 * WINDOW] if len(text.encode()) > size else text
            n = len(part.encode())
            if held and used + n > size:
                yield held
                held, used = [], 0
            held.append((item, part))
            used += n
    yield held


_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("end", pa.int64())]))
_MATCH_SQL = "array<struct<item_id:bigint,edits:int,end:bigint>>"


@lru_cache(maxsize=1)
def index_of(block: tuple[tuple[int, str], ...], edit_percent: int) -> Index:
    """A worker's index of the block at hand."""
    return Index(block, edit_percent)


def _found(index: Index, texts: pa.Array) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for lo, _, data, offsets in chunks(texts, 1 << 19):
        for doc, item, edits, end in index.matches(*folded(data, offsets)):
            out[lo + doc].append({"item_id": item, "edits": edits, "end": end})
    return out


def _best(old: list[dict], new: list[dict]) -> list[dict]:
    """Of matches with one item, as parts of it give them, the one with the fewest edits."""
    out = {m["item_id"]: m for m in old}
    for m in new:
        before = out.get(m["item_id"])
        if before is None or (m["edits"], m["end"]) < (before["edits"], before["end"]):
            out[m["item_id"]] = m
    return list(out.values())


def contamination(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, matches array<struct<item_id, edits, end>> in the order of items; no match, clean."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.expr(f"cast(array() as {_MATCH_SQL})").alias("matches"))
    for i, block in enumerate(blocks(benchmark)):
        if i:
            rows = stored(rows, "matches")
        rows = rows.mapInArrow(_search(tuple(block), edit_percent), f"doc_id {kind}, text string, matches {_MATCH_SQL}")
    return rows.select("doc_id", F.array_sort("matches").alias("matches"))


def _search(block: tuple[tuple[int, str], ...], edit_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(block, edit_percent)
        for b in batches:
            found = _found(index, b.column(1))
            if any(found):
                old = b.column(2).to_pylist()
                matches = pa.array([_best(o, f) for o, f in zip(old, found, strict=True)], _MATCH)
            else:
                matches = b.column(2).cast(_MATCH)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), matches], names=["doc_id", "text", "matches"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark passage, with all their columns."""
    ready(docs.sparkSession)
    where = docs.columns.index(text_col)

    def keep(block: tuple[tuple[int, str], ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(block, edit_percent)
            for b in batches:
                yield b.filter(pa.array([not f for f in _found(index, b.column(where))], pa.bool_()))

        return run

    for i, block in enumerate(blocks(benchmark)):
        if i:
            docs = stored(docs, "clean")
        docs = docs.mapInArrow(keep(tuple(block)), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_items"),
        F.transform("matches", lambda m: m["item_id"]).alias("item_ids"),
        F.array_min(F.transform("matches", lambda m: m["edits"])).alias("fewest_edits"),
    )
