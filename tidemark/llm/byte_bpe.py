"""Byte-level BPE encoding and decoding by replaying merges over a block's distinct words.

A block's distinct words stand in one line of byte tokens. An index inverted by token pair holds
the positions of every pair that can merge; the pair of the lowest rank is merged at all of its
positions, and only the neighbours of a merged position get new index entries. Words do not
touch each other, so each ends as if it were encoded alone. A word that is a token itself is
taken whole.

Null texts count as empty and give no ids. Repeated rows are encoded each. Texts of any length
are first cut before spaces that follow other characters than white space, where no match of the
pattern goes across; what a worker keeps of pieces and words is bounded in bytes (TABLE_BYTES
each). Other columns are left alone; an empty table gives an empty result. The bytes a document's ids decode to are those of its text.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._pieces import PieceTable, id_lists, length_slices, list_array, picked
from tidemark.llm._runtime import ready, table

NAME = "op6_byte_bpe"
_GONE = -2
#: Where Arrow cuts texts, bytes of texts that it cuts at once, and ids that are decoded at once.
_MARK, _SLICE, _DECODED = "\0", 1 << 20, 1 << 18
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: White space as the pattern's library has it; Python's own classes also hold 0x1C-0x1F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = re.compile(rf"[{_SPACE}]{{2}}")
_ARROW_GAP = "[" + re.sub(r"\\u(....)", r"\\x{\1}", _SPACE) + "]{2}"
_AFTER_SPACE = re.compile(rf"[{_SPACE}]\Z")


def spelled_out(pattern: str) -> regex.Pattern:
    """The pattern with its white-space classes written out."""
    out = regex.sub(r"\[\^\\s", f"[^{_SPACE}".replace("\\", "\\\\"), pattern)
    return regex.compile(out.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _array(x: np.ndarray) -> array:
    """Four bytes a number instead of an object each."""
    return array("i", x.astype(np.int32).tobytes())


class MergeReplay:
    """Encodes lists of distinct byte words."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        #: Rank of the joined token by one part, then by the other, for every way to cut a token in two tokens.
        self.by_left: dict[int, dict[int, int]] = {}
        self.by_right: dict[int, dict[int, int]] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None:
                    self.by_left.setdefault(x, {})[y] = r
                    self.by_right.setdefault(y, {})[x] = r
        self.byte_pairs = np.array([[ranks.get(bytes([x, y]), -1) for y in range(256)] for x in range(256)], dtype=np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        ids, sizes = self.encode_flat(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if words else []

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        whole = np.fromiter(map(self.ranks.get, words, repeat(-1)), np.int64, len(words))
        rest = np.flatnonzero((whole < 0) & (lengths > 0))
        sizes = (whole >= 0).astype(np.int64)
        if not len(rest):
            return whole[whole >= 0].astype(np.int32), sizes
        data = np.frombuffer(b"".join([words[i] for i in rest.tolist()]), dtype=np.uint8)
        ends = np.cumsum(lengths[rest])
        starts = ends - lengths[rest]
        after = np.arange(1, len(data) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(data) - 1)
        before[starts] = -1
        found = np.full(len(data), -1, dtype=np.int64)
        found[:-1] = self.byte_pairs[data[:-1], data[1:]]
        found[ends - 1] = -1
        token = _array(self.of_byte[data])
        self._merge(token, _array(before), _array(after), _array(found), self._index(found))
        left = np.frombuffer(token, dtype=np.int32)
        stays = left != _GONE
        sizes[rest] = np.add.reduceat(stays.astype(np.int64), starts)
        first = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        merged = np.ones(len(out), dtype=bool)
        merged[first[whole >= 0]] = False
        out[first[whole >= 0]] = whole[whole >= 0]
        out[merged] = left[stays]
        return out, sizes

    @staticmethod
    def _index(found: np.ndarray) -> dict[int, array]:
        """Positions by the rank of the pair that starts there."""
        at = np.flatnonzero(found >= 0)
        at = at[np.argsort(found[at], kind="stable")]
        ranks, first = np.unique(found[at], return_index=True)
        return {r: _array(x) for r, x in zip(ranks.tolist(), np.split(at, first[1:]), strict=True)} if len(at) else {}

    def _merge(self, token: array, before: array, after: array, found: array, index: dict[int, array]) -> None:
        """found: rank of the pair that starts at each position, -1 if it can't merge; kept up to date. Merged-away positions get the token _GONE."""
        none: dict[int, int] = {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if not places:
                continue
            places = sorted(places)
            next_to, behind = self.by_left.get(r, none).get, self.by_right.get(r, none).get
            for k, a in enumerate(places):
                if found[a] != r:
                    continue
                b = after[a]
                c, p = after[b], before[a]
                token[a], token[b], after[a], found[a], found[b] = r, _GONE, c, -1, -1
                lower = False
                if c >= 0:
                    before[c] = a
                    s = next_to(token[c])
                    if s is not None:
                        found[a] = s
                        if s in index:
                            index[s].append(a)
                        else:
                            index[s] = array("i", (a,))
                            heapq.heappush(heap, s)
                        lower = s < r
                if p >= 0:
                    s = behind(token[p])
                    if s is None:
                        found[p] = -1
                    else:
                        found[p] = s
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = array("i", (p,))
                            heapq.heappush(heap, s)
                        lower |= s < r
                if lower:  # the new pair comes first; the rest of this one waits
                    index.setdefault(r, array("i")).extend(places[k + 1 :])
                    heapq.heappush(heap, r)
                    break


@cache
def spelling(path: str) -> list[bytes]:
    """Bytes of each id."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        out[r] = t
    return out


@cache
def _letters(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids in a row, where each id's begin, and how many they are."""
    tokens = spelling(path)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def decoded(ids: np.ndarray, sizes: np.ndarray, path: str) -> pa.Array:
    """Bytes of each run of ids; sizes: ids of each run."""
    letters, starts, lengths = _letters(path)
    parts = [ids[at : at + _DECODED] for at in range(0, len(ids), _DECODED)]
    data = b"".join([picked(letters, starts[x], lengths[x]).tobytes() for x in parts])
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


class Codec:
    """Texts to ids for a rank file and a splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.replay = MergeReplay(load_ranks(path))
        self.pattern = spelled_out(pattern)
        self.known = PieceTable(self._encode_pieces)
        self.words = PieceTable(self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.replay.encode_flat([w.encode() for w in words])

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cuts = [self.pattern.findall(p) for p in pieces]
        ids, sizes = self.words.gather([w for c in cuts for w in c])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)])

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces that the pattern never matches across: before each space that follows something else than white space."""
        if not text:
            return []
        head, *rest = text.split(" ")
        if not _GAP.search(text):
            return ([head] if head else []) + [" " + p for p in rest]
        out = [head]
        for p in rest:
            if out[-1] and out[-1][-1] != " " and not _AFTER_SPACE.search(out[-1]):
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return id_lists(texts, self.cut, self.known)

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As encode, for an Arrow array of strings without nulls: cut and told apart by Arrow where no text holds the mark that it is cut at."""
        for lo, hi in length_slices(pc.binary_length(texts).to_pylist(), _SLICE):
            some = texts.slice(lo, hi - lo)
            if pc.any(pc.match_substring(some, _MARK)).as_py():
                yield from self.encode(some.to_pylist())
                continue
            marked = pc.replace_substring(some, " ", _MARK + " ")
            gaps = pc.match_substring_regex(some, _ARROW_GAP)
            if pc.any(gaps).as_py():
                marked = pc.replace_with_mask(marked, gaps, pa.array([_MARK.join(self.cut(t)) for t in some.filter(gaps).to_pylist()], marked.type))
            pieces = pc.split_pattern(marked, _MARK)
            ids, sizes = self.known.gather_array(pieces.flatten())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield ids, np.diff(ends[np.concatenate([[0], np.cumsum(pieces.value_lengths().to_numpy())]).astype(np.int64)])


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, decode_too: bool) -> DataFrame:
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            at = 0
            for ids, sizes in c.encode_array(b.column(1).fill_null("")):
                columns = {"doc_id": b.column(0).slice(at, len(sizes)), "token_ids": list_array([ids], [sizes])}
                if decode_too:
                    columns["decoded"] = decoded(ids, sizes, path)
                yield pa.RecordBatch.from_pydict(columns)
                at += len(sizes)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, token_ids array<int>" + ", decoded binary" * decode_too)


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, token_ids array<int>."""
    return _encoded(docs, path, pattern, id_col, text_col, False)


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, token_ids, decoded (the bytes of token_ids), as decode(encode(docs)) gives them, in one worker a task instead of two."""
    return _encoded(docs, path, pattern, id_col, text_col, True)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Adds decoded, the bytes of token_ids, to rows of encode()."""
    ready(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            out = decoded(lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, out], names=["doc_id", "token_ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, token_ids array<int>, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
