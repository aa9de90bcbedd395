"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link, the node of the longest suffix of its
string that is left when the greedy longest matches before it are cut off, and the number of
tokens cut off on the way. A word is read once, character by character: where the trie has no
edge, the count of the node is added and the link followed. No piece is ever built.

Words are ``[^\\x20\\x09-\\x0D]+``; each gets the vocabulary's word-start mark in front. A word that
the vocabulary cannot spell is one unknown token. Null and empty texts have no words and no
tokens; words and texts of any length are read whole, in time in proportion to their length. Repeated rows are counted each; other columns are left alone; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._pieces import row_slices
from tidemark.llm._runtime import ready, table

NAME = "op1_token_counts"
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
MOST_WORDS = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NONE = -1


class LongestMatch:
    """Automaton over a set of pieces."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.edges: dict[int, int] = {}
        ends = [False]
        order: list[tuple[int, int, int]] = []  # node, parent, character
        for p in sorted(set(pieces)):
            u = 0
            for ch in map(ord, p):
                k = (u << 21) | ch
                if (v := self.edges.get(k)) is None:
                    v = self.edges[k] = len(ends)
                    ends.append(False)
                    order.append((v, u, ch))
                u = v
            ends[u] = u > 0
        depth = [0] * len(ends)
        for v, u, _ in order:
            depth[v] = depth[u] + 1
        self.link = [_NONE] * len(ends)
        self.popped = [0] * len(ends)
        edges, link, popped = self.edges, self.link, self.popped
        for v, u, ch in sorted(order, key=lambda x: depth[x[0]]):
            if ends[v]:
                link[v], popped[v] = 0, 1
                continue
            z, n = link[u], popped[u]
            while z != _NONE and ((z << 21) | ch) not in edges:
                n += popped[z]
                z = link[z]
            if z != _NONE:
                link[v], popped[v] = edges[(z << 21) | ch], n

    def count(self, word: str) -> int:
        """Tokens of the greedy longest match; 0 if there is none."""
        edges, link, popped = self.edges, self.link, self.popped
        u = n = 0
        for ch in map(ord, word):
            while (v := edges.get((u << 21) | ch)) is None:
                n += popped[u]
                u = link[u]
                if u == _NONE:
                    return 0
            u = v
        while u:
            n += popped[u]
            u = link[u]
            if u == _NONE:
                return 0
        return n


@cache
def load_pieces(path: str) -> tuple[str, ...]:
    """Ordinary pieces of a sentencepiece model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))


@cache
def automaton(path: str) -> LongestMatch:
    return LongestMatch(load_pieces(path))


def token_counts(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens, n_unknown."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        known: dict[str, int] = {}
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            out = np.zeros((3, len(texts)), dtype=np.int64)
            for lo, hi in row_slices(texts):
                for i in range(lo, hi):
                    words = _WORD.findall(texts[i])
                    if len(known) > MOST_WORDS:
                        known.clear()
                    for w in set(words):
                        if w not in known:
                            known[w] = auto.count(MARK + w)
                    counts = list(map(known.__getitem__, words))
                    unknown = counts.count(0)
                    out[:, i] = len(words), sum(counts) + unknown, unknown
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
