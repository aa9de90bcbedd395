"""Token ids on disk as directly addressable codes.

Ids are those of the tokenizers library without special tokens around a text; the content of an
added token within a text becomes that token, as the library has it.

An id is split into 8-bit chunks, low ones first. Level k holds the k-th chunk of every id that
has one, a bitmap that says which ids go on, and a rank directory, the number of set bits before
every RANK_BITS-th bit. The place of an id in the next level is the rank of its bit, so any id is
read without decoding the ones before it, and a run of ids is a run in every level.

A file is a table of segments, each with whole documents in ascending id order: its partition and
number, the ids of the partition before it, the documents' ids and lengths, and the coded ids. Segments hold about SEGMENT_IDS ids,
or one longer document, whatever its length. Null and empty texts are documents of the end id alone. Rows that repeat
an id stay next to each other, ordered by text, each a document; null ids come first. Other
columns are left alone; an empty table gives a file without segments.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._pieces import TABLE_BYTES, PieceTable, flattened, length_slices, picked
from tidemark.llm._runtime import partitions, ready, shared_dir, table

NAME = "op9_token_file"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID, SEGMENT_IDS, RANK_BITS = 1, 1 << 18, 512
_MAGIC = b"DAC8"


def _directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each RANK_BITS-th bit of a packed bitmap."""
    padded = np.zeros(-(-max(len(bits), 1) * 8 // RANK_BITS) * RANK_BITS // 8, dtype=np.uint8)
    padded[: len(bits)] = bits
    each = np.bitwise_count(padded.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(axis=1)
    return np.concatenate([[0], np.cumsum(each)[:-1]]).astype(np.uint32)


def encode_ids(ids: np.ndarray) -> bytes:
    """Header, then by level: chunks, bitmap, rank directory."""
    rest = ids.astype(np.uint32)
    sizes, parts = [], []
    while len(rest) or not sizes:
        more = rest >> np.uint32(8)
        on = more > 0
        bits = np.packbits(on)
        sizes.append(len(rest))
        parts += [(rest & np.uint32(255)).astype(np.uint8).tobytes(), bits.tobytes(), _directory(bits).tobytes()]
        rest = more[on]
    return _MAGIC + struct.pack(f"<I{len(sizes)}Q", len(sizes), *sizes) + b"".join(parts)


class TokenReader:
    """Random access to encoded ids."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != _MAGIC:
            raise ValueError("not a token segment")
        (n,) = struct.unpack_from("<I", raw, 4)
        sizes = struct.unpack_from(f"<{n}Q", raw, 8)
        at = 8 + 8 * n
        self.levels = []
        for size in sizes:
            packed = -(-size // 8)
            blocks = -(-max(packed, 1) * 8 // RANK_BITS)
            chunk = np.frombuffer(raw, np.uint8, size, at)
            bits = np.frombuffer(raw, np.uint8, packed, at + size)
            ranks = np.frombuffer(raw, np.uint32, blocks, at + size + packed)
            at += size + packed + 4 * blocks
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i: the directory and less than one of its blocks."""
        if i >= len(bits) * 8:
            i = len(bits) * 8
        block = min(i // RANK_BITS, len(ranks) - 1)
        lo = block * RANK_BITS // 8
        whole = int(np.bitwise_count(bits[lo : i // 8]).sum())
        part = int(bits[i // 8] >> (8 - i % 8)).bit_count() if i % 8 else 0
        return int(ranks[block]) + whole + part

    def get(self, i: int) -> int:
        out = shift = 0
        for chunk, bits, ranks in self.levels:
            out |= int(chunk[i]) << shift
            if not (bits[i // 8] >> (7 - i % 8)) & 1:
                return out
            i, shift = self._rank(bits, ranks, i), shift + 8
        raise ValueError("a bitmap goes on past the last level")

    def slice(self, lo: int, hi: int) -> np.ndarray:
        out = np.zeros(hi - lo, dtype=np.uint32)
        at = np.arange(hi - lo)
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            if hi <= lo:
                break
            out[at] |= chunk[lo:hi].astype(np.uint32) << np.uint32(8 * k)
            on = np.unpackbits(bits[lo // 8 : -(-hi // 8)])[lo % 8 : lo % 8 + hi - lo].astype(bool)
            at = at[on]
            lo, hi = self._rank(bits, ranks, lo), self._rank(bits, ranks, hi)
        return out


#: A piece of Latin letters and marks behind them: two words of their own for the tokenizer, whatever stands around.
_MARKS = ".,;:!?%$#&*|"
_SIMPLE = rf"\A[A-Za-zÀ-ÖØ-öø-ÿ]*[{_MARKS}]*\z"
#: Bytes of texts taken at once.
_SLICE = 1 << 22


#: How a tokenizer must treat a text for its words to be encoded one by one, as this module cuts them.
_PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PLAIN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PLAIN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
#: What that step writes for bytes that it does not leave as they are.
_BYTES = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


#: Added tokens are found in a text as it is, whatever stands around them.
_PLAIN_ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def cuts_words(path: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space, splits words as _SIMPLE expects and marks their ends; its added tokens are no words."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    model = told.get("model") or {}
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("continuing_subword_prefix")
    plain = plain and all(a["content"].startswith("<") and _PLAIN_ADDED.items() <= a.items() for a in told.get("added_tokens") or [])
    plain = plain and len(splits) == 2 and _PLAIN_BYTES.items() <= splits[1].items()
    return plain and told.get("normalizer") == _PLAIN_NORMALIZER and splits[0] == _PLAIN_SPLIT


class Encoder:
    """The tokenizer's model over distinct words of Latin letters or marks, which are lower-cased and cut as the tokenizer does; the tokenizer itself over other pieces. Tokenizers of other kinds get whole texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = cuts_words(path)
        self.contents = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, self.contents)) + ")") if self.contents else None
        self.words = PieceTable(self._encode_words)
        # pieces are words with the marks behind them, of which there are more
        self.pieces = PieceTable(self._encode_pieces if self.by_word else self._encode_texts, 2 * TABLE_BYTES if self.by_word else 0)

    def cut(self, text: str) -> list[str]:
        """Pieces that nothing is matched across; an added token is one of its own."""
        if not text:
            return []
        if not self.by_word:
            return [text]
        if "<" in text and self.added and self.added.search(text):
            parts = self.added.split(text)
            return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else part.replace("\n", " ").split(" "))]
        return text.replace("\n", " ").split(" ")

    def _encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize = self.tokenizer.model.tokenize
        return flattened([[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))] for w in words])

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        given = pa.array(pieces, pa.string())
        odd = ~pc.match_substring_regex(given, _SIMPLE).to_numpy(zero_copy_only=False)
        simple = given.filter(pa.array(~odd))
        letters = pc.utf8_rtrim(simple, characters=_MARKS)
        marks = pc.replace_substring_regex(simple, f"^[^{_MARKS}]+", "")
        # a word and its marks stand one after the other; empty ones have no ids
        known, each = self.words.gather_array(pa.concat_arrays([pc.utf8_lower(letters), marks]))
        n = len(simple)
        begin = np.cumsum(each) - each
        both = np.stack([begin[:n], begin[n:]], axis=1).ravel(), np.stack([each[:n], each[n:]], axis=1).ravel()
        known = picked(known, *both)
        starts, sizes = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        sizes[~odd] = each[:n] + each[n:]
        starts[~odd] = np.cumsum(sizes[~odd]) - sizes[~odd]
        rest, more = flattened([e.ids for e in self.tokenizer.encode_batch_fast(given.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)])
        starts[odd], sizes[odd] = len(known) + np.cumsum(more) - more, more
        return picked(np.concatenate([known, rest]), starts, sizes), sizes

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows: (ids of all their texts, number of ids of each text). Null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        for lo, hi in length_slices(pc.binary_length(texts).to_pylist(), _SLICE):
            part = texts.slice(lo, hi - lo)
            if self.by_word and not any(pc.any(pc.match_substring(part, x)).as_py() for x in self.contents):
                cuts = pc.split_pattern(pc.replace_substring(part, "\n", " "), " ")
                many, pieces = pc.list_value_length(cuts).to_numpy(), cuts.flatten()
            else:
                lists = [self.cut(t) for t in part.to_pylist()]
                many, pieces = np.fromiter(map(len, lists), np.int64, len(lists)), pa.array([p for x in lists for p in x], pa.large_string())
            ids, sizes = self.pieces.gather_array(pieces)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield ids, np.diff(ends[np.concatenate([[0], np.cumsum(many)])])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, each with end_id after it, in ascending order of id_col."""
    spark = ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(ids_type)), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
        held: list[np.ndarray] = []
        names: list = []
        lengths: list[int] = []
        before = total = 0

        def segment() -> pa.RecordBatch:
            nonlocal held, names, lengths, before, total, number
            out = pa.RecordBatch.from_pylist([{"part": part, "number": number, "before": before, "n_ids": total, "doc_ids": names, "lengths": lengths, "payload": encode_ids(np.concatenate(held))}], schema=schema)
            held, names, lengths, before, total, number = [], [], [], before + total, 0, number + 1
            return out

        for b in batches:
            doc_ids, at = b.column(0).to_pylist(), 0
            for ids, sizes in coder.encode(b.column(1)):
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                lo = 0
                for n in (sizes + 1).tolist():
                    held.append(ids[lo : lo + n])
                    names.append(doc_ids[at])
                    lengths.append(n)
                    lo, at, total = lo + n, at + 1, total + n
                    if total >= SEGMENT_IDS:
                        yield segment()
        if names:
            yield segment()

    from pyspark.sql.pandas.types import to_arrow_type

    ids_type = to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, f"part int, number int, before long, n_ids long, doc_ids array<{kind}>, lengths array<long>, payload binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and token_ids."""
    ready(spark)
    segments = spark.read.parquet(path)
    # one row per partition of the file, a number that the writer fixed
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                base, payload = b.column(0)[k].as_py(), b.column(3)[k].as_py()
                lengths = b.column(2)[k].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                ids = TokenReader(payload).slice(0, int(ends[-1])).astype("<u4")
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(1)[k].values, pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), lists], names=["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, token_ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path).drop("token_ids")
