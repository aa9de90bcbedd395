import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import byte_bpe, token_counts

TEXTS = [
    None, "", " ", "  ", "   ", "a", "aaa aaaa aaaaaaaaa", "The the.\nNew  line\n\n\nthree   spaces \n end  ", "it's we'll I'D 12 345 6é7 x²",
    "tab\tand\x1cfs \x85 nel 　wide", "schön ñandú élève 漢字かな 🙂🙂 ‍", "<|endoftext|> <|x|>", "-" * 300, "ab" * 500, "\x00nul", "a\n \nb", "a \n\n b", "x" * 20000,
]


def texts():
    r = random.Random(3)
    abc = "abcdeéñ   \n\t'.0 1²漢" + "the of and "
    return TEXTS + ["".join(r.choice(abc) for _ in range(r.randrange(0, 120))) for _ in range(300)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, token_ids int")


def test_bpe_equals_tiktoken_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = texts()
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs(spark, rows))).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert list(got[i].token_ids) == enc.encode_ordinary(t or ""), (i, t)
        assert bytes(got[i].decoded) == (t or "").encode()


def test_bpe_round_trip_and_small_tables(spark, monkeypatch):
    rows = texts() * 2  # repeated rows
    a = byte_bpe.round_trip(docs(spark, rows)).orderBy("doc_id").collect()
    b = byte_bpe.decode(byte_bpe.encode(docs(spark, rows))).orderBy("doc_id").collect()
    assert a == b
    c = byte_bpe.Codec(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    c.known.most = c.words.most = 10  # cleared at every call
    for r in b:
        assert [x for ids, _ in c.encode([rows[r.doc_id] or ""]) for x in ids.tolist()] == r.token_ids
    assert c.known.index and c.known.used > 10


def test_bpe_cut_keeps_gaps_whole():
    cut = byte_bpe.Codec.cut
    for t in texts():
        assert "".join(cut(t or "")) == (t or "")
    assert cut("a  b   c\n d ") == ["a", "  b", "   c\n d", " "]
    assert len(cut("word " * 1000 + "   " + "word " * 1000)) > 1900


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_bpe_pieces_told_apart_by_arrow(monkeypatch, size):
    monkeypatch.setattr(byte_bpe, "_SLICE", size)
    monkeypatch.setattr(byte_bpe, "_DECODED", 7)
    c = byte_bpe.Codec(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    rows = [t or "" for t in texts()]
    want = [x.tolist() for t in rows for ids, sizes in c.encode([t]) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    c = byte_bpe.Codec(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    got, back = [], []
    for ids, sizes in c.encode_array(pa.array(["before", *rows]).slice(1)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        back += byte_bpe.decoded(ids, sizes, byte_bpe.VOCABULARY).to_pylist()
    assert got == want and back == [t.encode() for t in rows]
    # a text without gaps is not cut in Python, and a piece is looked up once however often it occurs
    monkeypatch.setattr(c, "cut", None)
    monkeypatch.setattr(c.known, "gather", None)
    ids, sizes = zip(*c.encode_array(pa.array(["so so so\nso so"] * 50)), strict=True)
    assert np.concatenate(sizes).tolist() == [len(np.concatenate(ids)) // 50] * 50


def test_bpe_flat_ids_of_words():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3, b"abab": 4}
    words = [b"aba", b"", b"abab", b"bbab", b"a", b"ababab", b"xab"]
    ids, sizes = byte_bpe.MergeReplay(ranks).encode_flat(words)
    assert sizes.tolist() == [1, 0, 1, 3, 1, 2, 2] and ids.tolist() == [3, 4, 1, 1, 2, 0, 4, 2, -1, 2]
    assert [x.tolist() for x in byte_bpe.MergeReplay(ranks).encode_flat([b"", b"aba"])] == [[3], [0, 1]]
    assert byte_bpe.MergeReplay(ranks).encode([]) == []


def test_bpe_lower_rank_after_merge():
    # joining b and c makes a pair of a lower rank than their own
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"bc": 4}
    assert byte_bpe.MergeReplay(ranks).encode([b"abcbc", b"abc", b"bcbcbc", b""]) == [[3, 4], [3], [4, 4, 4], []]


def test_bpe_query_columns(spark, tmp_path):
    docs(spark, ["a b", None]).drop("token_ids").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = byte_bpe.query(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert b.n_tokens == 0 and b.ids_sha256 == b.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert a.decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert byte_bpe.encode(docs(spark, [])).count() == 0


def greedy(pieces, word):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_longest_match_equals_greedy():
    r = random.Random(5)
    for _ in range(200):
        pieces = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 12))}
        auto = token_counts.LongestMatch(pieces)
        for _ in range(60):
            w = "".join(r.choice("abcd"[: r.choice((3, 3, 3, 4))]) for _ in range(r.randrange(1, 14)))
            assert auto.count(w) == greedy(pieces, w), (pieces, w)


def test_token_counts_on_documents(spark):
    pieces = set(token_counts.load_pieces(token_counts.VOCABULARY))
    rows = texts()
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, rows)).collect()}
    for i, t in enumerate(rows):
        words = token_counts._WORD.findall(t or "")
        if max(map(len, words), default=0) > 400:
            continue
        n = [greedy(pieces, token_counts.MARK + w) for w in words]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(words), sum(x or 1 for x in n), n.count(0)), t
    assert token_counts.token_counts(docs(spark, [])).count() == 0


def test_token_counts_of_long_words_and_repeated_rows(spark):
    pieces = set(token_counts.load_pieces(token_counts.VOCABULARY))
    rows = ["ab" * 3000, "same words", "same words", "x" * 100_000 + " y"]
    d = spark.createDataFrame([(1, t, 0) for t in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(d).collect())
    want = []
    for t in rows[:3]:
        n = [greedy({p for p in pieces if len(p) <= 20}, token_counts.MARK + w) for w in t.split()]
        want.append((len(n), sum(n), 0))
    assert got[:3] == sorted(want) or set(want) <= set(got)
    assert len(got) == 4 and max(got)[0] == 2


def test_intermediate_tables_are_cleared(spark):
    import os

    from tidemark.llm import _runtime

    kept = _runtime.stored(spark.range(3), "x")
    path = _runtime._WRITTEN[-1].removeprefix("file:")
    assert kept.count() == 3 and os.path.isdir(path)
    _runtime.clear(spark)
    assert not os.path.exists(path) and not _runtime._WRITTEN
