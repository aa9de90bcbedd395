import random
import zlib

import numpy as np

from tidemark.llm import token_file as tf


def test_codes_round_trip_and_random_access():
    r = random.Random(1)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = np.array([r.choice((0, 1, 255, 256, 49407, 65535, 65536, 2**24, 2**32 - 1, r.randrange(2**17))) for _ in range(n)], dtype=np.uint32)
        t = tf.TokenReader(tf.encode_ids(ids))
        assert len(t) == n and (t.slice(0, n) == ids).all()
        for _ in range(60):
            if n:
                i = r.randrange(n)
                assert t.get(i) == ids[i]
                j = r.randrange(i, n + 1)
                assert (t.slice(i, j) == ids[i:j]).all()


def test_file_equals_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.TOKENIZER)
    r = random.Random(2)
    texts = [None, "", " ", "A  b\n\nc ", "it's I'LL 12 x²", "<|endoftext|> q", "Σίσυφος ΣΑΣ", "é e ́ Å", "漢字かな 🙂", "\x85a　b\x1cc", "w" * 3000]
    texts += ["a <|endoftext|> b", "x<|startoftext|>y", "<|endoftext|>", " <|endoftext|>\n<|startoftext|> ", "q<|endoftext|><|endoftext|>Q", "<|EndOfText|>", "<|endoftext", "é<|endoftext|>\u0301 x", "<<|endoftext|>>"]
    texts += ["".join(r.choice("abcé \ń'1İΣ") for _ in range(r.randrange(80))) for _ in range(200)]
    texts += [" ".join(r.choice(("a", "<|endoftext|>", "<|", "|>", "B<|startoftext|>c")) for _ in range(r.randrange(9))) for _ in range(100)]
    rows = [(i * 3 % 1000, x, 5) for i, x in enumerate(texts)] + [(7, "same", 5), (7, "same", 5)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, start int"), f"{tmp_path}/f")
    got = tf.read_documents(spark, f"{tmp_path}/f").collect()
    want = []
    for d, x, _ in sorted(rows, key=lambda v: (v[0], v[1] or "")):
        want.append((d, t.encode(x or "", add_special_tokens=False).ids + [1]))
    start = 0
    got.sort(key=lambda v: v.start)
    assert [v.doc_id for v in got] == [d for d, _ in want]
    for v, (_, ids) in zip(got, want, strict=True):
        assert list(v.token_ids) == ids
        assert (v.start, v.n_tokens, v.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_small_segments_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT_IDS", 10)
    tf.write_tokens(spark.createDataFrame([(i, "a b c d") for i in range(40)], "doc_id long, text string"), f"{tmp_path}/g")
    got = sorted(tf.read_documents(spark, f"{tmp_path}/g").collect(), key=lambda v: v.doc_id)
    assert [v.start for v in got] == [5 * i for i in range(40)]
    tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert tf.read_documents(spark, f"{tmp_path}/e").count() == 0


def test_other_tokenizers_and_null_ids(spark, tmp_path):
    """A tokenizer that keeps case and white space gets whole texts; rows without an id come first."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tf.cuts_words(tf.TOKENIZER) and not tf.cuts_words(path)
    t = Tokenizer.from_file(path)
    rows = [(None, "No  Id"), (2, "Upper CASE\n\nhere  it's"), (1, "x <|endoftext|> " * 500), (None, None)]
    tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/h", tokenizer=path, end_id=9)
    got = sorted(tf.read_documents(spark, f"{tmp_path}/h").collect(), key=lambda v: v.start)
    assert [v.doc_id for v in got] == [None, None, 1, 2]
    assert [list(v.token_ids) for v in got] == [t.encode(x, add_special_tokens=False).ids + [9] for x in ("", "No  Id", "x <|endoftext|> " * 500, "Upper CASE\n\nhere  it's")]


def test_words_go_to_the_model_once():
    import pyarrow as pa
    from tokenizers import Tokenizer

    coder, t = tf.Encoder(tf.TOKENIZER), Tokenizer.from_file(tf.TOKENIZER)
    whole = []

    class Watched:
        model = t.model

        @staticmethod
        def encode_batch_fast(texts, **more):
            whole.extend(texts)
            return t.encode_batch_fast(texts, **more)

    coder.tokenizer = Watched
    texts = ["Word word, WORD. ÉTÉ; été\n\n$$$ |", None, "", "x²y Ünder!? ", "word " * 1000, "Straße ÿ.. a.b"]
    got = [list(x) for ids, sizes in coder.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert sorted(whole) == ["a.b", "x²y"]
    assert coder.words.index.keys() >= {"word", "$$$", ",", "|", "été"} and "Word" not in coder.words.index
    every = [c + m for c in map(chr, range(0x21, 0x250)) for m in ("", ".", "$|", "a")]
    got = [list(x) for ids, sizes in coder.encode(pa.array(every)) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in every]
    assert len(coder.pieces.index) >= len(every)
