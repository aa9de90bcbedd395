import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_decontaminate, test_near_dedup
from tidemark.llm import exact_dedup, quality_cnn


def corpus(n=160, seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiotnsrlm") for _ in range(r.randrange(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    items = [(i, prose(25)) for i in range(5)]
    rows, labels = [], []
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0:
            t, q = " ".join(f"{word()}%%% {word()}###" for _ in range(r.randrange(20, 80))), 0
        elif kind == 1:
            t, q = " ".join(w for w in (word() for _ in range(12)) for _ in range(14)), 0
        elif kind == 2 and rows:
            t, q = r.choice(rows)[1], None
        elif kind == 3:
            t, q = prose(60) + " " + r.choice(items)[1].lower() + " " + prose(30), 1
        else:
            t, q = prose(r.randrange(60, 200)), 1
        rows.append((i, t))
        if q is not None:
            labels.append((i, q, 0))
    rows += [(n, None), (n + 1, ""), (n + 2, rows[-1][1].upper()), (n + 3, rows[-1][1] + " more")]
    return rows, labels, items


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    d = str(tmp_path)
    full = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    full.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = full, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        assert docs.columns == full.columns
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
    good = {i: q for i, q, _ in labels}
    known = [i for i in good if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(i in kept["quality"]) == good[i] for i in known]) > 0.9
    first: dict = {}
    for i, t in sorted(kept["quality"].items()):
        first.setdefault((t or "").lower(), i)
    assert sorted(kept["exact"]) == sorted(first.values())
    ids = sorted(kept["exact"])
    groups = test_near_dedup.brute([kept["exact"][i] for i in ids], 5)
    assert sorted(kept["near"]) == [i for k, i in enumerate(ids) if groups[k][1] == k]
    assert sorted(kept["decontaminate"]) == sorted(i for i, t in kept["near"].items() if not test_decontaminate.brute(items, t))
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {x.doc_id: x for x in corpus_pipeline.run(spark, d).collect()}
    assert sorted(last) == sorted(kept["decontaminate"])
    for i, t in kept["decontaminate"].items():
        assert list(last[i].token_ids) == enc.encode_ordinary(t or "")
        assert last[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_exact_duplicates_and_collisions(spark):
    long = "lOng text " * 200_000
    rows = [(1, None), (2, ""), (3, "É a"), (4, "É A"), (5, "é a"), (6, "x"), (6, "x"), (None, "X"), (7, long), (8, long.upper()), (9, long + "x")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    for weak in (exact_dedup.md5_128, lambda x: F.unhex(F.lpad((F.octet_length(x) % 2).cast("string"), 32, "0"))):
        got = sorted((x.doc_id or 0, x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_duplicates(docs, keep="max", content_hash=weak).collect())
        assert got == [(0, 6, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 3, True), (6, 6, 3, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True)]
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns
    assert sorted(x.doc_id or 0 for x in exact_dedup.drop_duplicates(docs).collect()) == [0, 1, 3, 5, 6, 6, 7, 9]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def plain_score(m, text):
    """The network byte by byte, chunk by chunk."""
    w, block, half = m.w, quality_cnn.BLOCK, quality_cnn.WIDTH // 2
    at = lambda i: text[i] if 0 <= i < len(text) else 0
    pooled = np.full(quality_cnn.HIDDEN, -np.inf)
    for lo in range(0, max(1, len(text)), block):
        total, n = np.zeros(quality_cnn.FILTERS), 0
        for i in range(lo, min(len(text), lo + 2 * block)):
            if text[i]:
                total += np.maximum(0, w["tb"] + sum(w["t"][k][at(i - half + k)].astype(np.float64) for k in range(quality_cnn.WIDTH)))
                n += 1
        pooled = np.maximum(pooled, np.maximum(0, total / max(n, quality_cnn.LEAST) @ w["h"] + w["hb"]))
    return 1 / (1 + np.exp(-np.clip(pooled @ w["v"] + w["vb"], -30, 30)))[0]


def test_forward_pass_equals_a_plain_one(spark):
    r = np.random.default_rng(5)
    m = quality_cnn.Model(3)
    texts = ["", "a", "nul\0s in\0", "é漢 🙂" * 40, "x" * 64, "y" * 65, "long " * 4000, "repeated", "repeated", *("".join(map(chr, r.integers(32, 400, r.integers(1, 700)))) for _ in range(30))]
    want = [plain_score(m, t.encode()) for t in texts]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)] + [(len(texts), None, 0.0)], "doc_id long, text string, score double")
    got = {x.doc_id: x.score for x in quality_cnn.scores(docs, m).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-5)
    assert got[len(texts)] == got[0] and got[7] == got[8]
    assert quality_cnn.scores(docs.limit(0), m).count() == 0


def test_sample_is_bounded_in_rows_and_bytes(spark):
    big = "w" * (quality_cnn.SAMPLE_TEXT_BYTES + 1)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, big if i == ids[0] else f"text {i}") for i in ids] + [(ids[1], f"again {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    texts, _ = quality_cnn.training_rows(docs, labels, 10, "doc_id", "text")
    assert len(texts) <= 20 and max(map(len, texts)) <= quality_cnn.SAMPLE_TEXT_BYTES


def test_network_gradients_and_batches():
    r = np.random.default_rng(0)
    m = quality_cnn.Model()
    texts = [b"", b"a", b"hello there " * 20, bytes(r.integers(32, 126, 500).tolist()), b"xy" * 400]
    y = np.array([1, 0, 1, 0, 1], dtype=np.float32)
    w = np.ones(5, dtype=np.float32)
    for k in m.w:
        m.w[k] = m.w[k].astype(np.float64) + 0.05 * (k == "hb")  # off the kink at 0
    loss = lambda: -np.mean(y * np.log(s := m.forward(*quality_cnn._joined(texts))["score"]) + (1 - y) * np.log(1 - s))
    g = m.gradients(m.forward(*quality_cnn._joined(texts)), y, w)
    for k, at in (("v", (3,)), ("h", (2, 5)), ("hb", (4,)), ("t", (1, 104, 3)), ("tb", (2,)), ("vb", (0,))):
        old = m.w[k][at]
        m.w[k][at] = old + 1e-3
        up = loss()
        m.w[k][at] = old - 1e-3
        down = loss()
        m.w[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 5e-3, k
    one = [m.forward(*quality_cnn._joined([t]))["score"][0] for t in texts]
    assert np.allclose(one, m.forward(*quality_cnn._joined(texts))["score"], atol=1e-5)


def test_held_out_accuracy_and_missing_labels(spark):
    rows, labels, _ = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_cnn.quality(docs, known).collect()}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held)
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.9
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.score for x in quality_cnn.quality(docs, known.limit(0)).collect()} == {0.5}
