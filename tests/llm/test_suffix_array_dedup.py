import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import suffix_array_dedup as sad


def plain(rows, window):
    """By all windows of all documents."""
    none = 1 << 63
    first = {}
    for i, t in rows:
        raw, key = (t or "").encode(), none if i is None else i
        for k in range(len(raw) - window + 1):
            w = raw[k : k + window]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, t in rows:
        raw, key = (t or "").encode(), none if i is None else i
        gone = [False] * len(raw)
        for k in range(len(raw) - window + 1):
            if first[raw[k : k + window]] < key:
                gone[k : k + window] = [True] * window
        spans = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        out.append((str(i), len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


def found(df, **kw):
    rows = sad.remove_repeated_bytes(df, **kw).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)


def passages(seed, docs, alphabet, window):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list(alphabet), n))
    shared = [word(int(n)) for n in rng.integers(window - 5, 4 * window, 12)]
    out = []
    for i in rng.permutation(docs).tolist():
        parts = []
        for _ in range(rng.integers(0, 6)):
            parts.append(word(int(rng.integers(0, 2 * window))))
            s = shared[rng.integers(len(shared))]
            lo = int(rng.integers(0, len(s) // 2))
            parts.append(s[lo : lo + int(rng.integers(1, len(s)))])
        out.append((i, "".join(parts)))
    return out + [(docs + k, out[k][1]) for k in range(5)]


def test_as_with_all_windows(spark):
    rows = passages(1, 150, "abcdefgh é", 50)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain(rows, 50)


@pytest.mark.parametrize("group", [1, 3])
def test_frequent_anchors_go_on_in_pieces_and_windows(spark, group, monkeypatch):
    monkeypatch.setattr(sad, "_SHARD", 200)
    rows = passages(2, 120, "abc", 18) + [(900 + k, f"{k:03d}" + "same middle of all" + f"{k % 7}xy{k % 5}" * 6) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, window=18, gram=8, piece=4, group=group) == plain(rows, 18)
    assert found(df, window=18, gram=8, piece=1, group=group) == plain(rows, 18)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=80), min_size=1, max_size=6), st.integers(0, 3))
def test_anchors_cover_each_window_once(texts, cut):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    a = sad.anchors(data, offsets, 12, 8)
    seen, of = [], {}
    for d, s, n, off, h in zip(a.doc.tolist(), a.start.tolist(), a.size.tolist(), a.off.tolist(), a.hash.tolist(), strict=True):
        assert offsets[d] <= s and s + n <= offsets[d + 1]
        for k in range(n - 11):
            seen.append(s + k)
            w = data[s + k : s + k + 12].tobytes()
            assert of.setdefault(w, (h, off - k)) == (h, off - k)  # equal windows, equal anchors at equal places
    assert sorted(seen) == [int(offsets[d]) + k for d in range(len(raw)) for k in range(max(0, len(raw[d]) - 11))]


def test_nulls_empty_long_repeats_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(sad, "_SEGMENT", 1000)
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh"), 30_000))
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "y" * 3000), (6, "y" * 2000 + "z" * 60), (6, "z" * 70), (7, "z" * 55), (7, "z" * 55), (8, long), (9, long[5000:9000] + "-" + long[100:149] + "-" + long[200:250]), (None, long[:400]), (None, "q" * 60), (None, "q" * 60), (-3, "z" * 52)]
    df = spark.createDataFrame([(*r, "a", 1, b"b") for r in rows], "doc_id long, text string, key1 string, bucket int, spans binary")
    got = sad.remove_repeated_bytes(df)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert found(df) == plain(rows, 50)


def test_texts_longer_than_a_run_of_documents(spark):
    text = "ab" * 700_000 + "the end of a very long text, which is not that of the other one"
    rows = [(1, text), (2, text[:-30])]
    got = found(spark.createDataFrame(rows, "doc_id int, text string"))
    assert [r[:4] for r in got] == [("1", len(text), 0, 0), ("2", len(text) - 30, len(text) - 30, 1)]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_removed_as_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert found(docs) == plain(rows, 50)
