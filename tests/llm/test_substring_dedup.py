import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import substring_dedup as sd


def brute(texts, window):
    ws = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window,gram,group", [(6, 3, 1000), (6, 3, 1), (6, 3, 4), (5, 5, 2), (35, 8, 3)])
def test_equals_brute_force(spark, window, gram, group):
    r = random.Random(window * 7 + group)
    word = lambda: r.choice("abcdefgh") * r.randrange(1, 4)
    passages = [[word() for _ in range(window + r.randrange(0, 9))] for _ in range(4)]
    texts = [None, "", "  \n", "a", " ".join(["same"] * 100), " ".join(passages[0]), " ".join(passages[0])]
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(0, 6)):
            p = list(r.choice(passages)) if r.random() < 0.5 else [word() for _ in range(r.randrange(1, 40))]
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "X"
            parts += p
        texts.append(r.choice([" ", "\n", " \t "]).join(parts))
    texts += [texts[-1]] * 5
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in sd.remove_repeats(docs, window, gram, group).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x " + text)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_words, x.n_removed, x.kept_text) for x in sd.remove_repeats(docs).collect())
    assert got == [(0, 41, 40, "x"), (1, 40, 40, ""), (1, 40, 40, "")]
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}-{k}" for k in range(50))) for i in range(9)], "doc_id long, text string")
    got = sd.remove_repeats(docs)
    assert [x.n_removed for x in got.collect()] == [50] * 9
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert any("ReusedExchange" in line and "text" in line for line in plan.splitlines())


def test_words_of_any_length(spark):
    long = [c * n for c in "ab" for n in (15, 16, 17, 18, 40)]
    r = random.Random(5)
    passage = [r.choice(long) for _ in range(12)]
    texts = [" ".join(r.choice(long) for _ in range(30)) for _ in range(20)] + [" ".join(["x"] + passage + ["y"]), " ".join(["z"] + passage), " ".join(passage[:5] + ["a" * 19] + passage[6:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (1, 1000):
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in sd.remove_repeats(docs, 6, 3, group).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 6)


def test_trees_are_built_for_a_bounded_number_of_bytes():
    r = random.Random(8)
    rows, n = [], 12000  # 6 MB of contexts, two equal ones in every group of three
    for g in range(n // 3):
        a, b = (" ".join(str(r.randrange(10**12, 10**13)) for _ in range(35)).encode() + b" " for _ in range(2))
        rows += [(g, 0, 1, 3 * g + k, 7, 0, 0, 0, c) for k, c in enumerate((a, b, a))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), sd._ROUTED)], schema=sd._ROUTED)
    parts = [batch.slice(at, 1000) for at in range(0, n, 1000)]
    tracemalloc.start()
    got = [x for b in sd.stretches(iter(parts), 35) for x in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sorted(x["key1"] for x in got) == [i for i in range(n) if i % 3 != 1]
    assert {(x["low"], x["high"]) for x in got} == {(0, 35)}
    assert most < 150, most
