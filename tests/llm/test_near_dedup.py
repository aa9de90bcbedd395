import random

import pytest

from tidemark.llm import near_dedup as nd
from tidemark.llm.components import components


def brute(texts, k, percent=80):
    sets = []
    for t in texts:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,block", [(4, 1500), (5, 7)])
def test_equals_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(nd, "BLOCK_DOCS", block)
    r = random.Random(k)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 6)))
    texts = [None, "", " \n", "One", "one", "One two", "two one", "a b c d", "A b C d"]
    line = [word() for _ in range(12)]
    for _ in range(12):
        base = [word() for _ in range(r.randrange(10, 150))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(0, 12)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(copy) // 30)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else "\t".join(copy))
    texts += [" ".join(line + [word() for _ in range(r.randrange(1, 20))]) for _ in range(30)]
    texts += [texts[20]] * 10
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i], "x") for i in order], "doc_id long, text string, node string")
    got = {x.doc_id: x for x in nd.near_duplicates(docs, k).collect()}
    want = brute(texts, k)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(want)]


def test_null_ids_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(None, ""), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (2, "q")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in nd.near_duplicates(docs).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 2, 1)]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 200, 201: 200, 202: 200}


def test_rows_without_an_id_link_like_others(spark):
    w = [f"w{i}" for i in range(60)]
    t, near = " ".join(w), " ".join([*w[:-1], "x"])
    docs = spark.createDataFrame([(None, t), (5, t), (6, t), (7, near)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.component_id, x.kept) for x in nd.near_duplicates(docs).collect())
    assert got == [(0, 5, False), (5, 5, True), (6, 5, False), (7, 5, False)]
    v = [f"v{i}" for i in range(116)]
    one, middle, two = (" ".join(v[i : i + 100]) for i in (0, 8, 16))
    sets = brute([one, middle, two], 5)
    bridge = [(8, one), (None, middle), (None, middle), (9, two), (None, " ".join(v[::-1])), (None, "")]
    got = sorted((x.doc_id or 0, x.component_id or 0) for x in nd.near_duplicates(spark.createDataFrame(bridge, "doc_id long, text string")).collect())
    assert {c for _, c in sets} == {0} and brute([one, two], 5)[1][1] == 1
    assert got == [(0, 0), (0, 0), (0, 8), (0, 8), (8, 8), (9, 8)]
