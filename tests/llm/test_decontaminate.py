import random
import re

import numpy as np

from tidemark.llm import decontaminate as dc


def flat(t):
    return b" ".join(x for x in (t or "").encode().lower().split())


def least(pattern, text):
    """Least edits between pattern and any stretch of text."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    x = np.frombuffer(text, np.uint8)
    k = np.arange(len(text) + 1)
    for c in pattern:
        new = np.minimum(row + 1, np.concatenate([[1 << 30], row[:-1] + (x != c)]))
        row = np.minimum.accumulate(new - k) + k
    return int(row.min())


def brute(items, text):
    out = {}
    x = flat(text)
    for item, t in items:
        y = flat(t)
        if len(y) < dc.Q:
            if y and re.search(rb"(?<![a-z0-9\x80-\xff])" + re.escape(y) + rb"(?![a-z0-9\x80-\xff])", x) is not None:
                out[item] = 0
            continue
        last = max(0, len(y) - dc.WINDOW)
        for lo in sorted({*range(0, last, dc.WINDOW // 2), last}):
            w = y[lo : lo + dc.WINDOW]
            e = min(len(w) * dc.EDIT_PERCENT // 100, (len(w) - dc.Q) // dc.Q)
            if (d := least(w, x)) <= e:
                out[item] = min(d, out.get(item, d))
    return out


def edited(r, t, n):
    t = list(t)
    for _ in range(n):
        i = r.randrange(len(t))
        r.choice([lambda: t.insert(i, "z"), lambda: t.pop(i), lambda: t.__setitem__(i, "q")])()
    return "".join(t)


def test_equals_brute_force(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("aeiotnsr") for _ in range(r.randrange(1, 8))) for _ in range(n))
    items = [(i, prose(r.randrange(6, 60)).capitalize()) for i in range(12)] + [(90, "short one"), (91, ""), (92, None), (93, "ox"), (94, "Éa, 7"), (95, "twelve bytes"), (96, "a little more than that"), (None, "no id")]
    rows = [None, "", " \n ", prose(3000), items[0][1], items[1][1].upper().replace(" ", "\n\t ")]
    rows += ["a SHORT\n one.", "shorts one", "oxen foxes", "an ox", "ox", "vÉa, 7", "x Éa,  7", "some twelve bytes here", "a litle more than that", "a little morex than that, ox"]
    for k in range(90):
        base = items[k % 12][1]
        rows.append(prose(r.randrange(0, 40)) + " " + edited(r, base, r.randrange(0, 1 + len(base) // 9)) + " " + prose(r.randrange(0, 40)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(4, rows[4], "x")], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(docs, bench).collect()
    assert len(got) == len(rows) + 1
    hits = 0
    for g in got:
        want = brute(items, rows[g.doc_id])
        assert {m.item_id: m.edits for m in g.matches} == want, g
        hits += bool(want)
    assert 20 < hits < len(rows)
    clean = {g.doc_id for g in got if not g.matches}
    assert sorted(x.doc_id for x in dc.drop_contaminated(docs, bench).collect()) == sorted(clean)
    assert dc.drop_contaminated(docs, bench).columns == docs.columns


def test_blocks_and_empty_tables(spark, monkeypatch):
    items = [(i, f"item number {i} " + "wxyz" * 20 + str(i * 7919)) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [len(b) for b in dc.blocks(bench, size=250)] == [2, 2, 1]
    monkeypatch.setattr(dc.blocks, "__defaults__", ("item_id", "text", 250))
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items)), (2, "clean")], "doc_id long, text string")
    got = {g.doc_id: [m.item_id for m in g.matches] for g in dc.contamination(docs, bench).collect()}
    assert got[1] == [0, 1, 2, 3, 4] and got[2] == []
    # an item over a block's size is cut; what stands across a cut is found
    long = "".join(chr(97 + (i * i + i // 7) % 26) + " " * (i % 6 == 0) for i in range(1200))
    bench = spark.createDataFrame([(7, long)], "item_id long, text string")
    assert len(list(dc.blocks(bench))) > 3
    docs = spark.createDataFrame([(i, f"pre {long[i * 90 : i * 90 + 260]} post") for i in range(12)], "doc_id long, text string")
    assert [[m.item_id for m in g.matches] for g in dc.contamination(docs, bench).collect()] == [[7]] * 12
    assert dc.drop_contaminated(docs, bench).count() == 0
    assert [g.matches for g in dc.contamination(docs.limit(2), bench.limit(0)).collect()] == [[], []]
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_repetitive_texts_within_bounded_memory():
    import tracemalloc

    index = dc.Index([(1, "a" * 400), (2, "ab" * 90), (3, "a" * 400)])
    raw = np.frombuffer(b"a" * 500_000 + b" " + b"abcab" * 100_000, np.uint8)
    tracemalloc.start()
    got = index.matches(*dc.folded(raw, np.array([0, len(raw)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 1, 0, 120), (0, 3, 0, 120)]
    assert peak < 500 << 20


def test_repetitive_texts_as_brute_force(monkeypatch):
    monkeypatch.setattr(dc, "PAIRS", 500)
    r = random.Random(9)
    items = [(0, "a" * 300), (1, "ab" * 130), (2, "abc" * 50 + "d" * 60), (3, "a" * 119), (4, "xy" * 8)]
    index = dc.Index(items)
    texts = ["".join(r.choice(("a" * 40, "ab" * 25, "abc" * 20, "d" * 30, "b", "xy" * 5, " ")) for _ in range(r.randrange(1, 12))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got: dict[int, dict] = {i: {} for i in range(len(texts))}
    for d, item, edits, _ in index.matches(*dc.folded(data, offsets)):
        got[d][item] = edits
    assert [got[i] for i in range(len(texts))] == [brute(items, t) for t in texts]


def test_segments_of_long_texts(monkeypatch):
    r = random.Random(3)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    items = [(i, prose(200)) for i in range(5)] + [(9, "b cd a")]
    text = "".join(prose(r.randrange(300, 900)) + edited(r, items[k % 5][1], r.randrange(8)) for k in range(30)) + " b cd a"
    index, raw = dc.Index(items), np.frombuffer(text.encode(), np.uint8)
    whole = index.matches(*dc.folded(raw, np.array([0, len(raw)])))
    for size in (130, 1000, 1777):
        monkeypatch.setattr(dc, "SEGMENT", size)
        assert [m[:3] for m in index.matches(*dc.folded(raw, np.array([0, len(raw)])))] == [m[:3] for m in whole]
    assert {i: e for _, i, e, _ in whole} == brute(items, text)


def test_repeated_rows(spark):
    text = "some words before it " + "the passage of a benchmark that is quoted here in full, and more " * 2
    docs = spark.createDataFrame([(1, text), (1, text), (1, "clean"), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, text[21:]), (5, text[21:]), (6, text[21:])], "item_id long, text string")
    got = sorted([str(g.doc_id), [m.item_id for m in g.matches]] for g in dc.contamination(docs, bench).collect())
    assert got == [["1", []], ["1", [5, 6]], ["1", [5, 6]], ["None", [5, 6]]]
