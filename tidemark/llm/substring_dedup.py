"""Repeated word sequences, by prefix-partitioned suffix trees.

A window is WINDOW consecutive words of a document. Every window has one synchronising suffix:
of the suffixes that start in it with GRAM words inside, the one whose GRAM-word prefix has the
least hash. Equal windows choose equal suffixes at equal places, so repeats are found among
these suffixes alone, about one word in fourteen.

1. The GRAM-word prefixes of all chosen suffixes are counted; one that occurs once cannot belong
   to a repeat and goes.
2. The other suffixes are dealt out by prefix. The prefix is GRAM words long, or, where more than
   GROUP suffixes share it, as long as the whole window; so every group fits in memory. A task
   sends equal contexts once: if it has two of them itself, their windows are marked at once and
   the context travels without a place, so a passage in any number of documents is one small row
   per task. A context travels as text, words over LONG bytes as their hash: words' hashes would
   not be compressed.
3. Each group is built into a suffix tree over the words from the prefix on and one over the words
   before it, as sorted suffixes with common-prefix lengths. A window is repeated if the node at
   its right depth and the node at its left depth have another occurrence in common: a node deep
   enough to be a repeat of WINDOW words, extended to the left as far as it goes.
4. Words under a repeated window are removed. Texts are shuffled once, for steps 2 and 4, and
   their suffixes chosen anew in step 2, so that only a suffix's number goes through the count.

Words are compared by 64-bit hashes, whole windows of a long prefix by a 64-bit hash with that of
their prefix. Null and empty texts have no words, very long texts are read whole, texts of fewer than WINDOW words no windows.
Rows that repeat an id and a text count as documents each and get the same result. Extra columns
are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import partitions, ready, stored, table
from tidemark.llm._words import Words, chunks, words

NAME = "op2_substring_dedup"
WINDOW, GRAM, GROUP = 35, 8, 1000
_FLUSH_BYTES, _TREE_BYTES, LONG = 48 << 20, 1 << 20, 16
_U = np.uint64


def _sliding_least(g: np.ndarray, span: int) -> np.ndarray:
    """For each start of span neighbours the place of the leftmost least one, by doubling."""
    value, place, width = g, np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        n = len(value) - step
        later = value[step:] < value[:n]
        value = np.where(later, value[step:], value[:n])
        place = np.where(later, place[step:], place[:n])
        width += step
    return place


def chosen(w: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, word place within all words, prefix hash, least and greatest number of words before it) of each chosen suffix with its windows."""
    n = len(w.starts)
    none = (np.zeros(0, np.int64),) * 5
    if n < window:
        return none
    at = np.arange(n - gram + 1)
    g = w.spans(at, at + gram)
    place = _sliding_least(g, window - gram + 1)  # by window start
    end = np.repeat(w.first[1:], w.counts)
    start = np.flatnonzero(end[: len(place)] - np.arange(len(place)) >= window)
    if not len(start):
        return none
    place = place[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    x = place[head]
    return np.searchsorted(w.first, x, "right") - 1, x, g[x], x - start[tail], x - start[head]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.withColumns({"key1": F.xxhash64("doc_id"), "key2": F.xxhash64("text")})


def _suffixes(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, data, offsets in chunks(b.column(2)):
                doc, _, g, _, _ = chosen(words(data, offsets), window, gram)
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays([pa.array(k1[lo + doc]), pa.array(k2[lo + doc]), pa.array(g.view(np.int64)), pa.array(number.astype(np.int32))], names=["key1", "key2", "gram", "number"])

    return keyed.select("key1", "key2", "text").mapInArrow(run, "key1 long, key2 long, gram long, number int")


_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def squeezed(w: Words) -> tuple[bytes, np.ndarray]:
    """The words, a space behind each, and where each begins, with one more at the end; a word over LONG bytes as 0x01 and its hash, which no other word is."""
    long = np.flatnonzero(w.ends - w.starts > LONG)
    size = np.minimum(w.ends - w.starts, LONG + 1)
    edge = np.concatenate([[0], np.cumsum(size + 1)])
    if not len(size):
        return b"", edge
    out = w.data[np.minimum(np.repeat(w.starts - edge[:-1], size + 1) + np.arange(edge[-1]), len(w.data) - 1)]
    out[edge[1:] - 1] = 0x20
    if len(long):
        at, raw = edge[long], w.hashes[long].view(np.uint8).reshape(-1, 8)
        out[at] = 1
        for k in range(8):
            out[at + 1 + 2 * k], out[at + 2 + 2 * k] = _HEX[raw[:, k] >> 4], _HEX[raw[:, k] & 15]
    return out.tobytes(), edge


_ROUTED = pa.schema([("gram", pa.int64()), ("longer", pa.int64()), ("n", pa.int8()), ("key1", pa.int64()), ("key2", pa.int64()), ("pos", pa.int32()), ("least", pa.int16()), ("most", pa.int16()), ("context", pa.binary())])
_ROUTED_SQL = "gram long, longer long, n byte, key1 long, key2 long, pos int, least short, most short, context binary"


class _Sender:
    """Rows of one task: equal contexts once, with n 1 (and its place) or 2 (its places marked already); marks, joined by document, have n 0."""

    def __init__(self, window: int) -> None:
        self.window, self.held, self.marks, self.used = window, {}, {}, 0

    def add(self, route: tuple, place: tuple) -> None:
        """route: gram, longer, least, most, context; place: key1, key2, pos."""
        if route not in self.held:
            self.held[route] = place
            self.used += 200 + len(route[4] or b"")
            return
        first = self.held[route]
        if first is not None:
            self.held[route] = None
            self._mark(route, first)
        self._mark(route, place)

    def _mark(self, route: tuple, place: tuple) -> None:
        key1, key2, pos = place
        low, high = pos - route[3], pos - route[2] + self.window
        spans = self.marks.setdefault((key1, key2), [])
        if spans and spans[-1][0] <= low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(high, spans[-1][1]))
        else:
            spans.append((low, high))
            self.used += 250

    def flush(self) -> list[tuple]:
        out = [(g, longer, 1 if p else 2, *(p or (0, 0, 0)), least, most, c) for (g, longer, least, most, c), p in self.held.items()]
        out += [(key1, key2, 0, key1, key2, low, 0, 0, high.to_bytes(4, "little")) for (key1, key2), spans in self.marks.items() for low, high in spans]
        self.held, self.marks, self.used = {}, {}, 0
        return out


def _routed(joined: DataFrame, window: int, gram: int) -> DataFrame:
    """joined: key1, key2, text, places array<int>: twice a suffix's number in its document, one more if its prefix is a long one."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROUTED, strict=True)], schema=_ROUTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(window)

        def flush() -> Iterator[pa.RecordBatch]:
            rest = sender.flush()
            for at in range(0, len(rest), 5000):
                yield batch(rest[at : at + 5000])

        for b in batches:
            k1, k2, places = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
            flat, many = places.flatten().to_numpy(), places.value_lengths().to_numpy()
            of = np.concatenate([[0], np.cumsum(many)])
            for lo, hi, data, offsets in chunks(b.column(2)):
                w = words(data, offsets)
                doc, x, g, least, most = chosen(w, window, gram)
                mine = flat[of[lo] : of[hi]].astype(np.int64)
                first = np.searchsorted(doc, np.repeat(np.arange(hi - lo), many[lo:hi]))
                both = np.unique(2 * first + mine)  # rows that repeat a document have its places twice
                at, hot = both >> 1, (both & 1).astype(bool)
                doc, x, g, least, most = doc[at], x[at], g[at].view(np.int64), least[at], most[at]
                pos = x - w.first[doc]
                text, edge = squeezed(w)
                c = ~hot
                for d, p, h, few, lots, i, j in zip((lo + doc[c]).tolist(), pos[c].tolist(), g[c].tolist(), least[c].tolist(), most[c].tolist(), edge[x[c] - most[c]].tolist(), edge[x[c] - least[c] + window].tolist(), strict=True):
                    sender.add((h, 0, few, lots, text[i:j]), (k1[d], k2[d], p))
                size = (most - least + 1)[hot]
                start = np.repeat((x - most)[hot] - np.cumsum(size) + size, size) + np.arange(size.sum())
                full = w.spans(start, start + window).view(np.int64).tolist()
                for d, p, h, before, f in zip(*(np.repeat(v[hot], size).tolist() for v in (lo + doc, pos, g)), (np.repeat(x[hot], size) - start).tolist(), full, strict=True):
                    sender.add((h, f or 1, before, before, None), (k1[d], k2[d], p))
                if sender.used > _FLUSH_BYTES:
                    yield from flush()
        yield from flush()

    return joined.select("key1", "key2", "text", "places", "doc_id").mapInArrow(run, _ROUTED_SQL)


def _depth_classes(columns: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree of the rows of columns below their group: order of its leaves, and the length each shares with the leaf before (-1 at a new group)."""
    order = np.lexsort((*columns.T[::-1], group))
    c, g = columns[order], group[order]
    differ = c[1:] != c[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), columns.shape[1])
    shared[g[1:] != g[:-1]] = -1
    return order, np.concatenate([[-1], shared])


def _node_at(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """By row, the tree's node at that depth above its leaf."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def repeated(group: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray, contexts: list[bytes], window: int) -> np.ndarray:
    """By row and number of words before the suffix: whether the window occurs twice or more."""
    rows = len(group)
    w = words(np.frombuffer(b"".join(contexts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in contexts])]))
    left, right = np.zeros((rows, max(1, int(most.max()))), dtype=_U), np.zeros((rows, window), dtype=_U)
    of = np.repeat(np.arange(rows), w.counts)
    at = np.arange(len(of)) - w.first[of] - most[of]
    lower = at < 0
    left[of[lower], -1 - at[lower]] = w.hashes[lower]
    right[of[~lower], at[~lower]] = w.hashes[~lower]
    after, before = _depth_classes(right, group), _depth_classes(left, group)
    out = np.zeros((rows, window), dtype=bool)
    for o in range(int(least.min()), int(most.max()) + 1):
        has = np.flatnonzero((least <= o) & (o <= most))
        if len(has):
            node = _node_at(*after, window - o)[has] * (rows + 1) + _node_at(*before, o)[has]
            _, which = np.unique(node, return_inverse=True)
            out[has, o] = np.bincount(which, weights=n[has])[which] >= 2
    return out


def _light(rows: list[tuple], window: int) -> list[tuple]:
    """Repeated stretches in whole groups of rows with contexts."""
    _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
    n, least, most = (np.array([r[k] for r in rows], dtype=np.int64) for k in (2, 6, 7))
    hit = repeated(group, n, least, most, [r[8] for r in rows], window)
    hit[n != 1] = False  # those have no place
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    at, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return [(rows[i][3], rows[i][4], rows[i][5] - h, rows[i][5] - o + window) for i, o, h in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)]


def stretches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, longer, most: key1, key2, low, high of repeated stretches. Trees are built for about _TREE_BYTES of contexts at once: hashing takes forty times the bytes."""

    def done(keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keys, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key1", "key2", "low", "high"])

    held: list[tuple] = []  # whole groups, then the one that goes on
    used = 0
    first: tuple | None = None  # the lone first row of a long prefix
    key = None
    for b in batches:
        out = []
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[2] == 0:
                out.append((r[3], r[4], r[5], int.from_bytes(r[8], "little")))
            elif r[1] == 0:
                if used >= _TREE_BYTES and held[-1][0] != r[0]:
                    out += _light(held, window)
                    held, used = [], 0
                held.append(r)
                used += len(r[8])
            else:
                span = (r[3], r[4], r[5] - r[7], r[5] - r[7] + window)
                if (r[0], r[1], r[7]) != key:
                    key, first = (r[0], r[1], r[7]), span if r[2] == 1 else None
                else:
                    if first:
                        out.append(first)
                    if r[2] == 1:
                        out.append(span)
                    first = None
        if out:
            yield done(out)
    if held and (out := _light(held, window)):
        yield done(out)


def _spans(routed: DataFrame, window: int) -> DataFrame:
    """Repeated stretches: key1, key2, low, high in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stretches(batches, window)

    dealt = routed.repartition(partitions(routed.sparkSession), "gram", "longer").sortWithinPartitions("gram", "longer", "most")
    return dealt.mapInArrow(run, "key1 long, key2 long, low int, high int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (the words that stay, one space between)."""
    ready(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    suffixes = stored(_suffixes(keyed, window, gram), "suffixes")
    counts = stored(suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "prefixes")
    places = suffixes.join(counts, "gram").select("key1", "key2", (F.col("number") * 2 + (F.col("n") > group).cast("int")).alias("place"))
    by_doc = places.groupBy("key1", "key2").agg(F.collect_list("place").alias("places"))
    # both joins take all columns of the same rows, and the rest is one plan, so that texts are shuffled once
    joined = keyed.join(by_doc.hint("shuffle_hash"), ["key1", "key2"])
    spans = _spans(_routed(joined, window, gram), window)
    marks = spans.groupBy("key1", "key2").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    marked = keyed.join(marks.hint("shuffle_hash"), ["key1", "key2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, texts = [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                kept = t.encode().split()  # bytes are split at 0x20 and 0x09-0x0D
                total.append(len(kept))
                if s:
                    edge = np.zeros(len(kept) + 1, dtype=np.int64)
                    np.add.at(edge, [x["low"] for x in s], 1)
                    np.add.at(edge, [x["high"] for x in s], -1)
                    kept = [kept[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                gone.append(total[-1] - len(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return marked.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents
), s AS (
  SELECT r, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i, w FROM d WHERE len(w) >= {WINDOW}
), h AS (
  SELECT r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS m FROM s
), t AS (
  SELECT r, i FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)
), g AS (
  SELECT r, list(DISTINCT k) AS gone FROM (SELECT r, unnest(generate_series(i, i + {WINDOW - 1})) AS k FROM t) GROUP BY r
), k AS (
  SELECT d.*, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (r)
), e AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, gone, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM k) WHERE NOT list_contains(gone, i) GROUP BY r
)
SELECT k.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN e USING (r)
"""
