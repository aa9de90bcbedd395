"""Near duplicates: MinHash with tensored banding, links confirmed on full shingle sets.

1. Each document's set of word shingles gives two small collections of sketches, SKETCHES each of
   ROWS minhashes. A table key joins one sketch of either collection: SKETCHES**2 tables of
   2 * ROWS minhashes, for 2 * SKETCHES * ROWS minhashes computed. At a similarity of 0.8 a pair
   misses every table with a chance of 2e-5, at more with less.
2. Documents of one set are one class from then on. Sketches that one class alone has are dropped
   before any keys are formed.
3. Classes that share keys, directly or through others, are a cluster of candidates. Each bucket
   ties its members to its least one; no pairs are listed.
4. A cluster is compared within itself, in pairs of blocks of bounded size. A pair is taken up if
   all its minhashes together estimate ESTIMATE or more, the sizes allow the threshold, and it is
   not in one component already; then the full sets decide.
5. Components of the confirmed links give every document the smallest id that it reaches.

Null, empty and blank texts have no shingles and are linked with nothing, each its own component.
Very long texts are read whole. Texts of equal ids are told apart by their sets.
A text of fewer words than a shingle is one shingle. Rows without an id link like others and get
the least id of their component; where none has one, component_id is null and all are kept. Rows that repeat an id with one text fall in
one class. Shingles are compared by 64-bit hashes, sets by 128 bits. Extra columns are left
alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import partitions, ready, stored, table
from tidemark.llm._words import chunks, mixed, words
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import without_dropped

NAME = "op5_near_dedup"
SKETCHES, ROWS = 16, 3
HASHES = 2 * SKETCHES * ROWS
ESTIMATE_BELOW = 0.2
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 2_000_000
_U = np.uint64
_r = np.random.default_rng(4242)
_XOR, _MUL = (_r.integers(0, 2**63, HASHES, dtype=np.int64).astype(_U) * _U(2) + _U(1) for _ in range(2))
_SALT = mixed(np.arange(1, 2 * SKETCHES + 1).astype(_U))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the documents in order, sorted within each: (hashes, where each document's begin, with one more at the end)."""
    w = words(data, offsets, folded=True)
    at, g = w.grams(k)
    docs = len(offsets) - 1
    doc = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        doc = np.concatenate([doc, short])
        g = np.concatenate([g, w.spans(w.first[short], w.first[short + 1])])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    doc, g = doc[new], g[new]
    return g, np.searchsorted(doc, np.arange(docs + 1))


def minhashes(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES least values of each (non-empty) set."""
    out = np.empty((len(starts), HASHES), dtype=_U)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((g ^ _XOR[i]) * _MUL[i], starts)
    return out


def sketches(m: np.ndarray) -> np.ndarray:
    """2 * SKETCHES values of each row; the lowest bit tells the collection, the rest is salted by place."""
    x = np.zeros((len(m), 2 * SKETCHES), dtype=_U)
    for r in range(ROWS):
        x = mixed(x * _U(0x9E3779B97F4A7C15) + m[:, r :: ROWS])
    x = mixed(x ^ _SALT)
    return (x & ~_U(1)) | (np.arange(2 * SKETCHES) >= SKETCHES).astype(_U)


def _names(g: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits of each non-empty set."""
    both = np.stack([mixed(np.add.reduceat(mixed(g ^ _U(s)), starts)) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
    raw = both.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _nameless(id_col: str, text_col: str) -> Column:
    """Finds the text of a row without an id; null for the others."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("nameless")


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, nameless (see _nameless), node (the set's 16 bytes, null for an empty set), n_shingles, sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(2)):
                g, first = shingle_sets(data, offsets, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                names: list = [None] * len(n)
                flat = np.zeros(0, _U)
                if len(full):
                    starts = first[full]
                    for i, x in zip(full.tolist(), _names(g, starts), strict=True):
                        names[i] = x
                    flat = sketches(minhashes(g, starts)).ravel()
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * SKETCHES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(names, pa.binary()), pa.array(n.astype(np.int64)), lists], names=["doc_id", "nameless", "node", "n_shingles", "sketches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), _nameless(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, nameless long, node binary, n_shingles long, sketches array<long>")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """classes: node, sketches. Ties that connect each bucket's members over its least one, the hub: u, v.

    A class has as many hubs as it has tables at most. It is tied to the least of them, and the
    others are too, which connects the same classes and leaves one tie for each class and pair of hubs.
    """
    single = stored(classes.select("node", F.explode("sketches").alias("sketch")), "sketches")
    shared = stored(single.groupBy("sketch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sketch"), "shared")
    left = single.join(shared, "sketch").groupBy("node").agg(F.collect_list("sketch").alias("s"))
    side = lambda c, bit: F.filter(c, lambda x: F.expr("1L").bitwiseAND(x) == bit)
    tensor = F.flatten(F.transform(side(F.col("s"), 0), lambda x: F.transform(side(F.col("s"), 1), lambda y: F.xxhash64(x, y))))
    keys = stored(left.select("node", F.explode(tensor).alias("key")), "keys")
    hubs = stored(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "hubs")
    own = keys.join(hubs, "key").where("node <> hub").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    least = F.array_min("hubs")
    ties = F.transform(F.concat(F.array("node"), "hubs"), lambda x: F.struct(x.alias("u"), least.alias("v")))
    return own.select(F.explode(ties).alias("t")).select("t.*").where("u <> v").distinct()


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int((b[at] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def link_group(sets: list[np.ndarray], mins: np.ndarray, percent: int, cross: np.ndarray | None = None) -> list[int]:
    """Root of each set's component; cross: block of each set, only pairs of different blocks count."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    least = percent / 100 - ESTIMATE_BELOW
    pairs = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        ok = (100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest]))
        if cross is not None:
            ok &= cross[rest] != cross[i]
        rest = rest[ok]
        if len(rest):
            estimate = (mins[rest] == mins[i]).mean(axis=1)
            good = estimate >= least
            pairs.append(np.stack([np.full(good.sum(), i), rest[good], (estimate[good] * 1000).astype(np.int64)], axis=1))
    if pairs:
        every = np.concatenate(pairs)
        for i, j, _ in every[np.argsort(-every[:, 2], kind="stable")].tolist():
            x, y = find(i), find(j)
            if x != y and linked(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def confirmed_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links that connect every component: u, v (nodes). clusters: node, label."""
    spark = docs.sparkSession
    member = stored(clusters.join(classes.select("node", "doc_id", "nameless", "n_shingles"), "node"), "members")
    sizes = stored(member.groupBy("label").agg(_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks")), "sizes")
    placed = member.join(sizes, "label").select("doc_id", "nameless", "node", "label", "blocks")
    named = docs.select(F.col(id_col).alias("id"), _nameless(id_col, text_col).alias("no_id"), F.col(text_col).alias("text"))
    texts = named.join(placed.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc_id")) & F.col("no_id").eqNullSafe(F.col("nameless")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(0)):
                g, first = shingle_sets(data, offsets, k)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                starts = first[full]
                mins = (minhashes(g, starts) >> _U(48)).astype(np.uint16)
                rows = []
                for n, (i, name) in enumerate(zip(full.tolist(), _names(g, starts), strict=True)):
                    node, label, blocks = (b.column(c)[lo + i].as_py() for c in (1, 2, 3))
                    if node != name:  # another text of a repeated id
                        continue
                    block = int.from_bytes(node[:4], "little") % blocks
                    payload = mins[n].tobytes() + g[first[i] : first[i + 1]].tobytes()
                    rows += [(label, min(block, j), max(block, j), block, node, payload) for j in range(blocks)]
                for at in range(0, len(rows), 500):
                    part = rows[at : at + 500]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["label", "i", "j", "block", "node", "payload"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> tuple[list, list]:
            nodes = sorted(held)
            if len(nodes) < 2:
                return [], []
            mins = np.stack([np.frombuffer(held[x][1], np.uint16, HASHES) for x in nodes])
            sets = [np.frombuffer(held[x][1], _U, offset=2 * HASHES) for x in nodes]
            cross = None if key[1] == key[2] else np.array([held[x][0] for x in nodes])
            root = link_group(sets, mins, percent, cross)
            joined = [i for i, r in enumerate(root) if r != i]
            return [nodes[i] for i in joined], [nodes[root[i]] for i in joined]

        for b in batches:
            u, v = [], []
            for label, i, j, block, node, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (label, i, j) != key:
                    if held:
                        more = done()
                        u, v = u + more[0], v + more[1]
                    key, held = (label, i, j), {}
                held[node] = (block, payload)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])
        if held:
            u, v = done()
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    rows = texts.select("text", "node", "label", "blocks").mapInArrow(spread, "label binary, i int, j int, block int, node binary, payload binary")
    dealt = rows.repartition(partitions(spark), "label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    return dealt.mapInArrow(link, "u binary, v binary")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    ready(docs.sparkSession)
    signed = stored(signatures(docs, shingle_words, id_col, text_col), "signatures")
    some = signed.where("node is not null")
    # nulls sort first, so a row with an id stands for a class if there is one
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "nameless", "n_shingles", "sketches"))
    classes = stored(some.groupBy("node").agg(best.alias("m"), F.count(F.lit(1)).alias("n")).select("node", "n", "m.doc_id", "m.nameless", "m.n_shingles", "m.sketches"), "classes")
    clusters = components(candidate_edges(classes.select("node", "sketches")))
    links = stored(confirmed_links(docs, classes, clusters, shingle_words, percent, id_col, text_col), "links")
    joined = components(links)
    named = classes.select("node", "n", "doc_id").join(joined, "node", "left").select("node", "n", "doc_id", "label")
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    ids = named.where("label is not null or n > 1").join(stored(least, "least"), "label", "left")
    ids = stored(ids.select("node", F.coalesce("least", "doc_id").alias("component_id")), "ids")
    out = signed.drop("sketches", "nameless").join(ids, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns."""
    return without_dropped(docs, near_duplicates(docs, shingle_words, percent, id_col, text_col), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)
