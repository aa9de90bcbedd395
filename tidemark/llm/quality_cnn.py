"""Quality classifier: a byte-level convolutional network in numpy.

Every document is cut into blocks of 64 bytes; two neighbouring blocks are a chunk, so chunks
overlap by half and cover the whole text. Learned filters WIDTH bytes wide run over all bytes, and
their rectified outputs are averaged within a chunk. A second learned layer turns each chunk into
hidden units, which are max-pooled over all chunks of the document and combined into one
probability. Only the bytes of the text enter, and every weight is learned; those of the last step
stay at 0 or below, so a hidden unit is evidence against a text, and one without evidence passes.

Null and empty texts are one empty chunk and get a score like any other. Very long texts are read
whole, in slices of bounded size. Repeated rows get equal scores each, rows without a label are
scored too, several labels for one id all count in training. Without any usable label every score
is 0.5. Zero bytes inside a text are skipped. Other columns are left alone; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import ready, table
from tidemark.llm._words import chunks

NAME = "op10_quality_cnn"
#: The model is fitted on so many labelled rows of each class at most, those with the smallest hash of the id.
SAMPLE_PER_CLASS = 1000
#: Texts of more bytes are scored like any other, but not learned from; so the sample is bounded in bytes too.
SAMPLE_TEXT_BYTES = 1 << 16
BLOCK, WIDTH, FILTERS, HIDDEN = 64, 5, 24, 16
EPOCHS, BATCH, RATE = 24, 32, 0.01
#: Shares within a chunk are of so many bytes at least: a text of a few words is no strong evidence.
LEAST = 48.0
_SLICE = 1 << 18


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents in blocks, an empty block behind each: (bytes, first block of each document, with one more at the end)."""
    sizes = np.diff(offsets)
    blocks = np.maximum(1, (sizes + BLOCK - 1) // BLOCK) + 1
    first = np.concatenate([[1], 1 + np.cumsum(blocks)])
    x = np.zeros(int(first[-1]) * BLOCK, dtype=np.uint8)
    at = np.repeat(first[:-1] * BLOCK - offsets[:-1], sizes) + np.arange(len(data))
    x[at] = data
    return x, first


class Model:
    """Weights and the forward and backward passes."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.w = {
            "t": g(WIDTH, 256, FILTERS, scale=0.3), "tb": np.zeros(FILTERS, np.float32),
            "h": g(FILTERS, HIDDEN, scale=0.3), "hb": np.zeros(HIDDEN, np.float32),
            "v": -np.abs(g(HIDDEN, scale=0.3)) - 0.1, "vb": np.full(1, 2, np.float32),
        }

    def _conv(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Sums of the rectified filters by block, in slices. x begins and ends with a block of zeros, which stand around every text."""
        t, n, half = self.w["t"], len(x), WIDTH // 2
        out = np.zeros((n // BLOCK, FILTERS), dtype=np.float32)
        for lo in range(BLOCK, n - BLOCK, _SLICE):
            hi = min(n - BLOCK, lo + _SLICE)
            z = t[0].take(x[lo - half : hi - half], axis=0)
            for k in range(1, WIDTH):
                z += t[k].take(x[lo - half + k : hi - half + k], axis=0)
            z += self.w["tb"]
            np.maximum(z, 0, out=z)
            z *= real[lo:hi, None]
            out[lo // BLOCK : hi // BLOCK] = z.reshape(-1, BLOCK, FILTERS).sum(axis=1)
        return out

    def forward(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        x, first = _laid_out(data, offsets)
        real = x != 0
        sums = self._conv(x, real)
        bytes_in = np.bitwise_count(np.packbits(real).view(np.uint64)).astype(np.float32)
        # chunk k of a document: its blocks k and k + 1; the last one reaches into the empty block
        pair = np.zeros_like(sums)
        pair[:-1] = sums[:-1] + sums[1:]
        n = np.zeros_like(bytes_in)
        n[:-1] = bytes_in[:-1] + bytes_in[1:]
        used = np.maximum(1, (np.diff(offsets) + BLOCK - 1) // BLOCK)
        start = np.concatenate([[0], np.cumsum(used)])
        rows = np.repeat(first[:-1] - start[:-1], used) + np.arange(start[-1])
        # the last block of a longer text alone is a short chunk; its neighbour before holds it as well
        c = pair[rows] / np.maximum(n[rows], LEAST)[:, None]
        h = np.maximum(c @ self.w["h"] + self.w["hb"], 0)
        pooled = np.maximum.reduceat(h, start[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(pooled @ self.w["v"] + self.w["vb"], -30, 30)))
        return {"x": x, "real": real, "n": n, "start": start, "rows": rows, "c": c, "h": h, "pooled": pooled, "score": score}

    def gradients(self, s: dict, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted log loss; only the chunks that won a hidden unit share its part."""
        d = ((s["score"] - y) * weight / weight.sum()).astype(np.float32)
        out = {"v": s["pooled"].T @ d, "vb": d.sum(keepdims=True)}
        dp = d[:, None] * self.w["v"][None, :] * (s["pooled"] > 0)
        doc = np.repeat(np.arange(len(y)), np.diff(s["start"]))
        won = s["h"] == s["pooled"][doc]
        dh = np.where(won, (dp / np.add.reduceat(won, s["start"][:-1], axis=0, dtype=np.float32))[doc], 0)
        hit = np.flatnonzero(np.abs(dh).max(axis=1) > 1e-7)
        dh, c, rows = dh[hit], s["c"][hit], s["rows"][hit]
        out["h"], out["hb"] = c.T @ dh, dh.sum(axis=0)
        df = (dh @ self.w["h"].T) / np.maximum(s["n"][rows], LEAST)[:, None]
        at = (rows[:, None] * BLOCK + np.arange(2 * BLOCK)).ravel()
        by = np.repeat(df, 2 * BLOCK, axis=0)
        ok = (at < len(s["x"]) - BLOCK) & s["real"][np.minimum(at, len(s["x"]) - 1)]
        at, by = at[ok], by[ok]
        x, t, half = s["x"], self.w["t"], WIDTH // 2
        z = self.w["tb"] + sum(t[k][x[at + k - half]] for k in range(WIDTH))
        by = (by * (z > 0)).astype(np.float64)
        out["t"], out["tb"] = np.zeros_like(t), by.sum(axis=0).astype(np.float32)
        place = np.arange(FILTERS)
        for k in range(WIDTH):
            cell = x[at + k - half].astype(np.int64)[:, None] * FILTERS + place
            out["t"][k] = np.bincount(cell.ravel(), weights=by.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
        return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    """Adam on the log loss, both classes weighing the same. None if a class is missing."""
    y = np.asarray(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    m, r = Model(seed), np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    mean = {k: np.zeros_like(v) for k, v in m.w.items()}
    square = {k: np.zeros_like(v) for k, v in m.w.items()}
    epochs, step = max(epochs, min(120, 20_000 // len(y))), 0
    total = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            at = order[lo : lo + BATCH]
            g = m.gradients(m.forward(*_joined([texts[i] for i in at])), y[at], weight[at])
            step += 1
            rate = RATE * min(1, 2 * (1 - step / (total + 1)))
            for k, v in m.w.items():
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] ** 2 - square[k])
                v -= rate * (mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6) + 1e-3 * v * (k in "thv"))
            np.minimum(m.w["v"], 0, out=m.w["v"])
    return m


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> tuple[list[bytes], list[int]]:
    """Up to per_class labelled texts of each class, outside the held-out fold, of SAMPLE_TEXT_BYTES at most. An id that repeats gives no more rows in all."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "quality")
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("__id"), "quality")
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).where(F.octet_length("__text") <= SAMPLE_TEXT_BYTES)
    rows = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).select("__doc", "__text", "quality").orderBy("__doc", "quality", "__text").limit(2 * per_class).collect()
    rows.sort(key=lambda x: (x[0], x[2], x[1]))
    return [x[1].encode() for x in rows], [int(x[2]) for x in rows]


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, 0.5)
            if model is not None:
                for lo, hi, data, offsets in chunks(b.column(1), 1 << 19):
                    out[lo:hi] = model.forward(data, offsets)["score"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", training_docs: DataFrame | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    ready(docs.sparkSession)
    model = fit(*training_rows(docs if training_docs is None else training_docs, labels, per_class, id_col, text_col))
    return scores(docs, model, id_col, text_col).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model accepts, with all their columns."""
    ready(docs.sparkSession)
    model = fit(*training_rows(docs, labels, per_class, id_col, text_col))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is not None:
                good = [model.forward(data, offsets)["score"] >= threshold for _, _, data, offsets in chunks(b.column(where), 1 << 19)]
                b = b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool), pa.bool_()))
            yield b

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
