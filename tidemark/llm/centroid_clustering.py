"""Centroid clustering of vectors by exponion search.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the distance
to any other. After centroids have moved, the bounds move with them; a vector whose upper bound is
below the lower one, or below half the distance from its centroid to the next centroid, keeps its
centroid without a look. For another one, the upper bound is made exact; if that does not settle
it, the nearest and the second nearest centroid lie within 2 * upper + (distance to the next
centroid) of its own, and only centroids inside that ball are scanned. Each centroid has the list of the
others by distance, cut where its size doubles, so a scan takes the first 2, 4, 8, ... of a list.

The components are integers, distances are compared exactly, and the radius is inclusive, so a
centroid at the same distance is always among those scanned; the smaller number wins. Bounds are
floating-point numbers, rounded away from a decision that they cannot support.

Vectors travel in blocks of one Arrow batch, with their clusters and bounds. A round is one pass
over the blocks: it writes the blocks anew and, beside each, what its moves add to the sums of the
clusters, so centroids follow from sums over one narrow column. Nothing is shuffled but one row of
sums for each task and cluster; the driver holds the centroids alone.

A vector counts if it has exactly DIMENSIONS components, none of them null or non-finite, and none
beyond what 64-bit squared distances hold (2**27 after scaling); other rows are left out. With fewer vectors than clusters there are as many clusters
as vectors. Rows that repeat a vector count each. Rows without an id are hashed as if it were
empty; equal hashes follow the order of the vectors. Other columns are left alone, an empty table
gives an empty result. Components take part whole, however many vectors there are; sums of
components are exact up to 2**36 vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm._runtime import delete, ready, table, written

NAME = "op12_centroid_clusters"
DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
_LARGEST = 1 << 27
_SLACK = 1e-12
_FAR = np.int64(2**63 - 1)


def _above(x: np.ndarray) -> np.ndarray:
    return x * (1 + _SLACK)


def _below(x: np.ndarray) -> np.ndarray:
    return x * (1 - _SLACK)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of x and of c (both int64)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


@dataclass
class Centroids:
    """Centroids of a round, with the others of each by distance, and how far each has moved."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        between = np.sqrt(squared(self.at, self.at).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")  # starts with the centroid itself or an equal one
        self.reach = np.take_along_axis(between, self.order, axis=1)
        others = between + np.where(np.eye(len(self.at), dtype=bool), np.inf, 0)
        self.next = others.min(axis=1) if len(self.at) else np.zeros(0)
        self.furthest = np.array([np.delete(self.moved, k).max(initial=0) for k in range(len(self.at))])


@dataclass
class Bounded:
    """Vectors of a block with their cluster and bounds."""

    x: np.ndarray
    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: int = 0

    @classmethod
    def first(cls, x: np.ndarray, centroids: Centroids) -> Bounded:
        """Every centroid looked at."""
        out = cls(x, np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x)))
        out._scan(np.arange(len(x)), np.arange(len(centroids.at)), centroids)
        return out

    def _scan(self, rows: np.ndarray, among: np.ndarray, centroids: Centroids) -> None:
        """Nearest and second nearest of the given centroids for the given rows."""
        among = np.sort(among)  # argmin takes the smallest number of equal ones
        d = squared(self.x[rows], centroids.at[among])
        self.scanned += d.size
        best = d.argmin(axis=1)
        self.cluster[rows] = among[best]
        self.upper[rows] = _above(np.sqrt(d[np.arange(len(rows)), best].astype(np.float64)))
        d[np.arange(len(rows)), best] = _FAR
        self.lower[rows] = _below(np.sqrt(d.min(axis=1).astype(np.float64))) if len(among) > 1 else np.inf

    def own(self, rows: np.ndarray, centroids: Centroids) -> np.ndarray:
        """Exact squared distance to the vector's own centroid."""
        return ((self.x[rows] - centroids.at[self.cluster[rows]]) ** 2).sum(axis=1)

    def search(self, centroids: Centroids) -> None:
        """Moves the bounds with the centroids, then each vector to its nearest one."""
        self.upper = _above(self.upper + _above(centroids.moved[self.cluster]))
        self.lower = np.maximum(_below(self.lower) - _above(centroids.furthest[self.cluster]), 0)
        enough = np.maximum(self.lower, _below(centroids.next[self.cluster] / 2))
        rows = np.flatnonzero(self.upper >= enough)
        self.upper[rows] = _above(np.sqrt(self.own(rows, centroids).astype(np.float64)))
        self.scanned += len(rows)
        rows = rows[self.upper[rows] >= enough[rows]]
        radius = _above(2 * self.upper[rows] + centroids.next[self.cluster[rows]])
        own = self.cluster[rows]
        for c in np.unique(own).tolist():
            some = np.flatnonzero(own == c)
            inside = np.searchsorted(_below(centroids.reach[c]), radius[some], "right")
            size = 1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64)
            for n in np.unique(size).tolist():
                self._scan(rows[some[size == n]], centroids.order[c, :n], centroids)


def _moves(x: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
    """What a block adds to each cluster's count and sums; clusters whose members stay are absent."""
    changed = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    signs = [(after, 1)] if before is None else [(before, -1), (after, 1)]
    out: dict[int, list] = {}
    for cluster, sign in signs:
        for c in np.unique(cluster[changed]).tolist():
            members = x[changed[cluster[changed] == c]]
            entry = out.setdefault(c, [0, np.zeros(x.shape[1], np.int64)])
            entry[0] += sign * len(members)
            entry[1] += sign * members.sum(axis=0)
    return [{"cluster": c, "n": n, "sums": s.tolist()} for c, (n, s) in out.items()]


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id and x, the components as integers, of the rows that count."""
    v = F.col(vector_col)
    whole = F.transform(v, lambda e: F.floor(e.cast("double") * scale))
    fine = (F.size(v) == dimensions) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * scale < float(_LARGEST)))
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), F.transform(whole, lambda e: e.cast("int")).alias("x"))


_BLOCK = "ids array<{kind}>, width int, x binary, cluster binary, upper binary, lower binary, scanned long, moves array<struct<cluster:int,n:bigint,sums:array<bigint>>>"
_MOVES = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _packed(ids: pa.Array, state: Bounded, moves: list[dict]) -> pa.RecordBatch:
    width = 2 if np.abs(state.x).max(initial=0) < 1 << 15 else 4
    raw = [pa.array([y.tobytes()], pa.binary()) for y in (state.x.astype(f"<i{width}"), state.cluster, state.upper, state.lower)]
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([lists, pa.array([width], pa.int32()), *raw, pa.array([state.scanned], pa.int64()), pa.array([moves], _MOVES)], names=["ids", "width", "x", "cluster", "upper", "lower", "scanned", "moves"])


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, Bounded]]:
    for k in range(b.num_rows):
        width, x, cluster, upper, lower = (b.column(c)[k].as_py() for c in ("width", "x", "cluster", "upper", "lower"))
        ids = b.column("ids")[k].values
        yield ids, Bounded(np.frombuffer(x, f"<i{width}").reshape(len(ids), -1).astype(np.int64), np.frombuffer(cluster, np.int32).copy(), np.frombuffer(upper).copy(), np.frombuffer(lower).copy())


def _start(kept: DataFrame, centroids: Centroids, kind: str) -> DataFrame:
    """Blocks of the first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)
                state = Bounded.first(x, centroids)
                yield _packed(b.column(0), state, _moves(x, None, state.cluster))

    return kept.mapInArrow(run, _BLOCK.format(kind=kind))


def _round(blocks: DataFrame, centroids: Centroids, kind: str) -> DataFrame:
    """Blocks of the next assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, state in _unpacked(b):
                before = state.cluster.copy()
                state.search(centroids)
                yield _packed(ids, state, _moves(state.x, before, state.cluster))

    return blocks.mapInArrow(run, _BLOCK.format(kind=kind))


def _distances(blocks: DataFrame, centroids: Centroids, kind: str) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, state in _unpacked(b):
                yield pa.RecordBatch.from_arrays([ids, pa.array(state.cluster), pa.array(state.own(np.arange(len(ids)), centroids))], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


@dataclass
class Clustering:
    """The last assignment in blocks, its centroids, and how many distances each round has computed."""

    blocks: DataFrame
    centroids: Centroids
    scanned: list[int]
    kind: str

    def rows(self) -> DataFrame:
        """Per vector: vec_id, cluster, distance."""
        return _distances(self.blocks, self.centroids, self.kind)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering | None:
    """rounds times assigned and moved, then assigned once more; None if no vector counts.

    The driver and each task hold clusters * dimensions components and clusters ** 2 distances.
    """
    spark = ready(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = kept_vectors(vectors, id_col, vector_col, dimensions, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = [r.x for r in kept.select(key.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()]
    if not chosen:
        return None
    at = np.array(chosen, dtype=np.int64)
    count, total = [0] * len(at), [[0] * dimensions for _ in chosen]
    centroids = Centroids(at, np.zeros(len(at)))
    blocks, path = written(_start(kept, centroids, kind), "clusters")
    scanned = []
    for _ in range(rounds):
        m = F.col("m")
        moves = blocks.select(F.explode("moves").alias("m")).groupBy(m["cluster"].alias("cluster")).agg(F.sum(m["n"]).alias("n"), *(F.sum(m["sums"][k]).alias(f"s{k}") for k in range(dimensions)))
        for r in moves.collect():  # a row for each cluster
            count[r.cluster] += r.n
            total[r.cluster] = [t + r[f"s{k}"] for k, t in enumerate(total[r.cluster])]
        scanned.append(blocks.agg(F.sum("scanned")).first()[0])
        at = np.array([[t // n for t in s] if n else old for n, s, old in zip(count, total, centroids.at.tolist(), strict=True)], dtype=np.int64)
        moved = _above(np.sqrt(((at - centroids.at) ** 2).sum(axis=1).astype(np.float64)))
        centroids = Centroids(at, moved)
        old = path
        blocks, path = written(_round(blocks, centroids, kind), "clusters")
        delete(spark, old)
    scanned.append(blocks.agg(F.sum("scanned")).first()[0])
    return Clustering(blocks, centroids, scanned, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    names = "cluster int, centroid_sha256 string"
    found = clustered(vectors)
    if found is None:
        rows, named = spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), spark.createDataFrame([], names)
    else:
        rows = found.rows()
        named = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(found.centroids.at.tolist())], names)
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(named, "cluster")
    whole = rows.agg(F.sum("distance").alias("inertia"))
    # one row for each cluster, and one
    return rows.join(F.broadcast(sums), "cluster").crossJoin(F.broadcast(whole)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    kept = f"len(embedding) = {DIMENSIONS} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e::DOUBLE)]) = {DIMENSIONS}"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * e::DOUBLE)::BIGINT FOR e IN embedding] AS x FROM embeddings WHERE {kept})",
        f"h AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c FROM v)",
        f"c0 AS MATERIALIZED (SELECT c, x FROM h WHERE c < {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT v.r, c.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT AS d FROM v CROSS JOIN c{k} AS c)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if k < ROUNDS:
            steps.append(f"e{k} AS MATERIALIZED (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.x) AS e, unnest(generate_series(1, {DIMENSIONS})) AS i FROM a{k} AS a JOIN v USING (r)) GROUP BY c, i)")
            steps.append(f"m{k} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM e{k} GROUP BY c)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{k} AS c LEFT JOIN m{k} AS m USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string([e::VARCHAR FOR e IN c.x], ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v USING (r) JOIN c{ROUNDS} AS c ON c.c = a.c"""


SQL = _sql()
