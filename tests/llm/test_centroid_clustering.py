import hashlib

import numpy as np

from tidemark.llm import centroid_clustering as cc


def plain(vectors, clusters, rounds, dimensions=4, scale=256):
    """All distances of all rounds."""
    kept = [(i, [int(np.floor(scale * e)) for e in v]) for i, v in vectors if v is not None and len(v) == dimensions and all(e is not None and np.isfinite(e) for e in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [x for _, x in order[:clusters]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for k in range(len(at)):
            members = [x for (_, x), o in zip(kept, own, strict=True) if o == k]
            if members:
                at[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    return sorted((str(i), nearest(x)[1], nearest(x)[0]) for i, x in kept), at


def check(spark, rows, clusters, rounds):
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, cluster int")
    found = cc.clustered(df.repartition(3), clusters=clusters, rounds=rounds, dimensions=4)
    want, at = plain(rows, clusters, rounds)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.rows().collect()) == want
    assert found.centroids.at.tolist() == at
    return found


def test_as_with_all_distances(spark):
    rng = np.random.default_rng(5)
    heart = rng.normal(0, 4, (30, 4))
    rows = [(i, (heart[i % 30] + rng.normal(0, 0.3, 4)).tolist()) for i in range(3000)]
    found = check(spark, rows, 25, 5)
    assert sum(found.scanned[1:]) < 0.5 * 25 * 3000 * 5  # bounds and balls save most distances


def test_ties_repeats_and_grids(spark):
    grid = [(i, [float(i % 4) / 64, float(i // 4 % 4) / 64, float(i // 16 % 2) / 64, 0.0]) for i in range(256)]
    check(spark, grid, 9, 4)
    check(spark, [(i % 3, [0.5, 0.25, -0.125, 0.0]) for i in range(50)], 5, 3)  # equal vectors, repeated ids


def test_rows_that_do_not_count(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None, 0.0, 0.0]), (6, [float("nan"), 0.0, 0.0, 0.0]), (7, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.5]), (9, [-1e5, 1e5, 0.0, 0.001])]
    check(spark, rows, 40, 5)
    far = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert cc.clustered(far, dimensions=4) is None
    assert cc.clustered(far.limit(0), dimensions=4) is None


def test_distances_beyond_doubles():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(1 << 27), 1 << 27, (20, 64)), rng.integers(-(1 << 27), 1 << 27, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]
    assert cc.squared(x, c).tolist() == want


def test_empty_table_gives_empty_result(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = cc.query(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
