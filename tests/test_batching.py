"""Runs within a budget of bytes against the sequential rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import batching as ba
from tidemark.sources.repository import batches


@pytest.mark.parametrize("seed", range(4))
def test_ranges_compose_to_the_sequential_rule(seed):
    r = random.Random(seed)
    for _ in range(300):
        budget = r.randrange(1, 30)
        sizes = [r.randrange(1, r.choice((3, 12, 40))) for _ in range(r.randrange(1, 40))]
        want, used, run = [], 0, 0
        for s in sizes:
            if used == 0 or used + s > budget:
                run, used = run + 1, 0
            used += s
            want.append(run)
        cut = sorted(r.randrange(len(sizes)) for _ in range(r.randrange(6)))
        used = run = 0
        got = []
        for lo, hi in zip([0, *cut], [*cut, len(sizes)], strict=True):
            if hi == lo:
                continue
            part = np.array(sizes[lo:hi])
            got += ba.numbered(part, used, run, budget).tolist()
            used, more = ba.applied(used, *ba.summary(part, budget), int(part.sum()))
            run += more
        assert got == want, (sizes, budget, cut)


@pytest.mark.parametrize("budget", [1, 40, 333, 96 * 1024, 0])
def test_as_on_one_machine(spark, budget):
    r = random.Random(budget)
    paths = sorted({"/".join("é" * r.randrange(3) + "x" * r.randrange(1, 9) for _ in range(r.randrange(1, 9))) + str(i) for i in range(1500)}, key=str.encode)
    want = {p: n for n, some in enumerate(batches(paths, budget), 1) for p in some}
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, batch_size int").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    got = ba.byte_batches(df, F.octet_length("path") + 1, ["path"], budget)
    assert {x.path: x.batch for x in got.collect()} == want and got.columns == ["path", "batch_size", "batch"]
    assert ba.byte_batches(df.limit(0), F.octet_length("path") + 1, ["path"], budget).count() == 0
