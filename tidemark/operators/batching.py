"""Runs of rows within a budget of bytes, without passing all rows through one task.

A run takes rows in order until the next one would go over the budget; a row over the budget stands
alone. Rows are sorted by ranges. How a range's last run ends depends on how many bytes its first
rows find used, and only the first break in the range depends on that: for every row at which it may
be (those within one budget of the range's start), the breaks after it are followed to the end of
the range. That gives a step function, used bytes at the start -> used bytes and number of breaks at
the end. The functions are applied from range to range, one small row each; then each range numbers
its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.store import stored

#: Bytes of arguments that one call of a program is given.
ARGUMENT_BYTES = 96 * 1024


def breaks_after(total: np.ndarray, budget: int) -> np.ndarray:
    """For each row the first row of the next run, if a run begins there. total: bytes before each row, and of all at the end."""
    first = np.searchsorted(total, total[:-1] + budget, "right") - 1  # the first row that ends beyond the budget
    return np.maximum(first, np.arange(1, len(total)))


def summary(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row at which the first break may be: least used bytes that put it there, used bytes at the end, breaks. Rows that no used bytes (1 .. budget) reach are left out."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    entry = np.arange(min(n, int(np.searchsorted(total, budget, "left")) + 1))
    least = np.maximum(budget - total[entry + 1] + 1, 1)  # more than this would leave no room for the row
    most = np.minimum(budget - total[entry], np.iinfo(np.int64).max)
    entry = entry[(least <= most) | (entry == 0)]
    least = np.maximum(budget - total[entry + 1] + 1, 1)
    after = np.append(breaks_after(total, budget), n)
    at, last, breaks = entry.copy(), entry.copy(), np.zeros(len(entry), np.int64)
    while (at < n).any():
        inside = at < n
        last[inside], breaks[inside] = at[inside], breaks[inside] + 1
        at = after[at]
    return least, total[-1] - total[last], breaks


def applied(used: int, least: np.ndarray, end: np.ndarray, breaks: np.ndarray, all_bytes: int) -> tuple[int, int]:
    """(used bytes, breaks) at the end of a range for used bytes at its start; 0 used is the start of all."""
    if used == 0:
        return int(end[0]), int(breaks[0])  # the first row begins a run
    fits = np.flatnonzero(least <= used)
    return (int(end[fits[0]]), int(breaks[fits[0]])) if len(fits) else (used + all_bytes, 0)


def numbered(sizes: np.ndarray, used: int, run: int, budget: int) -> np.ndarray:
    """The run of each row. run: the number of the open run (0 before the first)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    after = breaks_after(total, budget)
    starts = []
    at = 0 if used == 0 else max(0, int(np.searchsorted(total, budget - used, "right")) - 1)
    while at < len(sizes):
        starts.append(at)
        at = int(after[at])
    out = np.zeros(len(sizes), np.int64)
    out[starts] = 1
    return run + np.cumsum(out)


def byte_batches(rows: DataFrame, size: Column, order: list[str], budget: int = ARGUMENT_BYTES) -> DataFrame:
    """The rows with batch, 1, 2, ... in the given order (of distinct rows): runs of rows whose sizes (whole numbers from 1 on) come to budget at most. Without a budget (0 or less) all are one run."""
    if budget <= 0:
        return rows.withColumn("batch", F.lit(1).cast("long"))
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()
    dealt = rows.withColumn("__size", size.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(dealt.withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))}), "batches")
    ranged = kept.repartition("__part").sortWithinPartitions("__part", "__at")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            part = b.column("__part").to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if held and held[0].column("__part")[0].as_py() != part[lo]:
                        yield held[0].column("__part")[0].as_py(), pa.Table.from_batches(held)
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield held[0].column("__part")[0].as_py(), pa.Table.from_batches(held)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in parts(batches):
            sizes = t.column("__size").to_numpy()
            least, end, breaks = summary(sizes, budget)
            new = np.append(True, (end[1:] != end[:-1]) | (breaks[1:] != breaks[:-1]))  # neighbours that end alike are one step
            step = np.flatnonzero(new)
            last = np.append(step[1:], len(end)) - 1
            raw = [x.astype("<i8").tobytes() for x in (least[last], end[step], breaks[step])]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), *(pa.array([x], pa.binary()) for x in raw)], names=["part", "bytes", "least", "end", "breaks"])

    used, run, starts = 0, 0, {}
    steps = ranged.select("__part", "__size").mapInArrow(told, "part long, bytes long, least binary, end binary, breaks binary")
    for r in steps.orderBy("part").toLocalIterator():  # one row for each range, one at a time
        starts[r.part] = (used, run)
        used, more = applied(used, *(np.frombuffer(x, "<i8") for x in (r["least"], r["end"], r["breaks"])), r["bytes"])
        run += more

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in parts(batches):
            out = numbered(t.column("__size").to_numpy(), *starts[part], budget)
            for b in t.append_column("batch", pa.array(out)).drop_columns(["__part", "__size", "__at"]).combine_chunks().to_batches():
                yield b

    schema = StructType([*rows.schema.fields]).add("batch", "long")
    return spark.createDataFrame([], schema) if not starts else ranged.select(*rows.columns, "__part", "__at", "__size").mapInArrow(number, schema)
