"""Order-dependent folds over groups without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, _parse_datatype_string


def fold_groups(rows: DataFrame, key: str, order: list[str], fold: Callable[[str, list[tuple]], Iterator[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """fold(key, rows of the group in order) -> result rows. rows: key first.

    One shuffle by key and a sort within partitions; a task then streams its groups and holds one
    at a time. Fits many small groups; a group must fit in memory, as files do by the source's cap.
    dealt: the rows lie by key and order already, as a window over both leaves them, and are not
    shuffled again; a key that comes back later in a task is an error.
    """
    columns = [key, *(c for c in rows.columns if c != key)]
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)
        stream = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)

        seen = set()
        for k, group in groupby(stream, key=lambda r: r[0]):
            if k in seen:
                raise ValueError(f"rows of {k!r} do not lie together")
            seen.add(k)
            held += fold(k, list(group))
            if len(held) > 5000:
                yield batch()
                held = []
        if held:
            yield batch()

    rows = rows.select(*columns)
    if not dealt:
        rows = rows.repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(run, kind)


def _listed(kind: DataType) -> bool:
    """Values of this type hold lists, so one may be of any size."""
    return isinstance(kind, (ArrayType, MapType)) or isinstance(kind, StructType) and any(_listed(f.dataType) for f in kind.fields)


def numbered_rows(rows: DataFrame, order: list[str], made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows with nth, 1..n in the given order, without bringing them to one task.

    They are sorted by ranges and written; each partition's number of rows, one small row each,
    gives the places of its first one. made: what is written of the sorted rows, row by row.
    Ranges are of the columns before the first that holds lists: the driver gets a sample of them,
    and rows that are equal in them lie in one partition, where they are sorted by all.
    """
    from tidemark.sources.store import stored

    low = (1 << 33) - 1
    place = F.monotonically_increasing_id()
    ranged = list(takewhile(lambda c: not _listed(rows.schema[c].dataType), order)) or order
    dealt = rows.repartitionByRange(*ranged).sortWithinPartitions(*order)
    dealt = made(dealt) if made else dealt
    kept = stored(dealt.withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit(low))}), "numbered")
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return kept.join(F.broadcast(before), "__part").withColumn("nth", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")
