"""Tables of patterns against tables of paths.

Patterns are cut into segments and joined into a trie; an edge is a plain segment, one with
wildcards, or "**". Paths are cut into segments too, and what directories share is walked once: a
level of directories meets the trie's nodes that their parents have reached. Plain segments are
joined by equality; those with wildcards by what stands before the first wildcard and behind the
last one, and only then compared by expression. "**" stays where it is or moves on. So work follows
the nodes that paths reach, not patterns times paths, and nothing is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.paths import _segment_regex, clean, path_error
from tidemark.sources.store import stored

#: Folders whose files no pattern matches.
SKIPPED = (".git", "node_modules", "vendor")
ROOT = ""


def pattern_error(pattern: Column) -> Column:
    """why a pattern is not taken, null if it is."""
    told = F.regexp_replace(path_error(pattern), "^path ", "pattern ")
    return F.coalesce(told, F.when(clean(pattern) == ".", "pattern must not be current directory"))


def _edges(patterns: DataFrame) -> DataFrame:
    """Per edge of the trie: parent, child (nodes are the text up to them), kind (plain, wild, any), segment, head, tail, expression, ends (a pattern ends in child)."""
    segments = F.split("pattern", "/")
    upto = lambda i: F.array_join(F.slice(segments, 1, i), "/")
    steps = patterns.select("pattern", F.posexplode(segments).alias("i", "segment"))
    rows = steps.select(F.when(F.col("i") == 0, ROOT).otherwise(upto(F.col("i"))).alias("parent"), upto(F.col("i") + 1).alias("child"), "segment", (F.col("i") + 1 == F.size(segments)).alias("ends"))
    kind = F.when(F.col("segment") == "**", "any").when(F.col("segment").rlike(r"[*?\[\\]"), "wild").otherwise("plain")
    merged = rows.groupBy("parent", "child", "segment").agg(F.bool_or("ends").alias("ends")).withColumn("kind", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wild = [s if k == "wild" else None for s, k in zip(b.column("segment").to_pylist(), b.column("kind").to_pylist(), strict=True)]
            yield b.append_column("expression", pa.array([None if s is None else f"^{_segment_regex(s)}$" for s in wild], pa.string()))

    told = merged.mapInArrow(run, "parent string, child string, segment string, ends boolean, kind string, expression string")
    # a class or an escape may hold what looks like a plain end, so only what is before the first special sign counts, and what is behind the last of a segment without them
    head = F.regexp_extract("segment", r"^[^*?\[\\]*", 0)
    tail = F.when(~F.col("segment").rlike(r"[\[\\]"), F.regexp_extract("segment", r"[^*?]*$", 0)).otherwise("")
    return told.withColumns({"head": head, "tail": tail})


def _with_moves(reached: DataFrame, anys: DataFrame) -> DataFrame:
    """The nodes reached, and those that "**" reaches without a segment. Two "**" in a row are one move further each time."""
    out, step = reached, reached
    while True:
        step = step.join(anys.select(F.col("parent").alias("node"), "child"), "node").select("folder", F.col("child").alias("node")).distinct()
        step = stored(step, "globs")
        if step.isEmpty():
            return out.distinct()
        out = out.unionByName(step)


def matching(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """The files (path) that match any pattern (pattern), outside SKIPPED folders. A pattern that is no valid glob, absolute, empty or leads upwards is an error; no pattern matches nothing.

    As many rounds as the deepest path has segments.
    """
    bad = F.raise_error(F.concat(pattern_error(F.col("pattern")), F.lit(": "), F.coalesce("pattern", F.lit(""))))
    fine = patterns.select(F.when(pattern_error(F.col("pattern")).isNull(), clean(F.col("pattern"))).otherwise(bad).alias("pattern")).distinct()
    edges = stored(_edges(fine), "globs")
    plain, wild, anys = (edges.where(F.col("kind") == k) for k in ("plain", "wild", "any"))
    ends = edges.where("ends").select(F.col("child").alias("node"), (F.col("kind") == "any").alias("rest")).distinct()
    shapes = wild.select(F.col("parent").alias("node"), F.length("head").alias("lh"), F.length("tail").alias("lt")).distinct()
    cut = F.split("path", "/")
    own = files.select("path").distinct()
    seen = stored(own.where(~F.exists(F.slice(cut, 1, F.size(cut) - 1), lambda s: s.isin(*SKIPPED))), "globs")
    upto = lambda i: F.array_join(F.slice(cut, 1, i), "/")
    prefixes = stored(seen.select(F.posexplode(cut).alias("i", "segment"), "path").select((F.col("i") + 1).alias("depth"), F.when(F.col("i") == 0, ROOT).otherwise(upto(F.col("i"))).alias("parent"), upto(F.col("i") + 1).alias("folder"), "segment").distinct(), "globs")
    spark = files.sparkSession
    reached = _with_moves(spark.createDataFrame([(ROOT, ROOT)], "folder string, node string"), anys)
    last, hits = prefixes.agg(F.max("depth")).first()[0] or 0, None
    any_nodes = anys.select(F.col("child").alias("node")).distinct()
    for depth in range(1, last + 1):
        at = prefixes.where(F.col("depth") == depth).select("parent", "folder", "segment")
        here = reached.select(F.col("folder").alias("parent"), "node").join(at, "parent")
        by_name = here.join(plain.select(F.col("parent").alias("node"), "segment", "child"), ["node", "segment"]).select("folder", F.col("child").alias("node"))
        shaped = here.join(shapes, "node").where("length(segment) >= greatest(lh, lt)").withColumns({"head": F.expr("left(segment, lh)"), "tail": F.expr("right(segment, lt)")})
        tried = shaped.join(wild.select(F.col("parent").alias("node"), F.col("head"), F.col("tail"), F.length("head").alias("lh"), F.length("tail").alias("lt"), "expression", "child"), ["node", "head", "tail", "lh", "lt"])
        by_shape = tried.where(F.expr("segment rlike expression")).select("folder", F.col("child").alias("node"))
        stay = here.join(any_nodes, "node").select("folder", "node")
        level = stored(by_name.unionByName(by_shape).unionByName(stay).distinct(), "globs")
        reached = stored(_with_moves(level, anys), "globs")
        found = reached.join(ends, "node").select(F.col("folder").alias("path"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return files.limit(0)
    return files.join(hits.distinct().join(seen, "path", "left_semi"), "path", "left_semi")
