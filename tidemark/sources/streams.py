"""NUL-separated streams of any size, read in splits: S08, S09 and S11 over files.

Spark's text reader cuts a file into tokens wherever its splits fall. A token alone does not tell
what it is: a path may look like a status, and a record has two tokens or three. So each split is
first run from every state that a record can be in, which gives a function from the state at its
start to the state at its end with the tokens still open there; the functions are composed from
split to split of a file, and every split is then decoded from its true state. What the driver
holds is a row for each split, as many as Spark's own list of splits has.

A record that is broken or cut short is a row with an error and no path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where in a record the next token stands: a new record, its only or last path, the first of two paths.
NEW, LAST, FIRST = 0, 1, 2
RECORD = "path string, status string, old_path string, additions long, deletions long, error string"


@dataclass(frozen=True)
class Kind:
    """A format: what the first token of a record leads to, and what the tokens of a record say."""

    after: Callable[[str], int]
    record: Callable[[list[str]], tuple | None]


def _name_status(tokens: list[str]) -> tuple | None:
    status, *paths = tokens
    return (paths[-1], status, paths[0] if len(paths) == 2 else None, None, None, None)


def _after_counts(token: str) -> int:
    parts = token.split("\t", 2)
    return FIRST if len(parts) == 3 and not parts[2] else NEW


def _counts(tokens: list[str]) -> tuple | None:
    parts = tokens[0].split("\t", 2)
    if len(parts) != 3:
        return (None, None, None, None, None, f"invalid numstat record: {tokens[0]}")
    if parts[:2] == ["-", "-"]:
        return None  # a binary file
    if not (parts[0].isdigit() and parts[1].isdigit()):
        return (None, None, None, None, None, f"invalid counts in numstat record: {tokens[0]}")
    return (tokens[-1] if len(tokens) == 3 else parts[2], None, tokens[1] if len(tokens) == 3 else None, int(parts[0]), int(parts[1]), None)


KINDS = {
    "name-status": Kind(lambda t: FIRST if t[0] in "RC" else LAST, _name_status),
    "numstat": Kind(_after_counts, _counts),
    "list": Kind(lambda t: NEW, lambda tokens: (tokens[0], None, None, None, None, None)),
}


def decoded(tokens: Iterator[str], kind: Kind, state: int, held: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the token that ends it, tokens) of each record; afterwards held has the tokens of an open one. held: those before the first token."""
    for n, t in enumerate(tokens):
        if state == NEW:
            if t == "":
                continue
            state = kind.after(t)
        else:
            state -= 1
        held.append(t)
        if state == NEW:
            yield n, list(held)
            held.clear()


def _open_state(held: list[str], kind: Kind) -> int:
    return NEW if not held else kind.after(held[0]) - (len(held) - 1)


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\0").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _by_split(batches: Iterator[pa.RecordBatch], done: Callable[[str, int, Iterator[str]], Iterator[tuple]], flush: int = 5000) -> Iterator[list[tuple]]:
    """done(file, start, tokens) for each split of a task, in rows of about flush."""

    def stream() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in (b.column(1), b.column(2), b.column(0))), strict=True)

    rows = stream()
    ahead = next(rows, None)
    out: list[tuple] = []
    while ahead is not None:
        file, at = ahead[:2]

        def own() -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == (file, at):
                yield ahead[2]
                ahead = next(rows, None)

        tokens = own()
        for r in done(file, at, tokens):
            out.append(r)
            if len(out) >= flush:
                yield out
                out = []
        for _ in tokens:
            pass
    if out:
        yield out


def _batch(rows: list[tuple], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f"c{k}" for k in range(len(types))])


def _ends(tokens: DataFrame, kind: Kind) -> DataFrame:
    """Per split and state at its start: file, at, state, whole (no record of the split's own has ended the one open before), open tokens at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ends(file: str, at: int, own: Iterator[str]) -> Iterator[tuple]:
            runs = [[s, [], True] for s in (NEW, LAST, FIRST)]  # state, open tokens, whether the record from before is still open
            for t in own:
                for r in runs:
                    if r[0] == NEW and t == "":
                        continue
                    r[0] = kind.after(t) if r[0] == NEW else r[0] - 1
                    r[1].append(t)
                    if r[0] == NEW:
                        r[1], r[2] = [], False
            for s, r in zip((NEW, LAST, FIRST), runs, strict=True):
                yield file, at, s, r[2], r[1]

        for rows in _by_split(batches, ends):
            yield _batch(rows, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string())))

    return tokens.mapInArrow(run, "file string, at long, state int, whole boolean, open array<string>")


def starts(spark: SparkSession, path: str, kind: Kind) -> tuple[dict[tuple[str, int], list[str]], dict[str, list[str]]]:
    """The tokens open at the start of each split, and those left open at the end of each file."""
    told: dict[str, dict[int, dict[int, tuple[bool, list[str]]]]] = {}
    for r in _ends(_tokens(spark, path), kind).toLocalIterator():
        told.setdefault(r.file, {}).setdefault(r["at"], {})[r.state] = (r.whole, list(r.open))
    found, left = {}, {}
    for file, splits in told.items():
        held: list[str] = []
        for at in sorted(splits):
            found[file, at] = held
            whole, more = splits[at][_open_state(held, kind)]
            held = [*held, *more] if whole else more
        if held:
            left[file] = held
    return found, left


def read_stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of files (a path or glob that Spark reads): file, at and nth (their order within the file), and RECORD. kind: name-status, numstat or list.

    The files are read twice, and nothing is shuffled.
    """
    how = KINDS[kind]
    found, left = starts(spark, path, how)
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    shared = spark.sparkContext.broadcast(found)  # a row for each split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records(file: str, at: int, own: Iterator[str]) -> Iterator[tuple]:
            held = list(shared.value[file, at])
            for n, tokens in decoded(own, how, _open_state(held, how), held):
                row = how.record(tokens)
                if row is not None:
                    yield file, at, n, *row

        for rows in _by_split(batches, records):
            yield _batch(rows, types)

    schema = f"file string, at long, nth long, {RECORD}"
    out = _tokens(spark, path).mapInArrow(run, schema)
    if left:
        cut = [(f, 1 << 62, 0, None, None, None, None, None, "unexpected end of output") for f in left]
        out = out.unionByName(spark.createDataFrame(cut, schema))
    return out


def write_stream(records: DataFrame, path: str) -> None:
    """Token lists as NUL-separated files, whole records each. records: one column, array<string>."""
    records.select(F.array_join(F.col(records.columns[0]), "\0").alias("value")).write.option("lineSep", "\0").text(path)
