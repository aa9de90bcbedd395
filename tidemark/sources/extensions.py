"""Analyzers by name, for SQL as for DataFrames.

An analyzer of lines sees a file's lines in order and gives rows of its own schema. It is registered
under a name and called as a table function whose result has that schema:

    SELECT * FROM analyze_lines(TABLE(lines) PARTITION BY file ORDER BY (line), 'go-nil-sources')

A table argument has the columns file, line and text among others. Spark deals the files out and
sorts their lines; a task holds one file, as large as the source's cap at most. install() also
registers the parsers of symbols and call sites and the decoders of git's listings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidemark.operators.flows import file_nils


@dataclass(frozen=True)
class LineAnalyzer:
    """rows: (file, line numbers, texts) of one file -> rows of schema, a DDL string."""

    schema: str
    rows: Callable[[str, Sequence[int], Sequence[str]], Iterator[tuple]]


ANALYZERS: dict[str, LineAnalyzer] = {}


def register(name: str, schema: str, rows: Callable[[str, Sequence[int], Sequence[str]], Iterator[tuple]]) -> None:
    """Another analyzer, before install() is called; it replaces one of the same name."""
    ANALYZERS[name] = LineAnalyzer(schema, rows)


def _nil_sources(file: str, lines: Sequence[int], texts: Sequence[str]) -> Iterator[tuple]:
    """Go: what may be nil and is checked nowhere after, with the last line that uses it. texts are without comments."""
    for name, i, text, check, use in file_nils(list(texts)):
        if check is None and ", ok" not in text and ", _" not in text:
            yield file, name, lines[i], None if use is None else lines[use]


register("go-nil-sources", "file string, variable string, line int, usage_line int", _nil_sources)


def _table_function(known: dict[str, tuple[LineAnalyzer, StructType]]) -> type:
    class AnalyzeLines:
        def __init__(self) -> None:
            self.name, self.file, self.lines, self.texts = None, None, [], []

        @staticmethod
        def analyze(table: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("analyze_lines takes a table and the name of an analyzer")
            missing = {"file", "line", "text"} - set(table.dataType.names)
            if missing:
                raise ValueError(f"analyze_lines needs the columns {', '.join(sorted(missing))}")
            if name.value not in known:
                raise ValueError(f"unknown analyzer {name.value!r}; known are {', '.join(sorted(known))}")
            return AnalyzeResult(schema=known[name.value][1])

        def eval(self, row, name: str):
            self.name, self.file = name, row["file"]
            self.lines.append(row["line"])
            self.texts.append(row["text"] or "")

        def terminate(self):
            if self.lines:
                yield from known[self.name][0].rows(self.file, self.lines, self.texts)

    return AnalyzeLines


def install(spark: SparkSession) -> None:
    """Registers the table functions for SQL: analyze_lines, symbols_of, call_sites_of, name_status, numstat."""
    from tidemark.sources import git, parsers

    known = {n: (a, _parse_datatype_string(a.schema)) for n, a in ANALYZERS.items()}
    spark.udtf.register("analyze_lines", udtf(_table_function(known)))
    for name, function in (("symbols_of", parsers.Symbols), ("call_sites_of", parsers.CallSites), ("name_status", git.NameStatus), ("numstat", git.Numstat)):
        spark.udtf.register(name, function)
