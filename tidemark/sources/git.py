"""Decoders for git's NUL-delimited output."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def new_path(c: Column) -> Column:
    """The path after a rename written as a/{old => new}/b or old => new."""
    braces = F.regexp_replace(c, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.replace(F.regexp_replace(braces, r"^.* => ", ""), F.lit("//"), F.lit("/"))


def nul_list(c: Column) -> Column:
    """The non-empty tokens."""
    return F.filter(F.split(c, "\\x00"), lambda x: x != "")


def decode_name_status(text: str) -> Iterator[tuple]:
    """(path, status, old_path) of each record; renames and copies take two paths. A record cut short ends the list."""
    tokens = text.split("\0")
    i = 0
    while i < len(tokens):
        status = tokens[i]
        if not status:
            i += 1
            continue
        two = status[0] in "RC"
        if i + 1 + two >= len(tokens) or not tokens[i + 1 + two]:
            return
        yield (tokens[i + 1 + two], status, tokens[i + 1] if two else None)
        i += 2 + two


def decode_numstat(text: str) -> Iterator[tuple]:
    """(path, additions, deletions); a rename has its two paths in the next tokens, binary files ("-") are skipped."""
    tokens = text.split("\0")
    i = 0
    while i < len(tokens):
        parts = tokens[i].split("\t", 2)
        i += 1
        if len(parts) != 3:
            continue
        path = parts[2]
        if not path:
            if i + 1 >= len(tokens):
                return
            path, i = tokens[i + 1], i + 2
        if parts[0].isdigit() and parts[1].isdigit():
            yield (path, int(parts[0]), int(parts[1]))


@udtf(returnType="path string, status string, old_path string")
class NameStatus:
    def eval(self, text: str):
        yield from decode_name_status(text or "")


@udtf(returnType="path string, additions long, deletions long")
class Numstat:
    def eval(self, text: str):
        yield from decode_numstat(text or "")


def changed_files(diffs: DataFrame, text: str = "content") -> DataFrame:
    """Rows of diffs with a record each; text holds the output of a name-status listing."""
    return diffs.lateralJoin(NameStatus(F.col(text).outer()))
