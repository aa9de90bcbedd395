"""python -m tidemark: scope, symbols, calls and flows of a repository, and the registered queries."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.patterns import PYTHON_SANITIZERS, TYPESCRIPT_SANITIZERS
from tidemark.operators import flows, paths, reports, symbols
from tidemark.plans.registry import importable
from tidemark.sources import parsers
from tidemark.sources.repository import Repository
from tidemark.sources.store import scratch

SANITIZERS = {"python": PYTHON_SANITIZERS, "typescript": TYPESCRIPT_SANITIZERS}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--out", help="folder for the result; shown on the screen without it")
    p.add_argument("--format", choices=("json", "parquet", "text"), default="json")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the registered queries")
    q = sub.add_parser("query", help="one registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    s = sub.add_parser("scope", help="what changed")
    d = sub.add_parser("diff", help="symbols that differ between two revisions")
    for x in (s, d):
        x.add_argument("--repo", default=".")
        x.add_argument("--base", default="")
        x.add_argument("--head", default="")
    s.add_argument("--mode", choices=("refs", "staged", "unstaged", "all"), default="refs")
    s.add_argument("--files", help="globs, separated by commas")
    for name, text in (("calls", "call sites of source files"), ("flows", "data flows of source files"), ("security", "the security report of source files")):
        f = sub.add_parser(name, help=text)
        f.add_argument("--files", required=True, help="a path or glob that Spark reads")
        f.add_argument("--language", choices=("go", "python", "typescript"), required=True)
    return p


def sources(spark: SparkSession, path: str, language: str) -> DataFrame:
    """file, language, content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.lit(language).alias("language"), F.decode("content", "UTF-8").alias("content"))


def scope(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    r = Repository(spark, a.repo)
    if a.mode == "unstaged":
        names = r.unstaged_files()
        listed = [x.path for x in names.collect()]
        there = [(n,) for n in listed if os.path.lexists(os.path.join(a.repo, n))]
        before = [(n,) for n in listed if r.exists("HEAD", n)]
        changed = paths.scope_files(names, *(spark.createDataFrame(x, "path string") for x in (before, there)), r.line_counts("HEAD", listed))
    else:
        changed = {"refs": lambda: r.diff(a.base, a.head), "staged": r.staged, "all": r.all_changes}[a.mode]()
    return paths.checked_count(paths.expand(changed, a.files.split(",")) if a.files else changed)


def diff(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    r = Repository(spark, a.repo)
    base, head = a.base or "HEAD", a.head
    names = [x.path for x in paths.checked_count(r.diff(base, head)).select("path").collect()]
    typed = lambda d: d.withColumn("language", paths.language(F.col("file"))).where("content is not null and language is not null")
    if head:
        after = r.contents(head, names)
    else:
        after = spark.createDataFrame([(n, _read(f"{a.repo}/{n}")) for n in names], "file string, content string")
    return symbols.semantic_diff(typed(r.contents(base, names)), typed(after)).drop("before", "after")


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command == "queries":
        return spark.createDataFrame([(n,) for n in catalog.queries()], "query string")
    if a.command == "query":
        return catalog.queries()[a.name](spark, a.data)
    if a.command == "scope":
        return scope(spark, a)
    if a.command == "diff":
        return diff(spark, a)
    files = sources(spark, a.files, a.language)
    if a.command == "calls":
        return parsers.calls(files.select("file", "content"), language=a.language)
    found = flows.analysis(parsers.code_lines(files.select("file", "content"), longest=parsers.MAX_LINE_BYTES if a.language == "go" else None), a.language, SANITIZERS.get(a.language), reused=a.command != "flows")
    if a.command == "flows":
        return found["flows"]
    shown = found["flows"].withColumns({"description": flows.described() if a.language == "go" else F.concat(F.lit("Data from "), "source_type", F.lit(" flows to "), "sink_type"), "function": F.col("sink_pattern"), "sanitizers": F.lit(""), "source_context": F.lit(""), "sink_context": F.lit("")})
    nils = found["nil_sources"] if "pattern" in found["nil_sources"].columns else found["nil_sources"].withColumn("pattern", F.col("origin"))
    blocks = reports.security_report(found["statistics"].withColumn("language", F.lit(a.language)), shown, nils, "")
    return reports.document(blocks)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = importable(spark or SparkSession.builder.appName("tidemark").getOrCreate())
    if a.command == "query" and a.name not in catalog.queries():
        print(f"no query {a.name}", file=sys.stderr)
        return 2
    with scratch(spark):
        rows = result(spark, a)
        if a.out:
            rows.write.mode("errorifexists").format(a.format).save(a.out)
        else:
            for r in rows.toLocalIterator():
                print(r[0] if len(rows.columns) == 1 else r.asDict(recursive=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
