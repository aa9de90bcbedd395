"""Linter findings: routing, ranking, de-duplication, counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.operators.paths import extension

SECURITY = ("security",)


def severity_rank(c: Column | str) -> Column:
    return dims.mapped(F.col(c) if isinstance(c, str) else c, dims.SEVERITY_RANK, 0)


def normal_category(c: str = "category") -> Column:
    return F.lower(F.trim(c))


def dedup(findings: DataFrame, order: str = "ord") -> DataFrame:
    """By (file, line, message) the highest severity, the first on ties, at the place of the first. One shuffle."""
    key = Window.partitionBy("file", "line", "message")
    best = key.orderBy(severity_rank("severity").desc(), order)
    return (
        findings.withColumns({"__rn": F.row_number().over(best), "first_ord": F.min(order).over(key)})
        .where("__rn = 1").drop("__rn")
    )


def keep_changed(findings: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """Findings in changed files."""
    return findings.join(changed.select(F.col(path).alias("file")), "file", "left_semi")


def summary(findings: DataFrame) -> DataFrame:
    """One row, a counter for each severity and one for unknown ones."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES]
    return findings.agg(*counts, F.count_if(~F.col("severity").isin(*dims.SEVERITIES)).alias("unknown"))


def unknown_severities(findings: DataFrame) -> DataFrame:
    """An error row for each finding of a severity that is not known."""
    odd = findings.where(~F.col("severity").isin(*dims.SEVERITIES))
    return odd.select("ord", F.format_string('unknown severity "%s" for finding %s:%d (%s)', "severity", "file", "line", "message").alias("error"))


def merge(results: Iterable[DataFrame]) -> DataFrame:
    """Outputs of several tools, appended."""
    first, *rest = results
    for r in rest:
        first = first.unionByName(r, allowMissingColumns=True)
    return first


def merge_versions(results: Iterable[DataFrame]) -> DataFrame:
    """Tool and version, the last result that names a tool wins. results: tool, version."""
    placed = [r.select("tool", "version", F.lit(i).alias("place")) for i, r in enumerate(results)]
    return merge(placed).groupBy("tool").agg(F.max_by("version", "place").alias("version"))


def by_category(findings: DataFrame, category: str) -> DataFrame:
    """F09."""
    return findings.where(normal_category() == category.strip().lower())


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """an unknown severity stays, an unknown threshold keeps everything."""
    least = dims.REVIEW_RANK.get(severity.strip().lower())
    if least is None:
        return findings
    rank = dims.mapped(F.lower(F.trim("severity")), dims.REVIEW_RANK)
    return findings.where(F.coalesce(rank >= least, F.lit(True)))


def for_security(findings: DataFrame) -> DataFrame:
    """F12."""
    return findings.where(normal_category().isin(*SECURITY))


def for_quality(findings: DataFrame) -> DataFrame:
    """all that is not security, unmapped categories included."""
    return findings.where(~F.coalesce(normal_category().isin(*SECURITY), F.lit(False)))


def lint_targets(files: DataFrame, path: str = "path") -> DataFrame:
    """what each linter of a file's language is given: files, packages (the directory) or the project."""
    linters = files.sparkSession.createDataFrame(list(dims.LINTERS), "linter string, language string, target_kind string")
    typed = files.withColumn("language", dims.mapped(F.lower(extension(F.col(path))), dims.LINT_EXTENSIONS))
    target = F.when(F.col("target_kind") == "files", F.col(path)).when(F.col("target_kind") == "packages", F.concat(F.lit("./"), F.regexp_replace(path, r"/?[^/]*$", ""))).otherwise(".")
    return typed.join(F.broadcast(linters), "language").select("linter", "target_kind", target.alias("target")).distinct()


def eligible_linters(languages: DataFrame) -> DataFrame:
    """linters of the languages at hand."""
    linters = languages.sparkSession.createDataFrame(list(dims.LINTERS), "linter string, language string, target_kind string")
    return F.broadcast(linters).join(languages.select("language").distinct(), "language", "left_semi").select("linter", "language").dropDuplicates(["linter"])


def starts(c: Column, *pairs: tuple[str, str], default: str) -> Column:
    """First prefix that fits."""
    out = None
    for p, v in pairs:
        out = F.when(c.startswith(p), v) if out is None else out.when(c.startswith(p), v)
    return out.otherwise(default)


def severity_of(tool: Column, level: Column, code: Column, confidence: Column) -> Column:
    """a tool's own level as a severity."""
    word = F.lower(level)
    usual = F.when(word == "error", "high").when(word == "warning", "warning").otherwise("info")
    graded = F.when((F.upper(level) == "HIGH") & (F.upper(confidence) == "HIGH"), "critical").when(F.upper(level) == "HIGH", "high").when(F.upper(level) == "MEDIUM", "warning").otherwise("info")
    static = F.when(code.startswith("SA"), "warning").when(code.startswith("S1") | code.startswith("ST1"), "info").when(level == "error", "high").otherwise("warning")
    ruff = starts(code, ("S", "high"), ("E", "warning"), ("F", "warning"), ("W", "warning"), ("B", "warning"), default="info")
    mypy = F.when(word == "error", "high").when(word == "warning", "warning").when(word == "note", "info").otherwise("warning")
    pylint = F.when(word.isin("fatal", "error"), "high").when(word == "warning", "warning").otherwise("info")
    eslint = F.when(level == "2", "high").when(level == "1", "warning").otherwise("info")
    return (
        F.when(tool.isin("golangci-lint", "tsc"), usual).when(tool == "staticcheck", static).when(tool.isin("gosec", "bandit"), graded)
        .when(tool == "eslint", eslint).when(tool == "ruff", ruff).when(tool == "mypy", mypy).when(tool == "pylint", pylint).otherwise("info")
    )


def category_of(tool: Column, code: Column, kind: Column) -> Column:
    """a tool's rule as a category; kind is pylint's message type."""
    golangci = (
        F.when(code == "gosec", "security").when(code.isin("staticcheck", "typecheck"), "bug").when(code.isin("gofmt", "goimports", "govet", "gocritic"), "style")
        .when(code.isin("ineffassign", "deadcode", "unused", "varcheck"), "unused").when(code.isin("gocyclo", "gocognit"), "complexity").when(code == "depguard", "deprecation").otherwise("other")
    )
    # Prefixes of staticcheck's rules.
    static = starts(
        code, ("SA1", "bug"), ("SA2", "bug"), ("SA3", "bug"), ("SA4", "bug"), ("SA5", "bug"), ("SA6", "performance"), ("SA7", "bug"), ("SA8", "style"), ("SA9", "security"),
        ("S1", "style"), ("ST1", "style"), ("QF", "style"), default="other",
    )
    eslint = (
        F.when(code.startswith("@typescript-eslint/"), "type").when(code.contains("security"), "security").when(code.contains("no-unused"), "unused")
        .when(code == "parse-error", "bug").otherwise("style")
    )
    ruff = starts(code, ("S", "security"), ("F", "bug"), ("E", "style"), ("W", "style"), ("B", "bug"), ("I", "style"), ("UP", "deprecation"), ("C", "complexity"), default="other")
    pylint = (
        F.when(kind.isin("fatal", "error"), "bug").when((kind == "warning") & (code.startswith("W0611") | code.startswith("W0612")), "unused").when(kind == "warning", "bug")
        .when(kind == "refactor", "complexity").when(kind == "convention", "style").otherwise("other")
    )
    return (
        F.when(tool == "golangci-lint", golangci).when(tool == "staticcheck", static).when(tool == "eslint", eslint).when(tool == "ruff", ruff).when(tool == "pylint", pylint)
        .when(tool.isin("gosec", "bandit"), "security").when(tool.isin("tsc", "mypy"), "type").otherwise("other")
    )


def first_line(c: Column) -> Column:
    """The first number of a range a-b, 0 if there is none."""
    return F.coalesce(F.trim(F.substring_index(c, "-", 1)).try_cast("int"), F.lit(0))
