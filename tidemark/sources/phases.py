"""Output files of earlier phases: scope, findings, semantic changes, call graph and flows by language."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dims

MAX_BYTES = 50 << 20
LANGUAGES = ("go", "typescript", "python")
#: phase -> (suffix of its files, lists that its documents hold; none of them filled, the phase found nothing)
PHASES: Mapping[str, tuple[str, tuple[str, ...]]] = {
    "ast": ("-ast.json", ("functions.modified", "functions.added", "functions.deleted", "types.modified", "types.added", "types.deleted", "imports.added", "imports.removed")),
    "callgraph": ("-calls.json", ("modified_functions",)), "dataflow": ("-flow.json", ("flows", "nil_sources")),
}
#: The elements of a symbol document that is a list of files' changes, as far as they decide what it holds.
_CHANGE = "array<struct<change_type:string{}>>"
_CHANGES = f"array<struct<functions:{_CHANGE.format(',before:variant,after:variant')},types:{_CHANGE.format('')},imports:{_CHANGE.format('')}>>"


def read_json(path: str, most: int = MAX_BYTES):
    """One document of bounded size, read where the driver runs."""
    size = os.path.getsize(path)
    if size > most:
        raise ValueError(f"{path}: {size} bytes, more than {most}")
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Pattern, one a line; blank lines and lines that begin with # are dropped."""
    line = F.trim(F.regexp_replace("value", r"[\t\r]", " "))
    return spark.read.text(path).select(line.alias("pattern")).where("pattern <> '' and not startswith(pattern, '#')")


def json_files(spark: SparkSession, folder: str, suffix: str, most: int = MAX_BYTES) -> DataFrame:
    """Language (from the file's name), content (null for a file over the bound) of a phase's files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    name = F.substring_index("path", "/", -1)
    return files.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("language"), F.when(F.col("length") <= most, F.decode("content", "UTF-8")).alias("content"))


def _there(v: Column) -> Column:
    """Whether a value is there and is not JSON's null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def parsed(content: Column, lists: Sequence[str], listed: bool = False) -> Column:
    """struct<good, filled> of a JSON document, whatever its shape: whether it is an object whose lists are lists (or absent, or null: an empty one), and whether one holds anything.

    A document that is null is good and empty. listed: a list of files' changes is good too; it is
    filled by a function's change with a side of its own, a type's change or an import's.
    """
    v = F.try_parse_json(content)
    at = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    whole = F.is_variant_null(v) | F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    fine, some = whole, F.lit(False)
    for parent in sorted({path.split(".")[0] for path in lists if "." in path}):
        fine = fine & (~_there(at(parent, "variant")) | at(parent, "map<string,variant>").isNotNull())
    for path in lists:
        items = at(path, "array<variant>")
        fine = fine & (~_there(at(path, "variant")) | items.isNotNull())
        some = some | F.coalesce(F.size(items) > 0, F.lit(False))
    good = v.isNotNull() & F.coalesce(fine, F.lit(False))
    if not listed:
        return F.struct(good.alias("good"), (good & some).alias("filled"))
    items = F.try_variant_get(v, "$", "array<variant>")
    files = F.when(F.forall(items, lambda e: F.is_variant_null(e) | F.try_variant_get(e, "$", "map<string,variant>").isNotNull()), F.try_variant_get(v, "$", _CHANGES))
    side = lambda c: F.when(c["change_type"] == "modified", _there(c["before"]) | _there(c["after"])).when(c["change_type"] == "added", _there(c["after"])).when(c["change_type"] == "removed", _there(c["before"]))
    holds = F.exists(files, lambda f: F.coalesce(
        F.coalesce(F.exists(f["functions"], lambda c: F.coalesce(side(c), F.lit(False))), F.lit(False))
        | F.coalesce(F.exists(f["types"], lambda c: c["change_type"].isin("modified", "added", "removed")), F.lit(False))
        | F.coalesce(F.exists(f["imports"], lambda c: c["change_type"].isin("added", "removed")), F.lit(False)), F.lit(False)))
    return F.struct((good | files.isNotNull()).alias("good"), F.when(good, some).otherwise(F.coalesce(holds, F.lit(False))).alias("filled"))


def _judged(files: DataFrame, languages: Sequence[str], phase: str, by: Sequence[str]) -> DataFrame:
    suffix, lists = PHASES.get(phase, (phase, ()))
    own = files.withColumn("__place", F.array_position(F.lit([*languages]), F.col("language"))).where("__place > 0")
    told = own.withColumn("__doc", parsed(F.col("content"), lists, phase == "ast"))
    error = F.when(F.col("content").isNull(), F.concat("language", F.lit(f"{suffix} read error"))).when(~F.col("__doc.good"), F.concat("language", F.lit(f"{suffix} parse error")))
    return told.select(*by, "language", "content", "__place", F.col("__doc.good").alias("__good"), F.col("__doc.filled").alias("__filled"), error.alias("__error"))


def phase_status(files: DataFrame, languages: Sequence[str], phase: str, by: Sequence[str] = ()) -> DataFrame:
    """Status and errors (in the order of languages) of a phase over the languages of a scope, by the given columns. files: language, content (null if it could not be read).

    The first language whose file is a document decides: completed, or empty if the document holds
    nothing. Failed if files are there and none is a document, not run without any.
    """
    rows = _judged(files, languages, phase, by)
    first = F.min_by(F.when(F.col("__good"), F.col("__filled")), F.when(F.col("__good"), F.col("__place")))
    status = F.when(F.count(F.lit(1)) == 0, "not_run").when(first, "completed").when(F.bool_or("__good"), "empty").otherwise("failed")
    # one error for each language at most
    errors = F.array_sort(F.collect_list(F.when(F.col("__error").isNotNull(), F.struct("__place", "__error"))))
    return rows.groupBy(*by).agg(status.alias("status"), F.array_join(F.transform(errors, lambda e: e["__error"]), ", ").alias("errors"))


def primary_documents(files: DataFrame, languages: Sequence[str], phase: str, by: Sequence[str] = ()) -> DataFrame:
    """Of the languages' files the first that is a document: language, content, by the given columns; null where none is."""
    rows = _judged(files, languages, phase, by).where("__good")
    return rows.groupBy(*by).agg(F.min_by(F.struct("language", "content"), "__place").alias("__first")).select(*by, "__first.*")


def scope_languages(scope: Mapping | None) -> tuple[str, ...]:
    """The languages of a scope, its main one behind them if it is not among them; all of them without a scope or languages."""
    if scope is None:
        return LANGUAGES
    found = list(scope.get("languages") or [])
    main = str(scope.get("language") or "").strip()
    if main and main not in found:
        found.append(main)
    return tuple(found) or LANGUAGES


def all_phases(spark: SparkSession, folder: str) -> DataFrame:
    """Phase, status, errors of scope, static analysis and the phases by language, for the languages that the scope names."""
    files = json_files(spark, folder, ".json")
    name = F.col("language")
    one = {n: files.where(name == n) for n in ("scope", "static-analysis")}
    found = one["scope"].select("content", parsed(F.col("content"), ("files.modified", "files.added", "files.deleted", "files.renamed", "languages")).alias("d")).where("d.good").select(F.to_json(F.struct(
        F.from_json("content", "language string, languages array<string>").alias("s")))).first()
    languages = scope_languages(json.loads(found[0]).get("s") or {} if found else None)

    def single(n: str, lists: Sequence[str], nothing: str, broken: str) -> DataFrame:
        d = parsed(F.col("content"), lists)
        status = F.when(F.count(F.lit(1)) == 0, "not_run").when(F.bool_or(d["filled"]), "completed").when(F.bool_or(d["good"]), nothing).otherwise("failed")
        error = F.when(F.col("content").isNull(), f"{n}.json read error").when(~d["good"], f"{n}.json {broken} error")
        return one[n].agg(F.lit(n).alias("phase"), status.alias("status"), F.coalesce(F.max(error), F.lit("")).alias("errors"))

    # a scope without files is a scope
    out = single("scope", ("files.modified", "files.added", "files.deleted", "files.renamed", "languages"), "completed", "read").unionByName(single("static-analysis", ("findings",), "empty", "parse"))
    for phase, (suffix, _) in PHASES.items():
        out = out.unionByName(phase_status(json_files(spark, folder, suffix), languages, phase).select(F.lit(phase).alias("phase"), "status", "errors"))
    return out


def skip_reason(folder: str, needs_language: bool = False, read: Callable[[str], dict] = read_json) -> str | None:
    """F32: why a phase that depends on the scope is left out, None if it runs."""
    try:
        scope = read(os.path.join(folder, "scope.json"))
    except FileNotFoundError:
        return "scope.json missing - skipping dependent phase"
    except (OSError, ValueError):
        return None
    files = scope.get("files") or {}
    if not any(files.get(k) for k in ("modified", "added", "deleted")):
        return "No changed files detected"
    if needs_language and str(scope.get("language") or "").strip().lower() in ("", "unknown"):
        return "Unknown language detected"
    return None


def language_token(language: Column, fallback: Column) -> Column:
    """The language of a document as a token for file names: its own, else the fallback, by their usual names; else unknown."""

    def usual(c: Column) -> Column:
        word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
        known = F.when(word.isin("", "mixed", "unknown"), None).otherwise(F.coalesce(dims.mapped(word, dims.LANGUAGE_ALIASES), word))
        return F.when(known.rlike(r"^[a-z0-9_-]+$"), known)

    return F.coalesce(usual(language), usual(fallback), F.lit("unknown"))
