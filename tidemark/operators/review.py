"""Reviewer views: what each reviewer of a change gets, as rows of sections and focus areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.functions.text import sanitized
from tidemark.operators import findings as fi

#: reviewer -> function(tables) -> DataFrame(ord, title, description); see focus_areas.
BUILDERS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}
#: Callers from which on a function counts as widely used.
HIGH_IMPACT = 3
_AREA = "ord int, title string, description string"


def reviewer(name: str):
    def put(f):
        BUILDERS[name] = f
        return f

    return put


def _area(order: int, title: str, rows: DataFrame, text: str) -> DataFrame:
    """One row if there are any rows; text: the description behind their number."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return n.select(F.lit(order).alias("ord"), F.lit(title).alias("title"), F.concat(F.col("n").cast("string"), F.lit(" " + text)).alias("description"))


def _all(*parts: DataFrame) -> DataFrame:
    out, *rest = parts
    for p in rest:
        out = out.unionByName(p)
    return out


def changes_of(t: dict[str, DataFrame], kind: str, change: str) -> DataFrame:
    return t["changes"].where((F.col("symbol_kind") == kind) & (F.col("change_type") == change))


def signature_changes(t: dict[str, DataFrame]) -> DataFrame:
    """functions whose signature differs."""
    return changes_of(t, "function", "modified").where("old_sig <> new_sig")


def high_risk(t: dict[str, DataFrame]) -> DataFrame:
    return t["flows"].where(F.col("risk").isin("critical", "high"))


@reviewer("code-reviewer")
def code(t: dict[str, DataFrame]) -> DataFrame:
    """Deprecations, and each changed signature."""
    old = _area(1, "Deprecated API Usage", fi.by_category(t["findings"], "deprecation"), "deprecated API calls need updating")
    return old.unionByName(signature_changes(t).select(F.lit(2).alias("ord"), F.concat(F.lit("Signature change in "), "name").alias("title"), F.lit("Function signature modified - verify caller compatibility").alias("description")))


@reviewer("security-reviewer")
def security(t: dict[str, DataFrame]) -> DataFrame:
    """Unsanitized flows of high risk, security findings at high or above."""
    return _all(
        _area(1, "Unsanitized High-Risk Flows", high_risk(t).where(~F.col("sanitized")), "data flows without sanitization"),
        _area(2, "Critical Security Findings", fi.at_least(fi.for_security(t["findings"]), "high"), "high/critical security issues detected"),
    )


@reviewer("business-logic-reviewer")
def business(t: dict[str, DataFrame]) -> DataFrame:
    """Functions with many callers, new functions, flows of high risk."""
    return _all(
        _area(1, "High-Impact Functions", t["impact"].where(F.col("callers") >= HIGH_IMPACT), f"functions with {HIGH_IMPACT}+ callers modified"),
        _area(2, "New Functions", changes_of(t, "function", "added"), "new functions added - verify business requirements"),
        _area(3, "Data Flow Correctness", high_risk(t), "high-risk data flow(s) — verify input validation and query shape"),
    )


@reviewer("test-reviewer")
def test(t: dict[str, DataFrame]) -> DataFrame:
    """Functions without tests, new error returns."""
    return _all(
        _area(1, "Uncovered Code", t["impact"].where("tests = 0"), "modified functions without test coverage"),
        _area(2, "New Error Paths", changes_of(t, "error_return", "added"), "new error return paths need negative tests"),
    )


@reviewer("nil-safety-reviewer")
def nil_safety(t: dict[str, DataFrame]) -> DataFrame:
    """Unchecked nil sources, those of high risk."""
    return _all(
        _area(1, "Unchecked Nil Sources", t["nil_sources"].where(~F.col("is_checked")), "potential nil values without checks"),
        _area(2, "High-Risk Nil Sources", t["nil_sources"].where("risk = 'high'"), "high-risk nil sources require immediate attention"),
    )


@reviewer("consequences-reviewer")
def consequences(t: dict[str, DataFrame]) -> DataFrame:
    """Changed signatures, changed types, functions with many callers, new error returns."""
    return _all(
        _area(1, "Signature Changes", signature_changes(t), "function signature(s) changed - all direct callers must be verified"),
        _area(2, "Type Shape Changes", changes_of(t, "type", "modified"), "type(s) modified - downstream serialization and field access may break"),
        _area(3, "Broad Caller Reach", t["impact"].where(F.col("callers") >= HIGH_IMPACT), f"modified function(s) have {HIGH_IMPACT}+ callers"),
        _area(4, "New Error Paths", changes_of(t, "error_return", "added"), "new error return(s) widen the failure surface for callers"),
    )


@reviewer("dead-code-reviewer")
def dead_code(t: dict[str, DataFrame]) -> DataFrame:
    """C14: deleted functions, orphans, orphans that are still tested, removed imports."""
    orphan = t["impact"].where("callers = 0")
    return _all(
        _area(1, "Deleted Functions", changes_of(t, "function", "removed"), "function(s) removed - confirm no external consumers remain"),
        _area(2, "Orphan Functions", orphan, "modified function(s) have zero callers in the call graph"),
        _area(3, "Zombie Tests", orphan.where("tests > 0"), "orphan function(s) are still covered by tests - candidates for joint removal"),
        _area(4, "Removed Imports", changes_of(t, "import", "removed"), "import(s) removed - verify downstream packages still resolve"),
    )


def focus_areas(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Reviewer, ord, title, description; an unknown reviewer has one explanatory area."""
    build = BUILDERS.get(name)
    if build is None:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([(name, 1, "Unknown Reviewer", f"No focus areas are known for {name}")], "reviewer string, " + _AREA)
    return build(tables).select(F.lit(name).alias("reviewer"), "ord", "title", "description")


def all_focus_areas(tables: dict[str, DataFrame]) -> DataFrame:
    """Of all reviewers in their order."""
    rows = _all(*(focus_areas(name, tables) for name, _ in dims.REVIEWERS))
    return rows.orderBy(dims.mapped(F.col("reviewer"), {n: i for i, (n, _) in enumerate(dims.REVIEWERS)}), "ord", "title")


def _items(section: str, rows: DataFrame, item: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), item.cast("string").alias("item"))


def _flow_sections(t: dict[str, DataFrame]) -> list[DataFrame]:
    place = F.concat("source_file", F.lit(":"), "source_line", F.lit("-"), "sink_line")
    return [_items("high flow", high_risk(t), place), _items("medium flow", t["flows"].where("risk = 'medium'"), place)]


#: What each reviewer gets, as rows of section and item: reviewer -> tables -> parts.
SECTIONS: dict[str, Callable[[dict[str, DataFrame]], list[DataFrame]]] = {
    "code-reviewer": lambda t: [  # C01
        _items("finding", fi.for_quality(t["findings"]), F.col("ord")), _items("modified function", changes_of(t, "function", "modified"), F.col("name")),
        _items("added function", changes_of(t, "function", "added"), F.col("name")), _items("modified type", changes_of(t, "type", "modified"), F.col("name")),
    ],
    "security-reviewer": lambda t: [_items("finding", fi.for_security(t["findings"]), F.col("ord")), *_flow_sections(t)],  # C03
    "business-logic-reviewer": lambda t: [  # C05
        _items("high-impact function", t["impact"].where(F.col("callers") >= HIGH_IMPACT), F.col("node")), _items("modified function", changes_of(t, "function", "modified"), F.col("name")), *_flow_sections(t),
    ],
    "test-reviewer": lambda t: [  # C07
        _items("function", t["impact"], F.concat("node", F.lit(" "), "tests")), _items("uncovered", t["impact"].where("tests = 0"), F.col("node")),
    ],
    "nil-safety-reviewer": lambda t: [  # C09
        _items("nil source", t["nil_sources"], F.concat("file", F.lit(":"), "line", F.lit(" "), "variable")), _items("high-risk nil source", t["nil_sources"].where("risk = 'high'"), F.concat("file", F.lit(":"), "line", F.lit(" "), "variable")),
    ],
    "consequences-reviewer": lambda t: [  # C11
        _items("signature", signature_changes(t), F.col("name")), _items("type", changes_of(t, "type", "modified"), F.col("name")), _items("import added", changes_of(t, "import", "added"), F.col("name")),
        _items("import removed", changes_of(t, "import", "removed"), F.col("name")), _items("error return added", changes_of(t, "error_return", "added"), F.col("name")),
        _items("error check removed", changes_of(t, "error_check", "removed"), F.col("name")), _items("callers", t["impact"].where("callers > 0"), F.col("node")),
    ],
    "dead-code-reviewer": lambda t: [  # C13
        _items("deleted function", changes_of(t, "function", "removed"), F.col("name")), _items("deleted type", changes_of(t, "type", "removed"), F.col("name")), _items("removed import", changes_of(t, "import", "removed"), F.col("name")),
        _items("orphan", t["impact"].where("callers = 0"), F.col("node")), _items("tested orphan", t["impact"].where("callers = 0 and tests > 0"), F.col("node")),
    ],
}


def sections(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Section and item of everything that a reviewer gets."""
    return _all(*SECTIONS[name](tables))


def unregistered() -> list[str]:
    """Reviewers without a builder, builders without a reviewer."""
    known = {n for n, _ in dims.REVIEWERS}
    return sorted(known ^ set(BUILDERS))


def markdown(areas: DataFrame) -> DataFrame:
    """One document for each reviewer of its focus areas, in their order."""
    line = F.concat(F.lit("- **"), sanitized(F.col("title")), F.lit("**: "), sanitized(F.col("description")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", line.alias("line")))), lambda x: x["line"]), "\n")
    return areas.groupBy("reviewer").agg(F.concat(F.lit("# "), F.first("reviewer"), F.lit("\n\n"), body).alias("document"))


def phase_status(outputs: DataFrame) -> DataFrame:
    """A10: by phase, completed if any language is, else failed if any is, else not found."""
    any_of = lambda s: F.bool_or(F.col("status") == s)
    return outputs.groupBy("phase").agg(F.when(any_of("completed"), "completed").when(any_of("failed"), "failed").otherwise("not found").alias("status"))
