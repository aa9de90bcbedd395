"""Markdown reports as rows of text blocks with their order; document() joins those of one report.

Blocks are made where their rows are. A report for each file or function is joined within its key;
a whole one is written block by block (sinks.write_blocks), so no report has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.functions.text import capitalised, escape_fence, escape_markdown
from tidemark.operators.calls import SHOWN_CALLEES, SHOWN_CALLERS, impact_level
from tidemark.operators.grouping import numbered_rows

BLOCK = "part int, ord long, text string"


def _text(*parts) -> Column:
    """Columns and plain strings in a row; null as empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _fence(c: Column) -> Column:
    return _text("```\n", c, "\n```\n\n")


def shown_signature(name: Column, params: Column, returns: Column, receiver: Column, is_async: Column) -> Column:
    """async (receiver) func name(a: T, b) -> R, S. params: array<struct<name, type>>."""
    shown = F.array_join(F.transform(params, lambda p: F.when(F.coalesce(p["type"], F.lit("")) == "", p["name"]).otherwise(F.concat(p["name"], F.lit(": "), p["type"]))), ", ")
    results = F.when(F.size(returns) > 0, F.concat(F.lit(" -> "), F.array_join(returns, ", ")))
    holder = F.when(F.coalesce(receiver, F.lit("")) != "", F.concat(F.lit("("), receiver, F.lit(") ")))
    return _text(F.when(is_async, "async "), holder, "func ", name, "(", shown, ")", results)


def change_block(c: Mapping[str, Column]) -> Column:
    """One symbol. c: symbol_kind, name, change_type, changes, before, after (signatures), kind, start_line, end_line, fields, alias."""
    change = c["change_type"]
    icon = F.when(change == "added", "+").when(change == "removed", "-").when(change == "modified", "~").otherwise("?")
    noted = F.when(F.coalesce(c["changes"], F.lit("")) != "", _text("**Changes:** ", c["changes"], "\n\n"))
    both = F.when(c["before"].isNotNull() & c["after"].isNotNull(), _text("**Before:**\n", _fence(c["before"]), "**After:**\n", _fence(c["after"])))
    function = _text(
        "### ", icon, " `", c["name"], "`\n\n", "**Status:** ", capitalised(change), "\n\n",
        F.when(change == "added", F.when(c["after"].isNotNull(), _fence(c["after"]))).when(change == "removed", F.when(c["before"].isNotNull(), _fence(c["before"]))).when(change == "modified", _text(noted, both)),
    )
    rows = F.array_join(F.transform(c["fields"], lambda x: F.concat(F.lit("| "), x["name"], F.lit(" | "), x["change"], F.lit(" | "), x["old"], F.lit(" | "), x["new"], F.lit(" |\n"))), "")
    table = F.when(F.size(c["fields"]) > 0, _text("**Field Changes:**\n\n| Field | Change | Old Type | New Type |\n|-------|--------|----------|----------|\n", rows, "\n"))
    shape = _text("### ", icon, " `", c["name"], "` (", c["kind"], ")\n\n**Status:** ", capitalised(change), "\n**Lines:** ", c["start_line"], "-", c["end_line"], "\n\n", table)
    brought = _text("- ", icon, " `", c["name"], "`", F.when(F.coalesce(c["alias"], F.lit("")) != "", F.concat(F.lit(" as "), c["alias"])), "\n")
    return F.when(c["symbol_kind"] == "function", function).when(c["symbol_kind"] == "type", shape).when(c["symbol_kind"] == "import", brought)


_KINDS = (("function", "Functions"), ("type", "Types"), ("variable", "Variables"), ("import", "Imports"))


def _summary_table(count) -> Column:
    lines = [F.lit("| Category | Added | Removed | Modified |\n|----------|-------|---------|----------|\n")]
    for kind, title in _KINDS:
        lines.append(_text(f"| {title} | ", count(kind, "added"), " | ", count(kind, "removed"), " | ", F.lit("-") if kind == "import" else count(kind, "modified"), " |\n"))
    return _text(*lines, "\n")


def semantic_documents(changes: DataFrame) -> DataFrame:
    """Language, file and document of each file with changes; changes: file, language and what change_block takes, ord (place in the file)."""
    blocks = changes.withColumn("__block", change_block({n: F.col(n) for n in ("symbol_kind", "name", "change_type", "changes", "before", "after", "kind", "start_line", "end_line", "fields", "alias")}))
    counts = {(k, c): F.count_if((F.col("symbol_kind") == k) & (F.col("change_type") == c)) for k, _ in _KINDS for c in ("added", "removed", "modified")}
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("symbol_kind") == kind, F.struct("ord", "name", "__block")))), lambda x: x["__block"]), "")
    section = lambda kind, title: F.when(of(kind) != "", _text(f"## {title}\n\n", of(kind)))
    text = _text("# Semantic Changes: ", F.col("file"), "\n\n**Language:** ", F.col("language"), "\n\n## Summary\n\n", _summary_table(lambda k, c: counts[k, c]), section("function", "Functions"), section("type", "Types"), section("import", "Imports"))
    return blocks.groupBy("language", "file").agg(text.alias("document"))


def semantic_report(changes: DataFrame) -> DataFrame:
    """The blocks of one report over many files: totals, then each file's document by name."""
    total = lambda k, c: F.count_if((F.col("symbol_kind") == k) & (F.col("change_type") == c))
    head = changes.agg(_text("# Semantic Diff Report\n\n## Overall Summary\n\n**Files analyzed:** ", F.count_distinct("file", "language"), "\n\n", _summary_table(total), "---\n\n").alias("text"))
    files = numbered_rows(semantic_documents(changes), ["file", "language"])
    return head.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), "text").unionByName(files.select(F.lit(1).alias("part"), F.col("nth").alias("ord"), _text(F.col("document"), "\n---\n\n").alias("text")))


def _listed(title: str, items: Column, n: Column, shown: int) -> Column:
    more = F.when(n > shown, _text("- ... and ", n - shown, " more\n"))
    return F.when(n == 0, f"**{title}:** None\n\n").otherwise(_text(f"**{title}:**\n\n", F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), more, "\n"))


def place(function: Column, file: Column, line: Column, site: Column | None = None) -> Column:
    """`f` at `file:line` (call site: s), without a place where it is not known."""
    at = F.when((F.coalesce(file, F.lit("")) != "") & (line > 0), _text(" at `", file, ":", line, "`"))
    return _text("`", function, "`", at, F.lit("") if site is None else F.when(F.coalesce(site, F.lit("")) != "", _text(" (call site: ", site, ")")))


def impact_block() -> Column:
    """One function, of columns function, file, n_callers, callers and callees (the first ones, as place() shows them), n_callees, tests (array of text)."""
    tests = F.when(F.size("tests") > 0, _text("**Test Coverage:** Has tests\n\n<details>\n<summary>Tests covering this function</summary>\n\n", F.array_join(F.transform("tests", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""), "\n</details>\n\n")).otherwise("**Test Coverage:** No tests found\n\n")
    return _text(
        "### `", F.col("function"), "`\n\n**File:** `", F.col("file"), "`\n**Risk Level:** ", impact_level(F.col("n_callers")), "\n**Callers:** ", F.col("n_callers"), "\n\n", tests,
        _listed("Direct Callers", F.col("callers"), F.col("n_callers"), SHOWN_CALLERS), _listed("Calls", F.col("callees"), F.col("n_callees"), SHOWN_CALLEES), "---\n\n",
    )


# Titles and texts of the impact report's levels.
IMPACT = (
    ("HIGH", "## High Impact Functions\n\nFunctions with 3 or more callers - changes here have wide-reaching effects.\n\n"),
    ("MEDIUM", "## Medium Impact Functions\n\nFunctions with 1-2 callers - changes affect a limited scope.\n\n"),
    ("LOW", "## Low Impact Functions\n\nFunctions with no callers - may be entry points, tests, or dead code.\n\n"),
)


def impact_report(functions: DataFrame, totals: DataFrame, packages: DataFrame, language: str, warnings: Sequence[str] = (), partial: bool = False) -> DataFrame:
    """The blocks of one report. functions: see impact_block; totals: one row of n_functions, direct_callers, transitive_callers, affected_tests, n_packages; packages: package, first_ord."""
    told = ["- **Partial Results:** Some functions could not be fully analyzed.\n"] * partial + [f"- {w}\n" for w in warnings]
    head = f"# Impact Summary\n\n**Language:** {language}\n\n" + ("## Warnings\n\n" + "".join(told) + "\n" if told else "")
    rows = (("Modified Functions", "n_functions"), ("Direct Callers", "direct_callers"), ("Transitive Callers", "transitive_callers"), ("Affected Tests", "affected_tests"), ("Affected Packages", "n_packages"))
    table = _text(head, "## Summary Metrics\n\n| Metric | Value |\n|--------|-------|\n", *(x for title, c in rows for x in (f"| {title} | ", F.col(c), " |\n")), "\n", F.when(F.col("n_packages") > 0, "### Affected Packages\n\n"))
    put = lambda d, part, order, text: d.select(F.lit(part).alias("part"), order.cast("long").alias("ord"), text.alias("text"))
    out = put(totals, 0, F.lit(0), table)
    out = out.unionByName(put(numbered_rows(packages, ["first_ord", "package"]), 1, F.col("nth"), _text("- `", F.col("package"), "`\n")))
    out = out.unionByName(put(totals.where("n_packages > 0"), 2, F.lit(0), F.lit("\n")))
    level = impact_level(F.col("n_callers"))
    numbered = numbered_rows(functions.withColumn("text", impact_block()), ["file", "function"])
    for i, (name, title) in enumerate(IMPACT):
        of = numbered.where(level == name)
        out = out.unionByName(put(of.limit(1), 3 + 2 * i, F.lit(0), F.lit(title))).unionByName(put(of, 4 + 2 * i, F.col("nth"), F.col("text")))
    none = "## No Modified Functions Analyzed\n\nNo functions were found in the modified files for call graph analysis.\n\n"
    return out.unionByName(put(totals.where("n_functions = 0"), 9, F.lit(0), F.lit(none)))


# The security report's texts.
LIMITS = "## Analysis Limits\n\n- Data flow tracking is heuristic and primarily intra-file; flows that cross function boundaries may be under-reported.\n\n"
ADVICE = """## General Recommendations

1. **Input Validation**: Always validate and sanitize user input at the entry point.
2. **Parameterized Queries**: Use prepared statements or parameterized queries for all database operations.
3. **Output Encoding**: Encode output appropriately for the context (HTML, URL, JavaScript).
4. **Nil Checks**: Always check for nil/null before dereferencing pointers or optional values.
5. **Principle of Least Privilege**: Avoid command execution; if required, use strict allow lists.
6. **Security Testing**: Integrate security scanning into CI/CD pipelines for continuous monitoring.
"""
_METRICS = (("Total Sources", "total_sources"), ("Total Sinks", "total_sinks"), ("Total Flows", "total_flows"), ("Unsanitized Flows", "unsanitized_flows"), ("Critical Risk Flows", "critical_flows"), ("High Risk Flows", "high_risk_flows"), ("Nil/Null Risks", "nil_risks"))
_BY_LANGUAGE = (("Sources", "total_sources"), ("Sinks", "total_sinks"), ("Flows", "total_flows"), ("Unsanitized", "unsanitized_flows"), ("Critical", "critical_flows"), ("High", "high_risk_flows"), ("Nil Risks", "nil_risks"))


def flow_block(number: Column) -> Column:
    """One flow of high or critical risk, of columns risk, description, source_ and sink_ file, line, type and context, function, sanitized, sanitizers."""
    e = lambda c: escape_markdown(F.coalesce(F.col(c).cast("string"), F.lit("")))
    context = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", _text(f"**{title} Context:**\n```\n", escape_fence(F.col(c)), "\n```\n\n"))
    return _text(
        "### ", F.upper("risk"), " Flow ", number, ": ", e("description"), "\n\n**Risk Level:** ", capitalised(F.col("risk")), "\n\n",
        "**Source:** `", e("source_file"), ":", F.col("source_line"), "` (Type: ", e("source_type"), ")\n\n", "**Sink:** `", e("sink_file"), ":", F.col("sink_line"), "` (Function: ", e("function"), ")\n\n",
        F.when(F.col("sanitized"), _text("**Sanitized:** Yes (Sanitizers: ", e("sanitizers"), ")\n\n")).otherwise("**Sanitized:** No\n\n"), context("Source", "source_context"), context("Sink", "sink_context"),
        "**Recommendation:** ", dims.mapped(F.col("sink_type"), dims.RECOMMENDATIONS, dims.OTHER_RECOMMENDATION), "\n\n---\n\n",
    )


def security_report(statistics: DataFrame, flows: DataFrame, nils: DataFrame, generated: str) -> DataFrame:
    """The blocks of one report over all languages. statistics: language and A04's counters; flows: see flow_block; nils: file, line, variable, pattern, origin, is_checked, risk."""
    put = lambda d, part, order, text: d.select(F.lit(part).alias("part"), order.cast("long").alias("ord"), text.alias("text"))
    total = statistics.agg(F.count_distinct("language").alias("languages"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for _, c in _METRICS), F.coalesce(F.sum("unchecked_nil_risks"), F.lit(0)).alias("unchecked"))
    critical, high, nil = F.col("critical_flows"), F.col("high_risk_flows"), F.col("unchecked")
    head = _text(
        f"# Security Data Flow Analysis\n\n**Generated:** {generated}\n\n## Executive Summary\n\n| Metric | Value |\n|--------|-------|\n| Languages Analyzed | ", F.col("languages"), " |\n",
        *(x for title, c in _METRICS for x in (f"| {title} | ", F.col(c), " |\n")), "\n## Risk Assessment\n\n",
        F.when(critical > 0, _text("### CRITICAL (", critical, " issues)\n\nCritical security vulnerabilities detected that require immediate attention.\n\n")),
        F.when(high > 0, _text("### HIGH (", high, " issues)\n\nHigh-risk security issues that should be addressed promptly.\n\n")),
        F.when(nil > 0, _text("### NIL SAFETY (", nil, " issues)\n\nUnchecked nil/null values that may cause runtime panics or crashes.\n\n")),
        F.when((critical == 0) & (high == 0) & (nil == 0), "No critical, high-risk, or unchecked nil safety issues detected.\n\n"), LIMITS, F.when((critical > 0) | (high > 0), "## Critical & High Risk Flows\n\n"),
    )
    out = put(total, 0, F.lit(0), head)
    serious = flows.where(F.col("risk").isin("critical", "high")).withColumn("__rank", dims.mapped(F.col("risk"), dims.RISK_ORDER, 9))
    numbered = numbered_rows(serious, ["__rank", "source_file", "source_line", "sink_line", "id"])
    out = out.unionByName(put(numbered, 1, F.col("nth"), flow_block(F.col("nth"))))
    e = lambda c: escape_markdown(F.coalesce(F.col(c), F.lit("")))
    row = _text("| ", e("file"), " | ", F.col("line"), " | ", e("variable"), " | ", e("pattern"), " | ", e("origin"), " | ", F.when(F.col("is_checked"), "Yes").otherwise("No"), " | ", capitalised(F.col("risk")), " |\n")
    some = nils.limit(1)
    out = out.unionByName(put(some, 2, F.lit(0), F.lit("## Nil/Null Safety Issues\n\n| File | Line | Variable | Pattern | Origin | Checked | Risk |\n|------|------|----------|---------|--------|---------|------|\n")))
    out = out.unionByName(put(numbered_rows(nils, ["file", "line", "variable", "pattern"]), 3, F.col("nth"), row)).unionByName(put(some, 4, F.lit(0), F.lit("\n")))
    by = _text("### ", capitalised(F.col("language")), "\n\n| Metric | Value |\n|--------|-------|\n", *(x for title, c in _BY_LANGUAGE for x in (f"| {title} | ", F.col(c), " |\n")), "\n")
    out = out.unionByName(put(total.where("languages > 0"), 5, F.lit(0), F.lit("## Language Breakdown\n\n")))
    out = out.unionByName(put(numbered_rows(statistics, ["language"]), 6, F.col("nth"), by))
    return out.unionByName(put(total, 7, F.lit(0), F.lit(ADVICE)))


def document(blocks: DataFrame) -> DataFrame:
    """One row with a whole report; for reports that a reader takes in. Larger ones are written block by block."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "ord", "text")))
    return blocks.agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("document"))
