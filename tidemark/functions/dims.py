"""Small fixed dimensions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity ranks of findings, and the scale of the reviewer filter.
SEVERITY_RANK = {"critical": 4, "high": 3, "warning": 2, "info": 1}
REVIEW_RANK = {"critical": 4, "high": 3, "medium": 2, "warning": 1, "info": 0}
SEVERITIES = ("critical", "high", "warning", "info")
# Extensions by phase.
SCOPE_EXTENSIONS = {".go": "go", ".ts": "typescript", ".tsx": "typescript", ".py": "python"}
LINT_EXTENSIONS = SCOPE_EXTENSIONS | {".pyi": "python", ".js": "typescript", ".jsx": "typescript", ".mjs": "typescript", ".cjs": "typescript"}
FLOW_EXTENSIONS = SCOPE_EXTENSIONS | {".js": "typescript", ".jsx": "typescript"}
SYMBOL_EXTENSIONS = FLOW_EXTENSIONS | {".pyi": "python"}
LANGUAGE_ALIASES = {"go": "go", "golang": "go", "typescript": "typescript", "ts": "typescript", "javascript": "typescript", "js": "typescript", "python": "python", "py": "python"}
LANGUAGE_PRIORITY = {"go": 0, "typescript": 1, "python": 2}
# Linters by language and what they take.
LINTERS = (
    ("golangci-lint", "go", "packages"), ("staticcheck", "go", "packages"), ("gosec", "go", "packages"),
    ("tsc", "typescript", "files"), ("eslint", "typescript", "files"),
    ("ruff", "python", "files"), ("mypy", "python", "files"), ("pylint", "python", "files"), ("bandit", "python", "files"),
)
# Flow types.
USER_SOURCES = ("http_body", "http_query", "http_header", "http_path", "user_input")
RISK_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
RECOMMENDATIONS = {
    "command_exec": "Remove command execution or use strict allow list",
    "database": "Use parameterized queries or prepared statements",
    "http_response": "Escape output using html.EscapeString()",
    "template": "Ensure template engine auto-escapes",
    "redirect": "Validate redirect URLs against allow list",
    "file_write": "Validate file paths and use filepath.Clean()",
    "logging": "Sanitize log output to prevent log injection",
}
OTHER_RECOMMENDATION = "Review data flow and apply appropriate sanitization"
# Reviewers in order, with their data sources.
REVIEWERS = (
    ("code-reviewer", ("static-analysis", "semantic-diff")),
    ("security-reviewer", ("static-analysis-security", "security-summary")),
    ("business-logic-reviewer", ("semantic-diff", "impact-summary", "data-flow")),
    ("test-reviewer", ("impact-summary",)),
    ("nil-safety-reviewer", ("data-flow",)),
    ("consequences-reviewer", ("impact-summary", "semantic-diff")),
    ("dead-code-reviewer", ("semantic-diff", "impact-summary")),
)


def language_of(word: Column) -> Column:
    """the language that a word stands for, "" if none."""
    return mapped(F.lower(word), LANGUAGE_ALIASES, "")


def mapped(key: Column, values: Mapping, default=None) -> Column:
    """Lookup in a fixed dimension as one CASE."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def mapped_sql(key: str, values: Mapping, default: str = "NULL") -> str:
    q = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + f" ELSE {default} END"
