"""Escaping and redaction of text for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with a meaning in Markdown, and what they become, in order.
MARKDOWN = (
    ("`", "\\`"), ("*", "\\*"), ("_", "\\_"), ("[", "\\["), ("]", "\\]"), ("(", "\\("), (")", "\\)"), ("#", "\\#"), ("|", "\\|"),
    ("<", "&lt;"), (">", "&gt;"), ("\n", " "), ("\r", " "), ("\t", " "),
)
# Shapes of secrets and their markers, in order.
SECRETS = (
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED:aws-access-key]"),
    (r"\bASIA[0-9A-Z]{16}\b", "[REDACTED:aws-temp-access-key]"),
    (r"\bgh[pusor]_[A-Za-z0-9]{20,}\b", "[REDACTED:github-token]"),
    (r"\bxox[abpsr]-[A-Za-z0-9-]{10,}\b", "[REDACTED:slack-token]"),
    (r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b", "[REDACTED:stripe-secret]"),
    (r"\bpk_(?:live|test)_[A-Za-z0-9]{16,}\b", "[REDACTED:stripe-publishable]"),
    (r"\bAIza[0-9A-Za-z\-_]{35}\b", "[REDACTED:google-api-key]"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED:private-key]"),
    (r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b", "[REDACTED:jwt]"),
    (r"\b(?:postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|amqp|amqps)://[^:\s/]+:[^@\s]+@[^\s]+", "[REDACTED:db-uri]"),
    (r"""(?i)(password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*['"][^'"\s]{12,}['"]""", "[REDACTED:credential-assignment]"),
)
# Attempts to instruct a reader that is a model, in order.
INJECTIONS = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"(?i)disregard\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"(?i)forget\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"(?i)you\s+are\s+now\s+(?:a|an)\s+",
    r"(?i)new\s+instructions?:\s*",
    r"(?i)system\s+prompt\s*[:=]",
    r"(?i)<\s*/?\s*(?:system|assistant|user)\s*>",
)
INJECTION_MARKER = "[REDACTED:prompt-injection]"


def escape_markdown(c: Column) -> Column:
    """All replacements at once, as none makes another's character: a backslash is no key."""
    for old, new in MARKDOWN:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_fence(c: Column) -> Column:
    """M18."""
    return F.replace(c, F.lit("```"), F.lit("` ` `"))


def redact_secrets(c: Column) -> Column:
    """M19."""
    for p, marker in SECRETS:
        c = F.regexp_replace(c, p, marker)
    return c


def redact_injections(c: Column) -> Column:
    """M20."""
    for p in INJECTIONS:
        c = F.regexp_replace(c, p, INJECTION_MARKER)
    return c


def sanitized(c: Column) -> Column:
    """Secrets, then instructions, then Markdown."""
    return escape_markdown(redact_injections(redact_secrets(c)))


def capitalised(c: Column) -> Column:
    """The first character only."""
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def first_filled(*cs: Column) -> Column:
    """The first value that is not blank, as it is."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in cs), F.lit(""))


def split_options(c: Column) -> Column:
    """M26."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
