"""Writing results: tables by language, single documents, and reports block by block."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, by_language: bool = False) -> None:
    """JSON lines; the committer makes the write atomic. by_language splits on the column language."""
    w = df.write.mode("errorifexists")
    (w.partitionBy("language") if by_language else w).json(path)


def write_document(path: str, value: object, indent: int | None = 2, mode: int = 0o600) -> None:
    """One small document where the driver runs: indented, with a line end, by a temporary file that is renamed, for its owner alone. A link is never followed."""
    if os.path.islink(path):
        raise OSError(f"refusing to write to symlink path: {path}")
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, mode=0o700, exist_ok=True)
    at, name = tempfile.mkstemp(prefix=".document-", suffix=".tmp", dir=folder)
    try:
        with os.fdopen(at, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=indent, ensure_ascii=False)
            f.write("\n")
            os.fchmod(f.fileno(), mode)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_by_language(documents: DataFrame, path: str) -> None:
    """A combined table of documents, and beside it one folder a language. documents: language, document."""
    documents.write.mode("errorifexists").json(f"{path}/mixed")
    documents.write.mode("errorifexists").partitionBy("language").json(f"{path}/by-language")


def write_call_graph(graph: dict[str, DataFrame], report: DataFrame, path: str, language: str) -> None:
    """Functions and neighbours as JSON, the impact report as Markdown."""
    for name in ("functions", "neighbours", "coverage", "packages", "totals"):
        write_json(graph[name], f"{path}/{language}-calls/{name}")
    write_blocks(report, f"{path}/{language}-impact-summary")


def write_flows(analysis: dict[str, DataFrame], report: DataFrame, path: str, language: str) -> None:
    """An analysis' tables as JSON, the security report as Markdown."""
    for name in ("sources", "sinks", "flows", "nil_sources", "statistics"):
        write_json(analysis[name], f"{path}/{language}-flow/{name}")
    write_blocks(report, f"{path}/{language}-security-summary")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """A report as text files that follow each other by name; blocks: part, ord, text, each of which ends a line."""
    lines = F.regexp_replace("text", r"\n\z", "").alias("value")  # the writer ends each row's last line itself
    blocks.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select(lines).write.mode("errorifexists").text(path)


def write_text(documents: DataFrame, path: str, name: str) -> None:
    """A text for each row, in a folder by name."""
    documents.write.mode("errorifexists").partitionBy(name).text(path)
