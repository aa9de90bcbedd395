"""Linter output as findings: JSON documents, JSON lines, text, DOT and module graphs.

Every decoder takes rows with a text column and gives tool, rule, severity, file, line, column,
message, category; malformed documents and lines give no rows. results() is their form with an error
channel: what could not be read is a row of its own, beside the findings, from one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.findings import category_of, first_line, severity_of

# Documents of the tools, as schemas; the path of their list; and where a finding's parts stand.
_POS = "STRUCT<Filename STRING, Line INT, Column INT>"
DOCUMENTS = {
    "golangci-lint": (f"STRUCT<Issues ARRAY<STRUCT<FromLinter STRING, Text STRING, Severity STRING, Pos {_POS}>>>", "Issues", ("FromLinter", "Severity", "Pos.Filename", "Pos.Line", "Pos.Column", "Text")),
    "gosec": ("STRUCT<Issues ARRAY<STRUCT<severity STRING, confidence STRING, rule_id STRING, details STRING, file STRING, line STRING, column STRING>>>", "Issues", ("rule_id", "severity", "file", "line", "column", "details")),
    "ruff": ("ARRAY<STRUCT<code STRING, message STRING, location STRUCT<row INT, column INT>, filename STRING>>", None, ("code", None, "filename", "location.row", "location.column", "message")),
    "pylint": ("ARRAY<STRUCT<type STRING, line INT, column INT, path STRING, symbol STRING, message STRING, `message-id` STRING>>", None, ("`message-id`", "type", "path", "line", "column", "message")),
    "bandit": ("STRUCT<results ARRAY<STRUCT<filename STRING, test_name STRING, issue_text STRING, issue_severity STRING, issue_confidence STRING, line_number INT, test_id STRING>>>", "results", ("test_id", "issue_severity", "filename", "line_number", None, "issue_text")),
}
LINES = {
    "mypy": ("STRUCT<file STRING, line INT, column INT, severity STRING, code STRING, message STRING>", ("code", "severity", "file", "line", "column", "message")),
    "staticcheck": ("STRUCT<code STRING, severity STRING, location STRUCT<file STRING, line INT, column INT>, message STRING>", ("code", "severity", "location.file", "location.line", "location.column", "message")),
}
#: What stands before the message.
_TITLED = {"pylint": "symbol", "bandit": "test_name"}
#: Tools whose blank output is no error.
_MAY_BE_BLANK = ("golangci-lint", "ruff")
_ESLINT = "ARRAY<STRUCT<filePath STRING, messages ARRAY<STRUCT<ruleId STRING, severity INT, message STRING, line INT, column INT>>>>"
_COLUMNS = ("tool", "rule", "severity", "file", "line", "column", "message", "category")
_TSC = r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$"


def _finding(tool: str, item: str, parts: tuple) -> list[Column]:
    rule, level, file, line, column, message = (F.col(f"{item}.{p}") if p else F.lit("") for p in parts)
    confidence = F.col(f"{item}.confidence") if tool == "gosec" else F.col(f"{item}.issue_confidence") if tool == "bandit" else F.lit("")
    number = lambda c: first_line(c.cast("string")).alias
    if tool in _TITLED:
        message = F.concat(F.coalesce(F.col(f"{item}.{_TITLED[tool]}"), F.lit("")), F.lit(": "), F.coalesce(message, F.lit("")))
    if tool == "bandit":  # it tells no columns
        column = F.lit(1)
    return [
        F.lit(tool).alias("tool"), F.coalesce(rule, F.lit("")).alias("rule"), severity_of(F.lit(tool), level, rule, confidence).alias("severity"), file.alias("file"),
        number(line)("line"), number(column)("column"), message.alias("message"), category_of(F.lit(tool), rule, level).alias("category"),
    ]


def json_document(payloads: DataFrame, tool: str, text: str = "payload") -> DataFrame:
    """S18."""
    schema, path, parts = DOCUMENTS[tool]
    doc = F.from_json(F.col(text), schema)
    return payloads.select(F.explode(doc[path] if path else doc).alias("i")).select(*_finding(tool, "i", parts))


def eslint(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """S18, two levels; a message without a rule is a parse error."""
    files = payloads.select(F.explode(F.from_json(F.col(text), _ESLINT)).alias("f"))
    rows = files.select(F.col("f.filePath").alias("filePath"), F.explode("f.messages").alias("m"))
    flat = rows.select(F.struct(F.coalesce("m.ruleId", F.lit("parse-error")).alias("rule"), F.col("m.severity").cast("string").alias("level"), "filePath", "m.line", "m.column", "m.message").alias("i"))
    return flat.select(*_finding("eslint", "i", ("rule", "level", "filePath", "line", "column", "message")))


def json_lines(payloads: DataFrame, tool: str, text: str = "payload") -> DataFrame:
    """Malformed lines are skipped."""
    schema, parts = LINES[tool]
    rows = payloads.select(F.explode(F.split(text, "\n")).alias("l")).select(F.from_json("l", schema).alias("i"))
    return rows.where("i is not null and i.message is not null").select(*_finding(tool, "i", parts))


def tsc(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """file(line,column): error TS1234: message."""
    return tsc_rows(payloads, text, ())


def tsc_rows(payloads: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """S19, behind the columns keep."""
    rows = payloads.select(*keep, F.explode(F.split(text, "\r?\n")).alias("l")).where(F.col("l").rlike(_TSC))
    g = lambda i: F.regexp_extract("l", _TSC, i)
    parts = rows.select(*keep, F.struct(g(5).alias("rule"), g(4).alias("level"), g(1).alias("file"), g(2).alias("line"), g(3).alias("column"), g(6).alias("message")).alias("i"))
    return parts.select(*keep, *_finding("tsc", "i", ("rule", "level", "file", "line", "column", "message")))


def dot_edges(texts: DataFrame, text: str = "dot") -> DataFrame:
    """Caller and callee of each arrow."""
    pattern = r'"?([^"\s;\[]+)"?\s*->\s*"?([^"\s;\[]+)"?'
    lines = texts.select(F.explode(F.split(text, "\n")).alias("l")).where(F.col("l").contains("->"))
    return lines.select(F.regexp_extract("l", pattern, 1).alias("caller"), F.regexp_extract("l", pattern, 2).alias("callee")).where("caller <> ''")


def module_graph(texts: DataFrame, text: str = "payload") -> DataFrame:
    """Source and resolved path of each dependency."""
    doc = F.from_json(F.col(text), "STRUCT<modules ARRAY<STRUCT<source STRING, dependencies ARRAY<STRUCT<resolved STRING>>>>>")
    modules = texts.select(F.explode(doc["modules"]).alias("m"))
    return modules.select(F.col("m.source").alias("source"), F.explode("m.dependencies.resolved").alias("resolved"))


def scope_paths(texts: DataFrame, text: str = "payload") -> DataFrame:
    """Paths of a scope document whose files are a list, or lists by status."""
    plain = F.from_json(F.col(text), "STRUCT<files ARRAY<STRING>>")["files"]
    grouped = F.from_json(F.col(text), "STRUCT<files STRUCT<modified ARRAY<STRING>, added ARRAY<STRING>, deleted ARRAY<STRING>>>")["files"]
    none = F.expr("cast(array() as array<string>)")
    either = F.when(F.get_json_object(text, "$.files").startswith("["), plain).otherwise(F.concat(F.coalesce(grouped["modified"], none), F.coalesce(grouped["added"], none)))
    return texts.select(F.explode(F.filter(either, lambda x: x.isNotNull())).alias("path"))


def _read(text: Column, schema: str) -> Column:
    """struct<d, good>: a text as a value of schema, and whether all of it is one JSON value of that shape (null among them)."""
    # the mark behind the text shows that the value ended where the text does
    mark = F.xxhash64(text)
    whole = F.concat(F.lit('{"d":'), text, F.lit(',"mark":'), mark.cast("string"), F.lit("}"))
    v = F.from_json(whole, f"d {schema}, mark BIGINT, broken STRING", {"columnNameOfCorruptRecord": "broken"})
    return F.struct(v["d"].alias("d"), F.coalesce(v["broken"].isNull() & (v["mark"] == mark), F.lit(False)).alias("good"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _position_error(item: Column, part: str) -> Column:
    """Why a position of gosec, a number or a range a-b, has no number; null if it has one."""
    value = F.trim(F.coalesce(item[part], F.lit("")))
    first = F.trim(F.substring_index(value, "-", 1))
    why = F.when(value == "", "empty position").when(first.try_cast("int").isNull(), F.concat(F.lit("strconv.Atoi: parsing "), _quoted(first), F.lit(": invalid syntax")))
    told = F.concat(F.lit("gosec output parse warning: file="), F.coalesce(item["file"], F.lit("")), F.lit(" line="), _quoted(item["line"]), F.lit(" column="), _quoted(item["column"]), F.lit(" err="), why)
    return F.when(why.isNotNull(), told)


def results(payloads: DataFrame, tool: str, text: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """The columns keep of a payload, then a finding (with a null error) or an error (with null elsewhere but for tool).

    A document that is not one JSON value of the tool's shape is one error. JSON's null and missing
    lists hold nothing; missing values are empty ones. Blank output is an error but for golangci-lint
    and ruff; malformed lines of mypy and staticcheck are left out, as are lines that tsc's pattern
    does not fit. A null payload, a tool that was not run, gives no rows. gosec's positions that are
    no numbers are errors beside their finding, which has 0 there. A number where a text is expected is
    taken as its text. Names of keep are not those of the result.
    """
    t = F.col(text)
    broken = F.lit(f"{tool} output parse warning: malformed document")
    plain = F.trim(F.regexp_replace(t, r"\s+", " "))
    if tool == "tsc":
        return tsc_rows(payloads.where(t.isNotNull()), text, keep).withColumn("error", F.lit(None).cast("string"))
    if tool in LINES:
        schema, parts = LINES[tool]
        lines = payloads.select(*keep, F.explode(F.split(t, "\n")).alias("__line")).where("trim(both ' \t\r' from __line) <> ''")
        rows = lines.withColumn("__r", _read(F.col("__line"), schema)).where("__r.good").select(*keep, F.col("__r.d").alias("__i"), F.lit(None).cast("string").alias("__error"))
    else:
        if tool == "eslint":
            schema, parts = _ESLINT, ("rule", "level", "filePath", "line", "column", "message")
        else:
            schema, path, parts = DOCUMENTS[tool]
        read = payloads.where(t.isNotNull()).select(*keep, _read(t, schema).alias("__r"), (plain == "").alias("__blank"))
        value = F.col("__r.d")
        if tool == "eslint":
            rule = lambda m: F.when(F.coalesce(m["ruleId"], F.lit("")) == "", "parse-error").otherwise(m["ruleId"])
            item = lambda f, m: F.struct(rule(m).alias("rule"), m["severity"].cast("string").alias("level"), f["filePath"].alias("filePath"), m["line"].alias("line"), m["column"].alias("column"), m["message"].alias("message"))
            none = F.array_repeat(item(F.get(value, F.lit(0)), F.get(F.get(value, F.lit(0))["messages"], F.lit(0))), 0)
            listed = F.flatten(F.transform(value, lambda f: F.coalesce(F.transform(f["messages"], lambda m: item(f, m)), none)))
        else:
            listed = value[path] if path else value
        entry = lambda i, e: F.struct(i.alias("item"), e.cast("string").alias("error"))
        fine = F.transform(listed, lambda i: entry(i, F.lit(None)))
        bad = F.array(entry(F.get(listed, F.lit(0)), broken))
        silent = F.col("__blank") if tool in _MAY_BE_BLANK else F.lit(False)
        rows = read.select(*keep, F.explode(F.when(F.col("__r.good"), fine).when(~silent, bad)).alias("__e")).select(*keep, F.col("__e.item").alias("__i"), F.col("__e.error").alias("__error"))
    shown = F.struct(*(F.coalesce(c, F.lit(0) if n in ("line", "column") else F.lit("")).alias(n) for n, c in zip(_COLUMNS, _finding(tool, "__i", parts), strict=True)))
    row = lambda v, e: F.struct(v.alias("v"), e.alias("e"))
    only = F.when(F.col("__error").isNull(), shown)
    if tool == "gosec":
        i = F.col("__i")
        late = [F.when(F.col("__error").isNull() & e.isNotNull(), row(F.when(F.lit(False), shown), e)) for e in (_position_error(i, "line"), _position_error(i, "column"))]
        rows = rows.select(*keep, F.explode(F.array_compact(F.array(row(only, F.col("__error")), *late))).alias("__o"))
    else:
        rows = rows.select(*keep, row(only, F.col("__error")).alias("__o"))
    value = lambda n: F.lit(tool) if n == "tool" else F.col(f"__o.v.{n}")
    return rows.select(*keep, *(value(n).alias(n) for n in _COLUMNS), F.col("__o.e").alias("error"))


def findings_of(results_: DataFrame) -> DataFrame:
    """The findings among results()."""
    return results_.where("error is null").drop("error")


def errors_of(results_: DataFrame) -> DataFrame:
    """The errors among results(): what came with them, tool and error."""
    return results_.where("error is not null").drop(*(c for c in _COLUMNS if c != "tool"))
