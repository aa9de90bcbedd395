"""Findings and errors of linter payloads from one scan."""

import pytest

from tidemark.sources import payloads as pl

ITEM = {
    "golangci-lint": '{"Issues":[{"FromLinter":"gosec","Text":"m","Severity":"error","Pos":{"Filename":"f","Line":3,"Column":4}}]}',
    "gosec": '{"Issues":[{"severity":"HIGH","confidence":"HIGH","rule_id":"G1","details":"m","file":"f","line":"3-5","column":"4"}]}',
    "ruff": '[{"code":"S1","message":"m","location":{"row":3,"column":4},"filename":"f","fix":null}]',
    "pylint": '[{"type":"error","line":3,"column":4,"path":"f","symbol":"s","message":"m","message-id":"E1"}]',
    "bandit": '{"results":[{"filename":"f","test_name":"n","issue_text":"m","issue_severity":"LOW","issue_confidence":"LOW","line_number":3,"test_id":"B1"}]}',
    "eslint": '[{"filePath":"f","messages":[{"ruleId":null,"severity":2,"message":"m","line":3,"column":4}]}, {"filePath":"g"}]',
}
FOUND = {
    "golangci-lint": ("gosec", "high", "f", 3, 4, "m"), "gosec": ("G1", "critical", "f", 3, 4, "m"), "ruff": ("S1", "high", "f", 3, 4, "m"),
    "pylint": ("E1", "high", "f", 3, 4, "s: m"), "bandit": ("B1", "info", "f", 3, 1, "n: m"), "eslint": ("parse-error", "high", "f", 3, 4, "m"),
}


def told(spark, tool, texts):
    rows = pl.results(spark.createDataFrame(list(enumerate(texts)), "id long, payload string"), tool, keep=["id"]).collect()
    return sorted(((r.id, (r.rule, r.severity, r.file, r.line, r.column, r.message) if r.error is None else r.error) for r in rows), key=str)


@pytest.mark.parametrize("tool", list(ITEM))
def test_documents(spark, tool):
    good = ITEM[tool]
    empty = "[]" if good.startswith("[") else "{}"
    other = "{}" if good.startswith("[") else "[]"
    bad = (0, f"{tool} output parse warning: malformed document")[1]
    texts = [good, empty, "null", None, other, "{broken", good + " x", good + "} x", "", " \n", "3", '"a"', good.replace(":3", ':"x"') if tool != "gosec" else "[3", " " + good + "\n"]
    blank = [] if tool in ("golangci-lint", "ruff") else [(8, bad), (9, bad)]
    want = [(0, FOUND[tool]), (13, FOUND[tool]), *blank, *((i, bad) for i in (4, 5, 6, 7, 10, 11, 12))]
    assert told(spark, tool, texts) == sorted(want, key=str)


def test_positions(spark):
    item = lambda line, column: '{"Issues":[{"rule_id":"G1","details":"m","file":"f","line":%s,"column":%s}]}' % (line, column)
    texts = [item('"7"', '" 2 - 3"'), item('"x\\"y"', '"2"'), item("null", '"-3"'), '{"Issues":[null]}', '{"Issues":null}']
    warning = "gosec output parse warning: file={} line={} column={} err={}"
    assert told(spark, "gosec", texts) == sorted([
        (0, ("G1", "info", "f", 7, 2, "m")),
        (1, ("G1", "info", "f", 0, 2, "m")), (1, warning.format("f", '"x\\"y"', '"2"', 'strconv.Atoi: parsing "x\\"y": invalid syntax')),
        (2, ("G1", "info", "f", 0, 0, "m")), (2, warning.format("f", '""', '"-3"', "empty position")), (2, warning.format("f", '""', '"-3"', 'strconv.Atoi: parsing "": invalid syntax')),
        (3, ("", "info", "", 0, 0, "")), (3, warning.format("", '""', '""', "empty position")), (3, warning.format("", '""', '""', "empty position")),
    ], key=str)


def test_lines(spark):
    line = '{"file":"f","line":3,"column":4,"severity":"note","code":"c","message":"m"}'
    found = ("c", "info", "f", 3, 4, "m")
    assert told(spark, "mypy", [f"{line}\n\nbroken\r\n  {line}\r\n[1]\n{{}}", "", None, "null"]) == sorted([(0, found), (0, found), (0, ("", "warning", "", 0, 0, "")), (3, ("", "warning", "", 0, 0, ""))], key=str)
    assert told(spark, "staticcheck", ['{"code":"SA1","severity":"error","location":{"file":"f","line":1,"column":2},"message":"m"} x']) == []
    assert told(spark, "tsc", ["Found\na.ts(3,4): error TS1: m\n", None]) == [(0, ("TS1", "high", "a.ts", 3, 4, "m"))]


def test_split(spark):
    rows = pl.results(spark.createDataFrame([(1, ITEM["ruff"]), (2, "x")], "id long, payload string"), "ruff", keep=["id"])
    assert [r.id for r in pl.findings_of(rows).collect()] == [1] and "error" not in pl.findings_of(rows).columns
    assert [tuple(r) for r in pl.errors_of(rows).collect()] == [(2, "ruff", "ruff output parse warning: malformed document")]
    empty = pl.results(spark.createDataFrame([], "id long, payload string"), "gosec", keep=["id"])
    assert empty.collect() == [] and empty.columns == ["id", "tool", "rule", "severity", "file", "line", "column", "message", "category", "error"]
