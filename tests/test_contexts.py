"""Templates and the reviewers' documents."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidemark.functions import templates as tp
from tidemark.operators import contexts as cx
from tidemark.operators import sinks


def whole(blocks):
    return "".join(r.text for r in blocks.orderBy("part", "ord").collect())


def frame(spark, name, *rows):
    return spark.createDataFrame([*rows], cx.TABLES[name])


FUNCTION = ("handler", "CreateUser", "user.go", ("func CreateUser(ctx context.Context)", 10, 20), ("func CreateUser(ctx context.Context, opts ...Option)", 10, 30), ["added_param", "x"])
FOCUS = "\n\n## Focus Areas\n\nBased on analysis, pay special attention to:\n"
NO_FOCUS = FOCUS + "\n\nNo specific focus areas identified.\n\n"


def test_code_reviewer(spark):
    tables = {
        "Findings": frame(spark, "Findings", ("warning", "tool|name", "SA1019", "user.go", 45, "bad\nmessage"), ("info", "golangci-lint", "x", "repo.go", 23, "unused var")), "ModifiedFunctions": frame(spark, "ModifiedFunctions", FUNCTION),
        "AddedFunctions": frame(spark, "AddedFunctions", ("p", "New", "n.go", 3)), "FocusAreas": frame(spark, "FocusAreas", ("Deprecated API", "grpc.Dial needs update")),
        "ModifiedTypes": frame(spark, "ModifiedTypes", ("User", "struct", "u.go", ([("ID", "int"), ("Name", "string"), ("Deleted", "bool")],), ([("ID", "int64"), ("Name", "string"), ("Email", "string")],))),
    }
    assert whole(cx.reviewer_document(spark, "code-reviewer", tables)) == (
        "# Pre-Analysis Context: Code Quality\n\n## Static Analysis Findings (2 issues)\n\n\n| Severity | Tool | File | Line | Message |\n|----------|------|------|------|---------|\n"
        "| info | golangci-lint | repo.go | 23 | unused var |\n| warning | tool\\|name | user.go | 45 | bad message |\n\n\n## Semantic Changes\n\n\n### Functions Modified (1)\n\n"
        "#### `handler.CreateUser`\n**File:** `user.go:10-30`\n**Changes:** added\\_param, x\n\n\n```diff\n- func CreateUser\\(ctx context.Context\\)\n+ func CreateUser\\(ctx context.Context, opts ...Option\\)\n```\n\n\n\n"
        "### Functions Added (1)\n\n- `p.New` at `n.go:3`\n\n\n### Types Modified (1)\n\n#### `User`\n**File:** `u.go`\n\n| Field | Before | After |\n|-------|--------|-------|\n| ID | int | int64 |\n| Email | - | string (added) |\n| Deleted | bool | (deleted) |\n\n"
        + FOCUS + "\n1. **Deprecated API** - grpc.Dial needs update\n\n"
    )


GRAPH = [("Run", "a.go", [("Main", "m.go", 3), ("TestRun", "a_test.go", 9), ("X", "x.go", 1)], [("dep", "d.go", 2)], [("TestRun", "a_test.go", 9)]), ("Idle", "b.go", [], [], [])]


def test_test_reviewer(spark):
    head = "# Pre-Analysis Context: Testing\n\n## Test Coverage for Modified Code\n\n"
    table = "\n| Function | File | Tests | Status |\n|----------|------|-------|--------|\n"
    got = cx.reviewer_document(spark, "test-reviewer", {"AllModifiedFunctionsGraph": frame(spark, "AllModifiedFunctionsGraph", *GRAPH), "UncoveredFunctions": frame(spark, "UncoveredFunctions", GRAPH[1])}, partial=True, time_exceeded=True, warnings=("a_b",))
    assert whole(got) == head + "\n\n> Warning: call graph analysis is partial (time budget exceeded).\n\n\n\n**Call Graph Warnings:**\n\n- a\\_b\n\n\n" + table + "| `Idle` | b.go | 0 tests | No tests |\n| `Run` | a.go | 1 tests | 1 tests |\n\n\n## Uncovered New Code\n\n\n\n- `Idle` at `b.go` - **No tests found**\n" + NO_FOCUS
    covered = cx.reviewer_document(spark, "test-reviewer", {"AllModifiedFunctionsGraph": frame(spark, "AllModifiedFunctionsGraph", GRAPH[0])})
    assert "All modified code has test coverage." in whole(covered) and "Warning" not in whole(covered)
    assert "No callgraph data available." in whole(cx.reviewer_document(spark, "test-reviewer", {}, HasCallGraph=True))
    assert "No call graph analysis available for test coverage." in whole(cx.reviewer_document(spark, "test-reviewer", {}))


def test_business_reviewer(spark):
    got = whole(cx.reviewer_document(spark, "business-logic-reviewer", {"HighImpactFunctions": frame(spark, "HighImpactFunctions", GRAPH[0]), "ModifiedFunctions": frame(spark, "ModifiedFunctions", FUNCTION)}))
    assert "**Risk Level:** HIGH (3 direct callers)\n\n**Direct Callers (signature change affects these):**\n\n1. `Main` - `m.go:3`\n2. `TestRun` - `a\\_test.go:9`\n3. `X` - `x.go:1`\n\n**Callees (this function depends on):**\n\n1. `dep`\n\n\n## Semantic Changes" in got.replace("\n\n\n\n", "\n\n\n")
    assert "\n1. **`handler.CreateUser`** - added\\_param, x\n" in got


def test_security_nil_and_dead_code(spark):
    flow = lambda n, s: (n, "high", "no check", s, ("http_request", "h.go", 45, "r.URL"), ("database", "r.go", 23, "db.Query(q)"))
    got = whole(cx.reviewer_document(spark, "security-reviewer", {"HighRiskFlows": frame(spark, "HighRiskFlows", flow("f-1", False), flow("f-2", True)), "MediumRiskFlows": frame(spark, "MediumRiskFlows", flow("m", False))}))
    assert "#### f-1: http\\_request -> database\n**File:** `h.go:45`\n**Risk:** high\n**Notes:** no check\n\n**Source:** `r.URL`\n**Sink:** `db.Query\\(q\\)`\n**Sanitized:** No\n" in got and "**Sanitized:** Yes" in got
    assert "### Medium Risk Flows (1)\n\n- http\\_request -> database at `h.go:45` (no check)\n" in got and "No security scanner findings." in got
    nil = frame(spark, "NilSources", ("v", "a.go", 3, True, 5, "f()", "high", "n"), ("w", "a.go", 4, False, 0, "g()", "low", ""))
    got = whole(cx.reviewer_document(spark, "nil-safety-reviewer", {"NilSources": nil, "HighRiskNilSources": nil.where("Risk = 'high'")}))
    assert "| `v` | a.go | 3 | Yes | high |\n| `w` | a.go | 4 | No | low |\n" in got and "**Checked:** Yes (line 5)\n" in got
    got = whole(cx.reviewer_document(spark, "dead-code-reviewer", {"ZombieTests": frame(spark, "ZombieTests", GRAPH[0]), "OrphanFunctions": frame(spark, "OrphanFunctions", GRAPH[1])}))
    assert "| `Idle` | b.go | 0 | 0 |\n" in got and "**Tests still referencing it:**\n\n1. `TestRun` - `a\\_test.go:9`\n" in got and "No deleted functions." in got


def test_consequences(spark):
    tables = {"SignatureChanges": frame(spark, "SignatureChanges", FUNCTION), "ImportsRemoved": frame(spark, "ImportsRemoved", ("f.go", "fmt", None), ("f.py", None, "os")), "ErrorReturnsAdded": frame(spark, "ErrorReturnsAdded", ("F", "f.go", 4, "error", "m"))}
    got = whole(cx.reviewer_document(spark, "consequences-reviewer", tables))
    assert "**Added imports (0):**\n\n\n**Removed imports (2):**\n\n- `fmt` in `f.go`\n- `os` in `f.py`\n" in got and "- `F` at `f.go:4` returns `error` - m\n" in got and "No removed error checks." in got and "No type shape changes." in got


@pytest.mark.parametrize("name", cx.TEMPLATES)
def test_nothing_to_tell(spark, name, tmp_path):
    blocks = cx.reviewer_document(spark, name, {})
    text = whole(blocks)
    assert text.startswith("# Pre-Analysis Context: ") and text.endswith(NO_FOCUS)
    assert [r.text for r in cx.lines(blocks).orderBy("line").collect()] == text.split("\n")[:-1]
    sinks.write_blocks(blocks.where("text <> ''"), f"{tmp_path}/r")
    got = ""
    for part in sorted(x for x in os.listdir(f"{tmp_path}/r") if x.startswith("part-")):
        with open(f"{tmp_path}/r/{part}") as f:
            got += f.read()
    assert got == text


def ranges(spark, monkeypatch, name, **tables):
    """What a document's tables are dealt out by, of which the driver gets samples; the document."""
    from tidemark.sources import store

    plans, write = [], store.stored
    monkeypatch.setattr(store, "stored", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label))
    got = whole(cx.reviewer_document(spark, name, tables))
    return [x for p in plans for x in p.split("\n") if "RepartitionByExpression" in x], got


def many(n):
    """A function of one name and file again and again, so only the lists tell its rows apart."""
    return [("Run", "a.go", [(f"C{i}", "m.go", j) for j in range(3)], [("dep", "d.go", i)], [("TestRun", "a_test.go", i)]) for i in reversed(range(n))]


def test_no_callers_at_the_driver_business(spark, monkeypatch):
    """the driver got whole rows as samples for the ranges, with every caller of a function."""
    dealt, got = ranges(spark, monkeypatch, "business-logic-reviewer", HighImpactFunctions=frame(spark, "HighImpactFunctions", *many(5), ("Also", "z.go", [("X", "x.go", 1)] * 3, [], [])))
    assert len(dealt) == 1 and "Function" in dealt[0] and "Call" not in dealt[0] and "Test" not in dealt[0]
    assert got.index("#### `Also`") < got.index("#### `Run`") and [got.index(f"1. `C{i}`") for i in range(5)] == sorted(got.index(f"1. `C{i}`") for i in range(5))


def test_no_callers_at_the_driver_consequences(spark, monkeypatch):
    """as F2, for the chain of callers."""
    dealt, got = ranges(spark, monkeypatch, "consequences-reviewer", CallerImpactedFunctions=frame(spark, "CallerImpactedFunctions", *many(3)))
    assert len(dealt) == 1 and "Function" in dealt[0] and "Call" not in dealt[0] and "Test" not in dealt[0]
    assert got.index("1. `C0`") < got.index("1. `C1`") < got.index("1. `C2`")


def test_no_callers_at_the_driver_tests(spark, monkeypatch):
    """as F2, for both tables of the graph."""
    dealt, got = ranges(spark, monkeypatch, "test-reviewer", AllModifiedFunctionsGraph=frame(spark, "AllModifiedFunctionsGraph", *many(3)), UncoveredFunctions=frame(spark, "UncoveredFunctions", ("Idle", "b.go", [], [], [])))
    assert len(dealt) == 2 and all("Function" in d and "Call" not in d and "Test" not in d for d in dealt)
    assert got.count("| `Run` | a.go | 1 tests | 1 tests |") == 3 and "- `Idle` at `b.go`" in got


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="unknown reviewer"):
        cx.reviewer_document(spark, "nobody", {})
    with pytest.raises(ValueError, match="not known"):
        cx.reviewer_document(spark, "test-reviewer", {"Others": spark.range(1)})


ONE = "A string, N int, B boolean, L array<struct<X:string,Y:int>>, S struct<P:string>, M array<string>"


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("{{.A}}-{{.N}}-{{.B}}-{{.S.P}}", "a-3-true-p"), ("x {{- .A -}} y", "xay"), ("{{if .A}}1{{else}}2{{end}}{{if not .B}}3{{end}}", "1"), ("{{range .L}}[{{.X}}:{{.Y}}]{{end}}", "[u:1][v:0]"),
        ("{{range $i, $l := .L}}{{inc $i}}.{{$l.X}}{{if eq $i 1}}!{{end}} {{end}}", "1.u 2.v! "), ('{{join .M ", "}}|{{len .L}}', "q, r|2"), ("{{range $x := .M}}{{$x}}{{range $y := $.L}}{{end}}{{end}}", None),
        ('{{if and (eq (len .M) 2) (or .A .B)}}{{"lit"}}{{end}}', "lit"), ("{{range .M}}\n- {{.}}\n{{- end}}\nend", "\n- q\n- r\nend"), ("{{range .L}}{{range $k, $v := .X}}{{end}}{{end}}", None),
    ],
)
def test_language(spark, template, want):
    df = spark.createDataFrame([("a", 3, True, [("u", 1), ("v", 0)], ("p",), ["q", "r"])], ONE)
    if want is None:
        with pytest.raises(tp.TemplateError):
            tp.pieces(template, df.schema, {})
        return
    parts = tp.pieces(template, df.schema, {})
    assert df.select(F.concat(*(p.text for p in parts))).first()[0] == want


@pytest.mark.parametrize("template", ["{{if .A}}", "{{end}}", "{{else}}", "{{.Nope}}", "{{.A.B}}", "{{nope .A}}", "{{(.A}}", "{{.A)}}", "{{ .A", "{{range .N}}{{end}}", "{{range .T}}{{.Nope}}{{end}}", "{{len .N}}"])
def test_broken_templates(spark, template):
    with pytest.raises(tp.TemplateError):
        tp.pieces(template, StructType.fromDDL(ONE), {"T": StructType().add("C", IntegerType())})


def test_items_are_sanitised_once(spark):
    """The document's plan holds neither redaction nor the counts of its tables: both are settled before."""
    tables = {"ModifiedFunctions": frame(spark, "ModifiedFunctions", FUNCTION), "HighImpactFunctions": frame(spark, "HighImpactFunctions", GRAPH[0])}
    plan = cx.reviewer_document(spark, "business-logic-reviewer", tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Cross" not in plan


def test_tables_are_made_once(spark):
    from tidemark.plans.review_queries import _Tables

    made = []
    t = _Tables(None, impact=lambda: made.append(1) or spark.range(3), flows=lambda: made.append(2))
    assert t["impact"].count() == t["impact"].count() == 3 and made == [1] and t["findings"] is None
