from pyspark.sql import functions as F

from tidemark.operators import flows, sinks
from tidemark.operators import symbols as sy
from tidemark.sources import git, parsers, payloads


def one(spark, text, name="payload"):
    return spark.createDataFrame([(text,)], f"{name} string")


def test_name_status_and_numstat(spark):
    text = "M\0a.go\0R100\0old.go\0new.go\0A\0b.py\0C75\0x\0y\0D\0gone\0R1\0cut"
    assert list(git.decode_name_status(text)) == [("a.go", "M", None), ("new.go", "R100", "old.go"), ("b.py", "A", None), ("y", "C75", "x"), ("gone", "D", None)]
    stat = "1\t2\ta.go\0-\t-\tbin\0" + "3\t4\t\0old\0new\0" + "bad\0"
    assert list(git.decode_numstat(stat)) == [("a.go", 1, 2), ("new", 3, 4)]
    rows = git.changed_files(one(spark, "M\0a\0A\0b", "content")).select("path", "status").collect()
    assert [tuple(r) for r in rows] == [("a", "M"), ("b", "A")]
    paths = one(spark, "a/{x => y}/b", "p").union(one(spark, "a/{x => }/b", "p")).union(one(spark, "o => n", "p"))
    assert [r[0] for r in paths.select(git.new_path(F.col("p"))).collect()] == ["a/y/b", "a/b", "n"]


def test_tool_payloads(spark):
    row = lambda d: [tuple(r) for r in d.select("tool", "rule", "severity", "file", "line", "message", "category").collect()]
    assert row(payloads.json_document(one(spark, '{"Issues":[{"FromLinter":"gosec","Text":"t","Severity":"error","Pos":{"Filename":"a.go","Line":3,"Column":1}}]}'), "golangci-lint")) == [("golangci-lint", "gosec", "high", "a.go", 3, "t", "security")]
    assert row(payloads.json_document(one(spark, '{"Issues":[{"severity":"HIGH","confidence":"HIGH","rule_id":"G1","details":"d","file":"a.go","line":"7-9","column":"x"}]}'), "gosec")) == [("gosec", "G1", "critical", "a.go", 7, "d", "security")]
    assert row(payloads.json_document(one(spark, '[{"code":"S101","message":"m","location":{"row":2,"column":1},"filename":"a.py"}]'), "ruff")) == [("ruff", "S101", "high", "a.py", 2, "m", "security")]
    assert row(payloads.json_document(one(spark, '[{"type":"warning","line":4,"column":0,"path":"a.py","symbol":"s","message":"m","message-id":"W0611"}]'), "pylint")) == [("pylint", "W0611", "warning", "a.py", 4, "s: m", "unused")]
    assert row(payloads.json_document(one(spark, '{"results":[{"filename":"a.py","issue_text":"m","issue_severity":"MEDIUM","issue_confidence":"LOW","line_number":5,"test_id":"B1","test_name":"t"}]}'), "bandit")) == [("bandit", "B1", "warning", "a.py", 5, "t: m", "security")]
    assert row(payloads.eslint(one(spark, '[{"filePath":"a.ts","messages":[{"ruleId":null,"severity":2,"message":"m","line":1,"column":2},{"ruleId":"no-unused-vars","severity":1,"message":"n","line":3,"column":2}]}]'))) == [("eslint", "parse-error", "high", "a.ts", 1, "m", "bug"), ("eslint", "no-unused-vars", "warning", "a.ts", 3, "n", "unused")]
    assert row(payloads.json_lines(one(spark, 'x\n{"file":"a.py","line":1,"column":2,"severity":"note","code":"c","message":"m"}\n{'), "mypy")) == [("mypy", "c", "info", "a.py", 1, "m", "type")]
    assert row(payloads.json_lines(one(spark, '{"code":"SA9003","severity":"error","location":{"file":"a.go","line":1,"column":2},"message":"m"}'), "staticcheck")) == [("staticcheck", "SA9003", "warning", "a.go", 1, "m", "security")]
    assert row(payloads.tsc(one(spark, "a/b.ts(3,4): error TS2322: Type x\r\nnoise\n"))) == [("tsc", "TS2322", "high", "a/b.ts", 3, "Type x", "type")]
    assert payloads.json_document(one(spark, "not json"), "ruff").count() == 0
    assert [tuple(r) for r in payloads.dot_edges(one(spark, 'digraph {\n "a.b" -> "c.d" [x];\n e -> f\n}', "dot")).collect()] == [("a.b", "c.d"), ("e", "f")]
    assert [tuple(r) for r in payloads.module_graph(one(spark, '{"modules":[{"source":"a","dependencies":[{"resolved":"b"},{"resolved":"c"}]}]}')).collect()] == [("a", "b"), ("a", "c")]
    both = one(spark, '{"files":["a","b"]}').union(one(spark, '{"files":{"modified":["c"],"added":["d"],"deleted":["e"]}}'))
    assert [r.path for r in payloads.scope_paths(both).collect()] == ["a", "b", "c", "d"]


PY = '''
import os as o
from a.b import c
LIMIT: int = 3
class User(Base):
    name: str
    async def load(self, key: str, *rest, flag=True, **more) -> int:
        helper(key)
        return self.find(len(key))
def helper(x):
    def inner():
        hidden()
    return os.path.join(x)
'''
GO = 'package p\nimport (\n\t"fmt"\n\tc "context"\n)\ntype User struct {\n\tName string // n\n}\nfunc (u *User) Get(a int) (string, error) {\n\tif a > 0 { return "}", nil }\n\treturn u.Name, nil\n}\nfunc Run() {}\nvar Limit = 3\n'
TS = 'import { x } from "./api";\nexport interface User { name: string; }\nexport type S = "a" | "b";\nexport async function load(a: string): Promise<void> { go(a); }\nexport const pick = (a: number): number => a + 1;\n\nclass K { run() { } }\n'


def test_parsers(spark):
    files = spark.createDataFrame([("a.py", "python", PY), ("a.go", "go", GO), ("a.ts", "typescript", TS), ("bad.py", "python", "def ("), ("n.py", "python", None)], "file string, language string, content string")
    got = {}
    for r in parsers.symbols(files).collect():
        got.setdefault(r.file, {})[(r.symbol_kind, r.name)] = (r.kind, r.sig)
    assert got["a.py"][("function", "User.load")] == ("async", "(self, key: str, *rest, flag, **more) -> int")
    assert set(got["a.py"]) == {("import", "os"), ("import", "a.b.c"), ("variable", "LIMIT"), ("type", "User"), ("function", "User.load"), ("function", "helper")}
    assert got["a.go"][("function", "User.Get")] == ("method", "(a int) (string, error)")
    assert {("function", "Run"), ("type", "User"), ("variable", "Limit"), ("import", "fmt"), ("import", "context")} <= set(got["a.go"])
    assert {("function", "load"), ("function", "pick"), ("type", "User"), ("type", "S"), ("type", "K"), ("function", "K.run"), ("import", "./api")} == set(got["a.ts"])
    assert "bad.py" not in got and "n.py" not in got
    calls = [(r.caller, r.target, r.is_method) for r in parsers.calls(files.where("language = 'python'")).collect()]
    assert calls == [("User.load", "helper", False), ("User.load", "self.find", True), ("helper", "os.path.join", True), ("inner", "hidden", False)]


def test_symbol_diff_of_sources(spark):
    after = PY.replace("key: str, ", "").replace("LIMIT: int = 3", "").replace("def helper(x)", "def other(x)")
    side = lambda t: parsers.symbols(spark.createDataFrame([("a.py", "python", t)], "file string, language string, content string"))
    rows = sy.diff(side(PY), side(after), ["file", "symbol_kind", "name"], ["kind", "sig", "body_hash"]).collect()
    assert {(r.name, r.change_type) for r in rows} == {("User.load", "modified"), ("LIMIT", "removed"), ("helper", "removed"), ("other", "added")}
    swapped = sy.diff(side(after), side(PY), ["file", "symbol_kind", "name"], ["kind", "sig", "body_hash"]).collect()
    assert {(r.name, r.change_type) for r in swapped} == {("User.load", "modified"), ("LIMIT", "added"), ("helper", "added"), ("other", "removed")}


def test_lines_and_documents(spark, tmp_path):
    files = spark.createDataFrame([("a", "x\r\ny\n"), ("b", "")], "file string, content string")
    assert [tuple(r) for r in parsers.code_lines(files).orderBy("file", "line").collect()] == [("a", 1, "x"), ("a", 2, "y")]
    sinks.write_json(spark.createDataFrame([("go", 1), ("py", 2)], "language string, n int"), f"{tmp_path}/j", by_language=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_tracked_flows_and_comments(spark):
    go = ["func f(w, r) {", '  name := r.FormValue("name")', "  // db.Exec(name)", "  q := name", "  db.Exec(q)", "  q = html.EscapeString(name)", "  w.Write(q)", '  q = "x"', "  w.Write(q)", "}"]
    lines = spark.createDataFrame([("a.go", i + 1, t) for i, t in enumerate(go)], "file string, line int, text string")
    from tidemark.functions.patterns import GO_SINKS, GO_SOURCES

    clean = flows.code_only(lines)
    got = {(r.sink_line, r.sink_type, r.sanitized) for r in flows.tracked_flows(lines, GO_SOURCES, GO_SINKS).where("source_type = 'http_query'").collect()}
    assert got == {(5, "database", False), (7, "http_response", True)}
    text = spark.createDataFrame([("f", 1, "a /* b"), ("f", 2, "c */ d // e"), ("f", 3, "g /* h */ i")], "file string, line int, text string")
    assert [r.text for r in flows.code_only(text).orderBy("line").collect()] == ["a ", " d ", "g  i"]
    assert flows.split_arguments('a, f(b, c), "x,y", [d, e]') == ["a", "f(b, c)", '"x', 'y"', "[d, e]"]
    assert flows.parameter_names("ctx context.Context, a, b int") == ["ctx", "b"]


def test_files_are_dealt_out_before_parsing(spark):
    # a table of files that one split holds was parsed by one task
    content = F.concat(F.lit("def f"), "id", F.lit("():\n  g()\n"))
    files = spark.range(200).coalesce(1).select("id", F.lit("python").alias("language"), content.alias("content"))
    tasks = lambda d: d.select("id", F.spark_partition_id().alias("p"))
    for rows in (parsers.calls(files), parsers.symbols(files), parsers.symbols_or_errors(files)):
        got = tasks(rows).collect()
        assert sorted(r.id for r in got) == list(range(200))
        assert len({r.p for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
