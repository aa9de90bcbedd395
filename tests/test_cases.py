"""Predicates, names and paths by their cases."""


import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.operators import calls, findings, paths
from tidemark.sources import parsers


def value(spark, c):
    return spark.range(1).select(c).collect()[0][0]


PYTHON_FUNCTIONS = [("test_x", True), ("TestX", True), ("x_test", True), ("Cls.test_x", True), ("TestCls.run", False), ("testing", False), ("contest", False), ("Testing", True)]
TYPESCRIPT_FUNCTIONS = [("it", True), ("Test", True), ("describe", True), ("beforeEach", True), ("afterAll", True), ("test_login", True), ("Spec_x", True), ("itWorks", False), ("loginTest", False), ("a.it", False)]
PYTHON_FILES = [("test_a.py", True), ("a/a_test.py", True), ("tests/a.py", True), ("contests/q.py", True), ("latest/x.py", True), ("conftest.py", False), ("a/latest.py", False)]
TYPESCRIPT_FILES = [("a.test.ts", True), ("a.spec.tsx", True), ("a_test.ts", True), ("a_spec.js", True), ("__tests__/a.ts", True), ("src/test/a.ts", True), ("src/tests/a.ts", True), ("tests/a.ts", False), ("latest.ts", False)]


def test_test_names(spark):
    for language, cases in (("python", PYTHON_FUNCTIONS), ("typescript", TYPESCRIPT_FUNCTIONS)):
        for name, want in cases:
            assert value(spark, calls.is_test_function(F.lit(name), language)) is want, (language, name)
    for language, cases in (("python", PYTHON_FILES), ("typescript", TYPESCRIPT_FILES)):
        for name, want in cases:
            assert value(spark, calls.is_test_file(F.lit(name), language)) is want, (language, name)


GLOBS = [
    ("*.go", "a.go", True), ("*.go", "a/b.go", False), ("**/*.go", "a.go", True), ("**/*.go", "a/b/c.go", True), ("a/**", "a", True), ("a/**", "a/b/c", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**/b", "ab", False),
    ("**", "a/b", True), ("a**.go", "abc.go", True), ("a**.go", "a/b.go", False), ("[a-c].go", "b.go", True), ("[a-c].go", "d.go", False), ("[^a-c].go", "d.go", True), ("[^a].go", "/.go", False), ("x[]-]", "x]", None), ("[", "a", None), ("[a", "a", None),
    ("[c-a]", "b", False), ("\\*.go", "*.go", True), ("\\*.go", "a.go", False), ("a?.py", "ab.py", True), ("a?.py", "a/.py", False), ("./a//b.go", "a/b.go", True), ("[\\]]", "]", True), ("a.go", "axgo", False), ("[&&a]", "&", True),
]


def test_globs(spark):
    for g, p, want in GLOBS:
        if want is None:
            with pytest.raises(ValueError):
                paths.glob_regex(g)
        else:
            assert value(spark, F.lit(p).rlike(paths.glob_regex(g))) is want, (g, p)


@pytest.mark.parametrize("pattern,good", [("internal/*.go", True), ("cmd/**/*.go", True), ("", False), (".", False), ("/x/*.go", False), ("../*.go", False), ("foo/../../bar/*.go", False), ("..\\*.go", False), ("src\0/*.go", False)])
def test_patterns_are_checked(pattern, good):
    if good:
        assert paths.checked_pattern(pattern) == pattern
    else:
        with pytest.raises(ValueError):
            paths.checked_pattern(pattern)


ANCESTORS = [(["a/b/c.go"], "a/b"), (["a/b/c.go", "a/b/d.go"], "a/b"), (["a/b/c.go", "a/d.go"], "a"), (["a/b/x.go", "a/b-c/y.go", "a/b/c/z.go"], "a"), (["x.go"], "."), (["a/x.go", "b/y.go"], "."), (["/r/a/x.go", "/r/b/y.go"], "/r"), (["/a/x", "/b/y"], "/")]


def test_common_ancestors(spark):
    for files, want in ANCESTORS:
        assert paths.common_ancestor(spark.createDataFrame([(f,) for f in files], "path string")).collect()[0][0] == want, files


def test_closures_are_shown_under_their_function(spark):
    cases = [("func1", "main", "", "main.<closure:func1>"), ("run$2", "T.run", "", "T.run.<closure:run$2>"), ("", "f", "", "f.<closure:>"), ("func1", None, "", "func1"), ("function", "f", "", "function"), ("Get", None, "*User", "*User.Get"), ("func1x", "f", "T", "T.func1x")]
    for name, parent, receiver, want in cases:
        assert value(spark, calls.shown_name(F.lit(name), F.lit(parent), F.lit(receiver))) == want


def test_language_words(spark):
    for word, want in [("go", "go"), ("Golang", "go"), ("TS", "typescript"), ("javascript", "typescript"), ("js", "typescript"), ("py", "python"), ("rust", ""), ("", "")]:
        assert value(spark, dims.language_of(F.lit(word))) == want


def test_linters_take_files_by_lower_case_extension(spark):
    got = findings.lint_targets(spark.createDataFrame([("a/B.TS",), ("c.PY",), ("d/e.go",), ("f.md",)], "path string")).collect()
    assert {(r.linter, r.target) for r in got} >= {("tsc", "a/B.TS"), ("eslint", "a/B.TS"), ("ruff", "c.PY"), ("golangci-lint", "./d")}
    assert len(got) == 2 + 4 + 3


CODE = '''
def outer():
    def inner():
        deep()
    class Local:
        def m(self):
            self.open(); self.close()
    sum([1]); os.path.join(a); obj[0](); f()(); x.y()["k"].z()
    print(len(g(1)))

class A:
    class B:
        async def n(self):
            await h()
'''


def test_python_call_sites():
    got = {(c, t, line, col, m) for c, t, line, col, m in parsers.python_calls(CODE)}
    assert got == {
        ("inner", "deep", 4, 9, False), ("Local.m", "self.close", 7, 26, True), ("outer", "sum", 8, 5, False), ("outer", "os.path.join", 8, 15, True), ("outer", "<subscript>", 8, 32, False),
        ("outer", "<chained>", 8, 42, False), ("outer", "f", 8, 42, False), ("outer", "z", 8, 49, True), ("outer", "x.y", 8, 49, True), ("outer", "g", 9, 15, False), ("B.n", "h", 14, 19, False),
    }


TYPESCRIPT = """import { a } from 'b'
export async function load(id: string, n = f(1)): Promise<Row> {
  const r = await db.find(id)
  if (r) { return new Row(r.x, make(r)) }
  items.map((i) => i.go())
}
const add = (a: number, b: number): number => sum(a, b)
const one = x => twice(x)
class Svc extends Base {
  constructor(a) { super(a); this.init() }
  async run(): Promise<void> { await this.step?.(1); while (ok()) { helper("no(1)") } }
}
"""


def test_typescript_call_sites():
    got = [(c, t, line, m) for c, t, line, _, m in parsers.typescript_calls(TYPESCRIPT)]
    assert sorted(got) == sorted([
        ("load", "db.find", 3, True), ("load", "Row", 4, False), ("load", "make", 4, False), ("load", "items.map", 5, True), ("load", "i.go", 5, True), ("add", "sum", 7, False), ("one", "twice", 8, False),
        ("Svc.run", "this.step", 11, True), ("Svc.run", "ok", 11, False), ("Svc.run", "helper", 11, False),
    ])
    names = {s[1] for s in parsers.typescript_symbols("class C {\n  m(a: T): U { return 1 }\n}\nenum E { A }\n") if s[0] in ("function", "type")}
    assert names == {"C", "C.m", "E"}


def test_go_groups_and_generics():
    got = {(s[0], s[1], s[2]) for s in parsers.go_symbols("const (\n\tA = 1\n\tB string = \"x\"\n)\nvar (\n\tm = 1\n)\nfunc Map[T any](x T) T {\n}\n")}
    assert got == {("variable", "A", "const"), ("variable", "B", "const"), ("variable", "m", "var"), ("function", "Map", "func")}


def test_a_search_stops_at_its_cap_by_name(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", "root") for i in range(20)], "caller string, callee string")
    got = calls.reachable(edges, spark.createDataFrame([("root",)], "node string"), most=5).collect()
    assert sorted(r.node for r in got) == [f"n{i:02d}" for i in range(5)] and all(r.partial for r in got)


def test_files_are_counted(spark):
    f = spark.range(11).select(F.col("id").cast("string").alias("path"))
    assert paths.checked_count(f, 11).count() == 11
    assert paths.checked_count(f.limit(0), 0).count() == 0
    over = paths.checked_count(f, 10)  # the error comes with the rows
    with pytest.raises(PySparkException, match="too many"):
        over.collect()


def test_path_and_name_errors(spark):
    for p, good in [("a/b.go", True), ("a/../b", True), ("", False), ("/etc/x", False), ("../x", False), ("a/../../x", False), ("a\0b", False)]:
        assert (value(spark, paths.path_error(F.lit(p))) is None) is good, p
    for r, good in [("main", True), ("", True), ("HEAD~2^", True), ("a@{1}", False), ("-x", False), ("a b", False), ("origin/f:x", True)]:
        assert (value(spark, paths.ref_error(F.lit(r))) is None) is good, r
    assert value(spark, paths.identifier_error(F.lit("a b"))) and value(spark, paths.identifier_error(F.lit("T.run"))) is None


def test_imports_are_found_by_any_tail(spark):
    m = spark.createDataFrame([("s1", "/w/lib/a/index.ts"), ("s2", "/w/lib/b/index.ts"), ("s3", "a/index.ts"), ("s4", None)], "source string, resolved string")
    f = spark.createDataFrame([("a/index.ts",), ("index.ts",), ("x.ts",)], "file string")
    got = {(r.file, r.source) for r in calls.importers(m, f).collect()}
    assert got == {("a/index.ts", "s1"), ("a/index.ts", "s3"), ("index.ts", "s1"), ("index.ts", "s2"), ("index.ts", "s3")}
