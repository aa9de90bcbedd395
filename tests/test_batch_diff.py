"""Batches of file pairs: changes and errors by file."""

from pyspark.sql import functions as F

from tidemark.operators import symbols as sy
from tidemark.sources import parsers

PAIRS = "before_path string, before string, after_path string, after string"


def got(spark, pairs):
    rows = sy.batch_diff(spark.createDataFrame(pairs, PAIRS)).collect()
    return {r.file: (r.language, r.error, {k: v for k, v in r.asDict().items() if k not in ("file", "language", "error") and v}) for r in rows}


def test_changes_and_errors(spark):
    py = "import os\n\ndef f(a):\n  return a\n\nclass C:\n  x: int\n\nV = 1\n"
    rows = got(spark, [
        ("a.py", py, "a.py", py.replace("return a", "return 1").replace("V = 1\n", "import re\n")),
        ("gone.PY", py, None, None), ("", None, "new.pyi", "def g(): ...\n"), ("old.py", py, "moved.py", py), ("same.go", "package p\n", "same.go", "package p\n"),
        ("bad.py", "def (\n", "bad.py", "def (\n"), ("half.py", py, "half.py", "x = (\n"), ("lost.ts", None, "lost.ts", "x"), ("a.rb", "x", "a.rb", "y"), ("Makefile", "x", "Makefile", "y"), (None, None, None, None),
        ("empty.py", "", "empty.py", ""), ("was.go", "func F() {\n}\n", "now.ts", "function g() {\n}\n"),
    ])
    none = {}
    assert rows["a.py"] == ("python", None, {"functions_modified": 1, "variables_removed": 1, "imports_added": 1})
    assert rows["gone.PY"] == ("python", None, {"functions_removed": 1, "types_removed": 1, "variables_removed": 1, "imports_removed": 1})
    assert rows["new.pyi"] == ("python", None, {"functions_added": 1}) and rows["moved.py"] == ("python", None, none) and rows["same.go"] == ("go", None, none) and rows["empty.py"] == ("python", None, none)
    assert rows["bad.py"] == ("python", "parsing before file: failed to parse python file: line 1: invalid syntax", none)
    assert rows["half.py"] == ("python", "parsing after file: failed to parse python file: line 1: '(' was never closed", none)
    assert rows["lost.ts"] == ("typescript", "parsing before file: failed to read file", none)
    assert rows["a.rb"] == (None, "no extractor registered for extension: .rb", none) and rows["Makefile"] == (None, "no extractor registered for extension: ", none) == rows[""]
    assert rows["now.ts"] == ("typescript", None, {"functions_added": 1}) and len(rows) == 13


def test_empty_table_and_repeated_rows(spark):
    assert got(spark, []) == {}
    pair = ("a.py", "x = 1\n", "a.py", "x = 2\n")
    assert got(spark, [pair, pair]) == {"a.py": ("python", None, {"variables_modified": 1})}


def test_too_large(spark, monkeypatch):
    big = "x = 1\n" + "#" * parsers.MAX_BYTES
    assert got(spark, [("a.py", big, "a.py", "x = 1\n")])["a.py"][1] == "parsing before file: file exceeds maximum allowed size (10485760 bytes)"
    assert parsers.symbols(spark.createDataFrame([("python", big), ("python", "def (")], "language string, content string")).collect() == []


def test_packages_and_receivers(spark):
    names = {"a/b/x.go": "a/b", "x.go": "main", "./x.go": "main", "": "main", "/x.go": "/", "/a/x.go": "a", "/a/b/../c/x.go": "c", "a//./b/x.go": "a/b", "../x.go": "..", "../a/x.go": "../a"}
    rows = spark.createDataFrame([(n,) for n in names], "file string").select("file", sy.package_of(F.col("file")).alias("p")).collect()
    assert {r.file: r.p for r in rows} == names
    side = "struct<sig string, receiver string>"
    diffs = spark.createDataFrame([
        ("f", "both", "modified", "", ("a", "T"), ("b", " U ")), ("f", "was", "modified", "body", ("a", "T"), ("a", "")), ("f", "half", "modified", None, None, ("a", None)), ("f", "none", "modified", "body", None, None),
        ("f", "new", "added", "", None, ("a", "T")), ("f", "odd", "added", "", ("a", "T"), None), ("f", "gone", "removed", "", ("a", None), None), ("f", "same", None, "", ("a", ""), ("a", "")),
    ], f"file string, name string, change_type string, body_diff string, before {side}, after {side}")
    got = {r.name: (r.bucket, r.receiver, r.before, r.after, r.changes) for r in sy.function_buckets(diffs).collect()}
    assert got == {
        "both": ("functions.modified", "U", "a", "b", ["signature_changed"]), "was": ("functions.modified", "T", "a", "a", ["body"]), "half": ("functions.modified", "", None, "a", []),
        "new": ("functions.added", None, None, "a", []), "gone": ("functions.deleted", None, "a", None, []),
    }
    receivers = {r.name: r.receiver for r in sy.modified_functions(diffs.where("name in ('both', 'was', 'half', 'gone')")).collect()}
    assert receivers == {"both": " U ", "was": "T", "half": ""}


def test_field_sides(spark):
    fields = spark.sql("SELECT array(named_struct('name', 'a', 'change', 'added', 'old', '-', 'new', 'int'), named_struct('name', 'b', 'change', 'removed', 'old', 'T', 'new', '-'), named_struct('name', 'c', 'change', 'modified', 'old', 'x', 'new', 'y')) AS f")
    before, after, labels = fields.select(*sy.field_sides(F.col("f"))).first()
    assert [tuple(x) for x in before] == [("b", "T"), ("c", "x")] and [tuple(x) for x in after] == [("a", "int"), ("c", "y")] and labels == ["a:added", "b:removed", "c:modified"]
