"""A git repository, phase files, documents and the command line."""

import json
import os
import stat
import subprocess

import pytest

from tidemark.__main__ import main
from tidemark.operators import paths, reports, sinks
from tidemark.sources import parsers, phases
from tidemark.sources.repository import GitError, Repository, batches, checked_ref


def git(folder, *arguments):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@example.org", "-c", "commit.gpgsign=false", *arguments], cwd=folder, check=True, capture_output=True)


def put(folder, name, text):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("repo"))
    git(d, "init", "-q", "-b", "trunk")
    put(d, "a.py", "def f(a):\n  return a\n")
    put(d, "old/name with é.go", "package p\n" * 20)
    put(d, "gone.ts", "x\n")
    git(d, "add", ".")
    git(d, "commit", "-qm", "one")
    git(d, "tag", "first")
    put(d, "a.py", "def f(a, b):\n  return a\n\ndef g():\n  return f(1)\n")
    git(d, "mv", "old/name with é.go", "new.go")
    git(d, "rm", "-q", "gone.ts")
    git(d, "commit", "-qam", "two")
    put(d, "a.py", "def f(a, b):\n  return b\n")
    git(d, "add", "a.py")
    put(d, "new.go", "package q\n" * 20)
    put(d, "sub/fresh.py", "x = 1\n")
    return d


def rows(d):
    return {r.path: (r.status[0], r.old_path, r.additions, r.deletions) for r in d.collect()}


def test_diffs(spark, folder):
    r = Repository(spark, folder)
    assert rows(r.diff("first", "HEAD")) == {"a.py": ("M", None, 4, 1), "new.go": ("R", "old/name with é.go", 0, 0), "gone.ts": ("D", None, 0, 1)}
    assert rows(r.staged()) == {"a.py": ("M", None, 2, 5)} or set(rows(r.staged())) == {"a.py"}
    assert set(rows(r.unstaged())) == {"new.go"} and set(rows(r.all_changes())) == {"a.py", "new.go"}
    assert [x.path for x in r.unstaged_files().collect()] == ["new.go", "sub/fresh.py"]
    assert {x.path: x.additions for x in r.line_counts("first", ["a.py", "gone.ts", "nothing"]).collect()}["gone.ts"] == 0


def test_files_at_a_revision(spark, folder):
    r = Repository(spark, folder)
    assert r.exists("first", "gone.ts") and not r.exists("HEAD", "gone.ts") and r.show("first", "gone.ts") == "x\n"
    assert {x.file: x.content for x in r.contents("HEAD", ["gone.ts", "old/name with é.go"]).collect()} == {"gone.ts": None, "old/name with é.go": None}
    assert r.default_branch() == "trunk"
    with pytest.raises(ValueError):
        r.diff("--output=x")
    with pytest.raises(GitError):
        r.diff("no-such-revision").collect()


def test_runner_and_default_branch(spark):
    calls = []

    def run(arguments):
        calls.append(list(arguments))
        if arguments[0] == "symbolic-ref":
            return b"origin/devel\n"
        return b"1\t2\ta\0" if "--numstat" in arguments else b""

    r = Repository(spark, run=run)
    assert r.default_branch() == "devel"
    assert {tuple(x) for x in r.line_counts("x", ["p" * 60_000, "q" * 60_000]).collect()} == {("a", 1, 2)}
    assert sum("--numstat" in c for c in calls) == 2

    def none(arguments):
        raise GitError("no")

    with pytest.raises(GitError, match="default"):
        Repository(spark, run=none).default_branch()


@pytest.mark.parametrize("names,most,want", [(["a", "bb", "c"], 5, [["a", "bb"], ["c"]]), (["a" * 9, "b"], 4, [["a" * 9], ["b"]]), (["a", "b"], 0, [["a", "b"]]), ([], 5, []), (["é", "a"], 3, [["é"], ["a"]])])
def test_batches_of_bytes(names, most, want):
    assert list(batches(names, most)) == want


def test_refs():
    assert checked_ref("origin/a-b.c_d:x@~1^") and checked_ref("") == ""
    for bad in ("-x", "a b", "a;b", "é"):
        with pytest.raises(ValueError):
            checked_ref(bad)


def test_scope_of_modes(spark):
    part = lambda *r: spark.createDataFrame([*r], "path string, status string, old_path string, additions long, deletions long")
    names = lambda *r: spark.createDataFrame([(x,) for x in r], "path string")
    committed, staged = part(("a", "M", None, 1, 0), ("b", "R100", "c", 1, 0)), part(("a", "M", None, 10, 0))
    head = part(("a", "M", None, 15, 0), ("gone", "D", None, 0, 3))  # 10 lines staged and 5 more not
    state = (committed, staged, head, names("./a", "new", "gone", "raced", "a"), names("a", "gone"), names("a", "new"))
    got = lambda m: {r.path: (r.status, r.additions, r.deletions) for r in paths.scope_mode(m, *state).collect()}
    assert got("refs") == {"a": ("M", 1, 0), "b": ("R100", 1, 0)} and got("staged") == {"a": ("M", 10, 0)}
    assert got("all") == {"a": ("M", 15, 0), "gone": ("D", 0, 3)}  # no commits, no untracked files, one count
    assert got("unstaged") == {"a": ("M", 15, 0), "new": ("A", 0, 0), "gone": ("D", 0, 3)}  # a file that is nowhere is left out
    with pytest.raises(ValueError):
        paths.scope_mode("odd", *state)
    empty = paths.scope(part().limit(0)).collect()[0]
    assert (empty.modified, empty.total_files, empty.total_additions, empty.language, empty.packages) == (0, 0, 0, "unknown", 0)


def test_packages_of_the_one_language(spark):
    changed = lambda *r: spark.createDataFrame([(i, p, s, o, 1, 0) for i, (p, s, o) in enumerate(r)], "ord long, path string, status string, old_path string, additions long, deletions long")
    one = paths.scope(changed(("a/x.GO", "M", ""), ("docs/y.md", "A", None))).first()
    assert (one.packages, one.language, one.total_files) == (1, "go", 2)
    assert paths.scope(changed(("a/x.go", "M", ""), ("docs/y.md", "A", None), ("b/z.py", "A", None))).first().packages == 3
    assert paths.scope(changed(("a/x.txt", "M", ""), ("docs/y.md", "A", None))).first().packages == 2
    renamed = paths.scope(changed(("n.go", "R100", "o.go"), ("c.go", "C075", "o.go"), ("same.go", "R100", "same.go"), ("e.go", "R100", ""))).first()
    assert (renamed.renamed, renamed.modified) == (2, 4)


def test_scope_documents(spark):
    rows = [(3, "b/z.go", "M", None, 4, 1), (1, 'a/"q<.go', "A", None, 2, 0), (2, "n.go", "R090", "o.go", 0, 0), (4, "docs/x.md", "D", None, 0, 9)]
    df = spark.createDataFrame(rows, "ord long, path string, status string, old_path string, additions long, deletions long")
    text = lambda d: "".join(r.text for r in d.orderBy("part", "ord").collect())
    want = {
        "base_ref": "main", "head_ref": "HEAD", "language": "go", "languages": ["go"],
        "files": {"modified": ["n.go", "b/z.go"], "added": ['a/"q<.go'], "deleted": ["docs/x.md"], "renamed": [{"old_path": "o.go", "new_path": "n.go"}]},
        "stats": {"total_files": 4, "total_additions": 6, "total_deletions": 10}, "packages_affected": [".", "a", "b"],
    }
    got = text(paths.scope_document(df, "main", "HEAD"))
    assert got == json.dumps(want, indent=2).replace("<", "\\u003c") + "\n"
    empty = {"base_ref": "", "head_ref": "", "language": "unknown", "languages": [], "files": {"modified": [], "added": [], "deleted": [], "renamed": []}, "stats": {"total_files": 0, "total_additions": 0, "total_deletions": 0}, "packages_affected": []}
    assert text(paths.scope_document(df.limit(0))) == json.dumps(empty, indent=2) + "\n"


def test_lines_of_files(spark):
    big = "x" * ((1 << 20) - 1)
    files = spark.createDataFrame([("a", "x\n\n"), ("b", ""), ("c", None), ("d", "\n"), ("e", "p\r\nq\r"), ("f", f"ok\n{big}"), ("g", f"ok\n{big}x\n"), ("h", f"{big}\r\n")], "file string, content string")
    got = {}
    for r in parsers.code_lines(files).collect():
        got.setdefault(r.file, {})[r.line] = r.text
    assert got == {"a": {1: "x", 2: ""}, "d": {1: ""}, "e": {1: "p", 2: "q"}, "f": {1: "ok", 2: big}}
    assert {r.file for r in parsers.code_lines(files, longest=None).collect()} == {"a", "d", "e", "f", "g", "h"}


def test_phase_files(spark, tmp_path):
    d = str(tmp_path)
    put(d, "scope.json", json.dumps({"files": {"modified": [], "added": [], "deleted": []}, "language": "unknown", "languages": ["go", "python"]}))
    put(d, "go-ast.json", "{broken")
    put(d, "python-ast.json", json.dumps({"functions": {"modified": [{"name": "f"}]}}))
    put(d, "ruby-calls.json", "{}")
    put(d, "go-flow.json", json.dumps({"flows": [], "nil_sources": []}))
    put(d, "python-flow.json", json.dumps({"flows": [{}], "nil_sources": []}))
    got = {r.phase: (r.status, r.errors) for r in phases.all_phases(spark, d).collect()}
    assert got == {"scope": ("completed", ""), "static-analysis": ("not_run", ""), "ast": ("completed", "go-ast.json parse error"), "callgraph": ("not_run", ""), "dataflow": ("empty", "")}
    put(d, "scope.json", json.dumps({"language": "python", "languages": []}))
    put(d, "static-analysis.json", "[1]")
    got = {r.phase: (r.status, r.errors) for r in phases.all_phases(spark, d).collect()}
    assert got["ast"] == ("completed", "") and got["dataflow"] == ("completed", "") and got["static-analysis"] == ("failed", "static-analysis.json parse error")
    put(d, "scope.json", "{")
    assert {r.phase: (r.status, r.errors) for r in phases.all_phases(spark, d).collect()}["scope"] == ("failed", "scope.json read error")
    put(d, "scope.json", json.dumps({"files": {"modified": [], "added": [], "deleted": []}, "language": "unknown"}))
    assert phases.skip_reason(d) == "No changed files detected" and "missing" in phases.skip_reason(f"{d}/none")
    put(d, "scope.json", json.dumps({"files": {"added": ["a"]}, "language": " Unknown"}))
    assert phases.skip_reason(d) is None and phases.skip_reason(d, needs_language=True) == "Unknown language detected"
    assert phases.read_json(f"{d}/scope.json")["files"] == {"added": ["a"]}
    with pytest.raises(ValueError):
        phases.read_json(f"{d}/scope.json", most=3)
    put(d, "patterns.txt", "# all\n *.go \n\n\tsrc/**/*.py\r\n")
    assert [r.pattern for r in phases.read_patterns(spark, f"{d}/patterns.txt").collect()] == ["*.go", "src/**/*.py"]


def test_languages_of_a_scope():
    assert phases.scope_languages(None) == phases.scope_languages({}) == ("go", "typescript", "python")
    assert phases.scope_languages({"language": " go ", "languages": ["python"]}) == ("python", "go") and phases.scope_languages({"language": "go", "languages": ["go"]}) == ("go",)


def test_documents(spark, tmp_path):
    p = f"{tmp_path}/deep/x.json"
    sinks.write_document(p, {"a": [], "é": 1})
    with open(p, encoding="utf-8") as f:
        assert f.read() == '{\n  "a": [],\n  "é": 1\n}\n'
    assert stat.S_IMODE(os.stat(p).st_mode) == 0o600 and os.listdir(f"{tmp_path}/deep") == ["x.json"]
    os.symlink(p, f"{tmp_path}/link")
    with pytest.raises(OSError, match="symlink"):
        sinks.write_document(f"{tmp_path}/link", {})
    with pytest.raises(TypeError):
        sinks.write_document(p, object())
    assert os.listdir(f"{tmp_path}/deep") == ["x.json"]
    sinks.write_by_language(spark.createDataFrame([("go", "{}"), ("python", "{}")], "language string, document string"), f"{tmp_path}/ast")
    assert {x for x in os.listdir(f"{tmp_path}/ast/by-language") if "=" in x} == {"language=go", "language=python"} and spark.read.json(f"{tmp_path}/ast/mixed").count() == 2


def test_blocks_are_written_in_order(spark, tmp_path):
    blocks = spark.createDataFrame([(1, i, f"b{i}\n") for i in range(50)][::-1] + [(0, 0, "head\n")], reports.BLOCK)
    whole = reports.document(blocks).collect()[0][0]
    sinks.write_blocks(blocks, f"{tmp_path}/r")
    text = ""
    for name in sorted(x for x in os.listdir(f"{tmp_path}/r") if x.startswith("part-")):
        with open(f"{tmp_path}/r/{name}") as f:
            text += f.read()
    assert text == whole and whole.startswith("head\nb0\nb1\n")


def test_impact_report_without_functions(spark):
    none = spark.createDataFrame([], "function string, file string, n_callers long, n_callees long, callers array<string>, callees array<string>, tests array<string>")
    totals = spark.createDataFrame([(0, 0, 0, 0, 0)], "n_functions long, direct_callers long, transitive_callers long, affected_tests long, n_packages long")
    text = reports.document(reports.impact_report(none, totals, spark.createDataFrame([], "package string, first_ord long"), "go", ["slow"], True)).collect()[0][0]
    assert "## No Modified Functions Analyzed" in text and "- **Partial Results:**" in text and "- slow\n" in text and "High Impact" not in text


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["query", "no-such", "--data", "x"], spark) == 2
    assert main(["queries"], spark) == 0 and "j09_tracked_flows" in capsys.readouterr().out
    assert main(["--out", f"{tmp_path}/s", "scope", "--repo", folder, "--base", "first", "--head", "HEAD"], spark) == 0
    assert spark.read.json(f"{tmp_path}/s").count() == 3
    assert main(["scope", "--repo", folder, "--mode", "all", "--files", "**/*.py"], spark) == 0
    assert "fresh.py" not in capsys.readouterr().out  # untracked files differ from nothing
    assert main(["scope", "--repo", folder, "--mode", "unstaged", "--files", "**/*.py"], spark) == 0
    out = capsys.readouterr().out
    assert "sub/fresh.py" in out and "new.go" not in out
    assert main(["--out", f"{tmp_path}/d", "diff", "--repo", folder, "--base", "first", "--head", "HEAD"], spark) == 0
    assert {(r.name, r.change_type) for r in spark.read.json(f"{tmp_path}/d").collect()} == {("f", "modified"), ("g", "added")}
    put(str(tmp_path), "code/x.py", "import os\ndef f():\n  q = request.args.get('a')\n  os.system(q)\n")
    assert main(["calls", "--files", f"{tmp_path}/code", "--language", "python"], spark) == 0
    assert "os.system" in capsys.readouterr().out
    for command in ("flows", "security"):
        assert main([command, "--files", f"{tmp_path}/code", "--language", "python"], spark) == 0
    assert "CRITICAL Flow 1" in capsys.readouterr().out
    put(str(tmp_path), "go/x.go", 'package p\nx := r.FormValue("a")\ndb.Exec(x)\n')
    assert main(["security", "--files", f"{tmp_path}/go", "--language", "go"], spark) == 0
    assert "Flow 1" in capsys.readouterr().out
