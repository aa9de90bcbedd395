"""Flows, comments and nil rules against plain versions, and the cases that fix their meaning."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.patterns import GO_NIL, GO_SANITIZER, GO_SINKS, GO_SOURCES, LIBRARY, PYTHON_SANITIZERS, TYPESCRIPT_NULL, TYPESCRIPT_SANITIZERS, required_literal
from tidemark.operators import flows

CLEAN, CALLED = re.compile(GO_SANITIZER), re.compile(flows._CALLED, re.A)


def lines(spark, **files):
    rows = [(f"{name}.{ext}", i, t) for name, (ext, texts) in files.items() for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "file string, line int, text string")


def go(spark, *texts):
    return lines(spark, a=("go", texts))


def mentions(text, name):
    n = re.escape(name)
    return bool(re.search(rf"(?<![A-Za-z0-9_]){n}(?![A-Za-z0-9_])|{n}[.\[]|[*&]{n}|{n}(?:Str|String|Bytes)", text))


def tracked_at(texts, name, first, sink):
    """Names that carry the value of name before line sink (from 0)."""
    params = {}
    for t in texts:
        if m := re.match(r"\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)", t, re.A):
            params[m[1]] = flows.parameter_names(m[2])
    out = {name}
    for t in texts[first:sink]:
        if m := re.match(r"\s*([A-Za-z_]\w*)\s*:?=\s*(.+)$", t.strip(), re.A):
            if m[1] == "_":
                continue
            if any(mentions(m[2], n) for n in out):
                out.add(m[1])
            elif m[1] != name:
                out.discard(m[1])
            continue
        for c in re.finditer(r"([A-Za-z_]\w*)\s*\(([^)]*)\)", t, re.A):
            for p, a in zip(params.get(c[1], ()), flows.split_arguments(c[2]), strict=False):
                if any(mentions(a, n) for n in out):
                    out.add(p)
    return out


def plain_flows(texts, sources, sinks):
    """Every pair of a source and a later sink, judged on its own."""
    for i in sources:
        name = flows.variable_of(texts[i])
        for j in sinks:
            if not name or j <= i:
                continue
            names = tracked_at(texts, name, i, j)
            if not any(mentions(texts[j], n) for n in names):
                continue
            window = [t for t in texts[i:j] if any(mentions(t, n) for n in names) and CLEAN.search(t)]
            given = {v for t in window if (v := flows.variable_of(t))}
            safe = bool(window) and (bool(CLEAN.search(texts[j])) or not given or any(mentions(texts[j], v) for v in given))
            m = CALLED.search(texts[j])
            for s in sources[i]:
                if not (s[1] == "json_decode" and m and m[1] in ("json.Unmarshal", "json.NewDecoder")):
                    for k in sinks[j]:
                        yield i, s, name, j, k, safe


def test_one_pass_equals_every_pair():
    r = random.Random(7)
    names = ["a", "b", "ab", "data", "x1"]
    shapes = ["{0} := r.FormValue(q)", "{0} = {1}", "{0} := html.EscapeString({1})", "db.Exec({0}, {1})", "{0} = 5", "send({0}, f({1}))", "func send(a string, b, ab []int) {{", "exec({0}Str)", "use(*{0}, {1}[0])", "{0}, err := strconv.Atoi({1})", "_ = {0}", "v.Struct({0})", "json.Unmarshal({0}, &{1})", "}}", ""]
    seen = 0
    for _ in range(300):
        texts = [r.choice(shapes).format(r.choice(names), r.choice(names)) for _ in range(r.randrange(2, 25))]
        sources = {i: [(0, r.choice(["http_query", "json_decode"]), "s")] for i in range(len(texts)) if r.random() < 0.4}
        sinks = {i: [(1, "database", "k"), (2, "logging", "l")][: r.randrange(1, 3)] for i in range(len(texts)) if r.random() < 0.4}
        want = sorted(plain_flows(texts, sources, sinks))
        assert sorted(flows.file_flows(texts, sources, sinks, CLEAN, CALLED)) == want, texts
        seen += len(want)
    assert seen > 500


def test_names_are_found_as_the_expression_says():
    r = random.Random(3)
    names = {"a", "ab", "b1", "_x", "Str", "aStr"}
    n = flows.Names(names)
    for _ in range(4000):
        t = "".join(r.choice(["a", "b", "1", "_", "x", ".", "[", "*", "&", " ", "(", "Str", "Bytes", "String", "é"]) for _ in range(r.randrange(1, 9)))
        assert set(n.of(n(t))) == {x for x in names if mentions(t, x)}, t


def test_a_long_file_takes_linear_time():
    r = random.Random(1)
    names = [f"v{i}" for i in range(40)]
    shapes = ["{0} := r.FormValue(q)", "{0} = {1}", "{0} := html.EscapeString({1})", "log({0}, {1})", "{0} = 5", "f({0}, {1})"]
    texts = [r.choice(shapes).format(r.choice(names), r.choice(names)) for _ in range(50_000)]
    sources = {i: [(0, "http_query", "s")] for i in range(0, 50_000, 50)}
    sinks = {i: [(0, "database", "k")] for i in range(7, 50_000, 5_000)}
    began = time.perf_counter()
    n = sum(1 for _ in flows.file_flows(texts, sources, sinks, CLEAN, CALLED))
    half = time.perf_counter() - began
    assert n > 0 and half < 20
    began = time.perf_counter()
    list(flows.file_nils(["x := m[k]" if i % 9 == 0 else f"v{i % 40} := store.Get(x)" if i % 2 else "if x != nil { x.y() }" for i in range(50_000)]))
    assert time.perf_counter() - began < 20


def stripped(texts):
    inside, out = False, []
    for t in texts:
        kept, i = "", 0
        while i < len(t):
            if inside:
                end = t.find("*/", i)
                if end < 0:
                    break
                i, inside = end + 2, False
            elif t.startswith("//", i):
                break
            elif t.startswith("/*", i):
                i, inside = i + 2, True
            else:
                kept, i = kept + t[i], i + 1
        out.append(kept)
    return out


def test_comments_are_cut_as_character_by_character(spark):
    r = random.Random(5)
    files = {f"f{k}": ("go", ["".join(r.choice("/*ab \n"[:5]) for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(1, 30))]) for k in range(60)}
    got = {}
    for x in flows.code_only(lines(spark, **files)).orderBy("file", "line").collect():
        got.setdefault(x.file[:-3], []).append(x.text)
    assert got == {k: stripped(t) for k, (_, t) in files.items()}


# name, lines, whether the flow from line 1 to the last line is sanitized
SANITIZED = [
    ('userID := r.URL.Query().Get("id")', 'db.Exec("SELECT * FROM users WHERE id = " + userID)', False),
    ('name := r.URL.Query().Get("name")', "safeName := html.EscapeString(name)", 'fmt.Fprintf(w, "<h1>%s</h1>", safeName)', True),
    ('path := r.URL.Query().Get("path")', "escaped := url.QueryEscape(path)", "http.Redirect(w, r, escaped, 302)", True),
    ('idStr := r.URL.Query().Get("id")', "id, err := strconv.Atoi(idStr)", 'db.Exec("SELECT ?", id, idStr)', True),
    ('input := r.URL.Query().Get("input")', "clean := sanitizeInput(input)", "db.Exec(query, clean)", False),
    ('input := r.URL.Query().Get("cmd")', 'exec.Command("sh", "-c", input)', False),
    ('content := r.URL.Query().Get("content")', "safe := template.HTMLEscapeString(content)", "w.Write([]byte(safe))", True),
    ('name := r.URL.Query().Get("name")', 'args := pgx.NamedArgs{"name": name}', "db.Exec(ctx, query, args)", True),
    ('input := r.URL.Query().Get("name")', "cleanPath := filepath.Clean(input)", "db.Exec(query, cleanPath)", True),
    ('input := r.URL.Query().Get("name")', "safe := url.PathEscape(other)", "db.Exec(query, input)", False),
]


def test_go_flows(spark):
    files = {f"s{i}": ("go", case[:-1]) for i, case in enumerate(SANITIZED)}
    files["derived"] = ("go", ['userInput := r.URL.Query().Get("q")', "query := userInput", "db.Exec(query)"])
    files["called"] = ("go", ["func handler(db *sql.DB, r *http.Request) {", 'userInput := r.URL.Query().Get("q")', "processQuery(db, userInput)", "}", "func processQuery(db *sql.DB, q string) {", "db.Exec(q)", "}"])
    files["decode"] = ("go", ["if err := json.Unmarshal(data, &static); err == nil {", "if err := json.NewDecoder(bytes.NewReader(data)).Decode(&decoded); err == nil {"])
    files["comment"] = ("go", ['x := r.FormValue("a") /* db.Exec(x)', "db.Exec(x)", "*/ y := 1 // db.Exec(x)"])
    files["x_test"] = ("go", ['x := r.FormValue("a")', "db.Exec(x)"])
    files["same"] = ("go", ['db.Exec(r.FormValue("a"))'])
    a = flows.analysis(lines(spark, **files), "go")
    got = {}
    for x in a["flows"].collect():
        got.setdefault(x.source_file[:-3], []).append(x)
    for i, case in enumerate(SANITIZED):
        last = [x for x in got[f"s{i}"] if x.sink_line == len(case) - 1 and x.source_line == 1]
        assert last and {x.sanitized for x in last} == {case[-1]}, case
    assert got["derived"] and got["called"]
    assert not {"comment", "x_test", "same"} & set(got)
    assert not [x for x in got.get("decode", []) if x.source_type == "json_decode" and x.risk == "high"]
    one = got["derived"][0]
    assert one.source_pattern != "" and "\\" not in one.source_pattern and re.fullmatch(r"flow_[0-9a-f]{16}", one.id)
    s = a["statistics"].collect()[0]
    assert s.total_flows == a["flows"].count() and s.total_sources == a["sources"].count() and s.nil_risks == a["nil_sources"].count()


def plain_nils(texts):
    born = {}
    for i, t in enumerate(texts):
        for p in GO_NIL:
            if (m := re.search(p, t, re.A)) and m[1] not in ("", "_"):
                born[m[1]] = i
    out = []
    for v, i in born.items():
        if ", ok" in texts[i] or ", _" in texts[i]:
            continue
        later = [(j, texts[j].replace(" ", "").replace("\t", "")) for j in range(i + 1, len(texts))]
        if any(c in x for _, x in later for c in (f"if{v}!=nil", f"if{v}==nil", f"ifnil!={v}", f"ifnil=={v}", f"{v}!=nil{{", f"{v}==nil{{")):
            continue
        used = [j for j, x in later if any(c in x for c in (f"{v}.", f"*{v}", f"{v}["))]
        out.append((v, i + 1, used[-1] + 1 if used else None))
    return sorted(out)


def test_nil_risks_equal_a_plain_search(spark):
    r = random.Random(9)
    shapes = ["{0} := m[k]", "{0}, ok := m[k]", "rows, err := db.Query(q)", "if {0} != nil {{", "if nil == {0} {{", "x{0}!=nil{{", "{0}.go()", "y := *{0}", "{0}[1] = 2", "{0} := store.Find(k)", "other()", "z{0}.f()", "if  {0}  ==  nil", "nil != {0}"]
    files = {f"f{k}": ("go", [r.choice(shapes).format(r.choice(["a", "ab", "row"])) for _ in range(r.randrange(2, 14))]) for k in range(120)}
    got = {}
    for x in flows.nil_risks(lines(spark, **files)).collect():
        got.setdefault(x.file[:-3], []).append((x.variable, x.line, x.usage_line))
    assert {k: sorted(v) for k, v in got.items()} == {k: p for k, (_, t) in files.items() if (p := plain_nils(t))}


def plain_every(texts, patterns):
    return [(i, k, n, m.start() + 1, flows.named_in(t, m.start())) for i, t in enumerate(texts, 1) for k, (_, p, _) in enumerate(patterns) for n, m in enumerate(re.finditer(p, t))]


PYTHON = ["q = request.args.get('a') or request.args.get('b')", "x: str = open(p).read()", "cursor.execute(f'select {q}')", "y := os.getenv('A')", "html.escape(q)", "os.system(q)", "return {'a': q}", "", "é = os.environ['x']"]
TYPESCRIPT = ["const u = await repo.findOne(1);", "u.name;", "if (u === null) return;", "let v = cache.get(k)", "if (undefined !== v) {}", "v[0]", "let w: Row = JSON.parse(b) as Row;", "w ?? 1", "<unused>", "exec(req.query.a)", "?.x"]


def test_every_match_of_python_and_typescript(spark):
    for language, texts in (("python", PYTHON), ("typescript", TYPESCRIPT)):
        for patterns in LIBRARY[language]:
            got = sorted((x.line, x.ord, x.nth, x.column, x.variable) for x in flows.every_hit(lines(spark, a=("x", texts)), patterns).collect())
            assert got == sorted(plain_every(texts, patterns))
    assert flows.named_in("const a = f(", 10) == "a" and flows.named_in("a: T = f(", 7) == "T" and flows.named_in("obj.prop(", 0) == "prop" and flows.named_in("[", 0) == "<unknown>"


def test_positional_flows_are_first_of_their_id(spark):
    a = flows.analysis(lines(spark, a=("py", PYTHON), b=("py", PYTHON[2:])), "python", PYTHON_SANITIZERS)
    got = {(x.source_file, x.source_line, x.source_type, x.sink_line, x.sink_type): x for x in a["flows"].collect()}
    assert len(got) == a["flows"].count()
    want = set()
    for file, texts in (("a.py", PYTHON), ("b.py", PYTHON[2:])):
        for i, k, *_ in plain_every(texts, LIBRARY["python"][0]):
            for j, m, *_ in plain_every(texts, LIBRARY["python"][1]):
                if i <= j:
                    want.add((file, i, LIBRARY["python"][0][k][0], j, LIBRARY["python"][1][m][0]))
    assert set(got) == want
    for (file, i, _, j, kind), x in got.items():
        texts = (PYTHON if file == "a.py" else PYTHON[2:])[i - 1 : j]
        assert x.sanitized == any(re.search(p, t, re.I) for p in PYTHON_SANITIZERS.get(kind, ()) for t in texts)


def test_typescript_null_rule(spark):
    r = random.Random(4)
    files = {f"f{k}": ("ts", [r.choice(TYPESCRIPT) for _ in range(r.randrange(1, 12))]) for k in range(60)}
    got = {(x.file[:-3], x.line, x.ord, x.nth): (x.variable, x.check_line, x.usage_line, x.risk, x.is_checked) for x in flows.null_risks(lines(spark, **files)).collect()}
    want = {}
    for name, (_, texts) in files.items():
        for i, t in enumerate(texts):
            for k, (p, _, _) in enumerate(TYPESCRIPT_NULL):
                for n, m in enumerate(re.finditer(p, t)):
                    v = flows.named_in(t, m.start())
                    out = (v, 0, 0, "medium", False)
                    if v != "<unknown>":
                        e = re.escape(v)
                        for j, later in enumerate(texts[i + 1 :], i + 2):
                            if re.search(rf"\b{e}\b\s*(!==?|===?)\s*(null|undefined)|(null|undefined)\s*(!==?|===?)\s*\b{e}\b", later):
                                out = (v, j, 0, "low", True)
                                break
                            if re.search(rf"\b{e}\b\s*(?:\.|\[)", later):
                                out = (v, 0, j, "high", False)
                                break
                    want[name, i + 1, k, n] = out
    assert got == want
    assert flows.analysis(lines(spark, **files), "typescript", TYPESCRIPT_SANITIZERS)["statistics"].collect()[0].nil_risks == len(want)


def test_empty_tables(spark):
    none = lines(spark, a=("go", ["x"])).limit(0)
    for language, s in (("go", None), ("python", PYTHON_SANITIZERS), ("typescript", TYPESCRIPT_SANITIZERS)):
        a = flows.analysis(none, language, s)
        assert a["flows"].count() == a["nil_sources"].count() == 0
        assert set(a["statistics"].collect()[0].asDict().values()) <= {0, None}


@pytest.mark.parametrize("text,parts", [("a, b", ["a", "b"]), ("f(x, y), [1, 2], {a, b}", ["f(x, y)", "[1, 2]", "{a, b}"]), ("a], b, c", ["a]", "b", "c"]), ("'x, y'", ["'x", "y'"]), ("  ", []), ("a,", ["a", ""])])
def test_arguments(text, parts):
    assert flows.split_arguments(text) == parts


@pytest.mark.parametrize("text,names", [("a string, b int", ["a", "b"]), ("a, b string", ["b"]), ("ctx context.Context, opts ...Option", ["ctx", "opts"]), ("string", []), ("", [])])
def test_parameters(text, names):
    assert flows.parameter_names(text) == names


def test_a_required_literal_stands_in_every_match():
    for sources, sinks in LIBRARY.values():
        for _, p, _ in (*sources, *sinks):
            literal = required_literal(p)
            assert not literal or len(literal) > 1
    assert required_literal(r"os\.Getenv\s*\(") == "os.Getenv" and required_literal(r"(?i)select") == "" and required_literal(r"(?:a|b)\.Body") == ".Body" and required_literal(r"abc?d") == "ab"


def test_go_patterns_hit_once_a_line(spark):
    t = go(spark, 'a := os.Getenv("x") + os.Getenv("é")', 'é := os.Getenv("y")')
    got = [(x.line, x.column) for x in flows.hits(t, GO_SOURCES).where(F.col("type") == "env_var").orderBy("line").collect()]
    assert got == [(1, 6), (2, 7)]
    assert flows.hits(t, GO_SINKS).count() == 0


def test_equal_lines_are_searched_once():
    """Lines that come again are not put through the expressions again."""
    found = flows._searched.cache_info().hits
    texts = ["a := r.FormValue(x)", *["log(b)"] * 500, "db.Query(a)"]
    met = list(flows.file_flows(texts, {0: [(0, "s", "")]}, {501: [(0, "database", "")]}, re.compile("Escape"), re.compile(r"(\w+)\(")))
    assert [(f[0], f[2], f[3]) for f in met] == [(0, "a", 501)] and flows._searched.cache_info().hits - found >= 499
    assert list(flows.file_nils(["x = 1"] * 3)) == []


def test_positional_analysis_finds_all_matches_in_one_pass(spark, monkeypatch):
    passes = []
    one = flows.every_hit
    monkeypatch.setattr(flows, "every_hit", lambda *a: passes.append(a) or one(*a))
    for language, sanitizers in (("python", PYTHON_SANITIZERS), ("typescript", TYPESCRIPT_SANITIZERS)):
        passes.clear()
        flows.analysis(lines(spark, a=("py", PYTHON)), language, sanitizers)
        # lines.limit(0) is the empty table of Python's nil sources
        assert len([d for d, *_ in passes if "seen" in d.columns]) == 1


def test_flows_sort_each_side_once_in_tasks_that_are_not_merged(spark):
    sources, sinks = LIBRARY["python"]
    found = flows.stored_hits(flows.sanitizing_counts(lines(spark, a=("py", PYTHON), b=("py", PYTHON[2:])), PYTHON_SANITIZERS), {"sources": sources, "sinks": sinks})
    got = flows.first_flows(found["sources"], found["sinks"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 2
    assert got.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_any_of_finds_what_a_plain_alternation_finds(spark):
    literals = [x for _, p, _ in (*GO_SOURCES, *GO_SINKS) if (x := required_literal(p))] + ["-a", "^b", "]c", "\\d", "&&"]
    texts = [*literals, *(f"x {x} y" for x in literals), *(x[1:] for x in literals), *(x[:-1] for x in literals), "", "nothing"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = "|".join(map(re.escape, literals))
    assert d.where(F.col("text").rlike(flows.any_of(literals)) != F.col("text").rlike(plain)).count() == 0
