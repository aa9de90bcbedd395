"""Queries over decoded payloads, diffs and documents, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import git, parsers, payloads

_SEVERITY = "CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END"
_MAPPED = "CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'warning' ELSE 'info' END"


@query("s08_name_status", "SELECT o_orderkey, concat('n', o_custkey, '.go') AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'R090' ELSE 'M' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN concat('o', o_custkey) END AS old_path FROM orders UNION ALL SELECT o_orderkey, 'z', 'A', NULL FROM orders", "t:orders")
def _(o):
    text = F.expr("concat(CASE WHEN o_orderkey % 3 = 0 THEN concat('R090', chr(0), 'o', o_custkey) ELSE 'M' END, chr(0), 'n', o_custkey, '.go', chr(0), 'A', chr(0), 'z', chr(0))")
    return git.changed_files(o.select("o_orderkey", text.alias("content"))).drop("content")


@query("s09_numstat", "SELECT o_orderkey, concat('n', o_custkey) AS path, o_orderkey % 50 AS additions, o_orderkey % 20 AS deletions FROM orders", "t:orders")
def _(o):
    text = F.expr("concat(o_orderkey % 50, '\\t', o_orderkey % 20, '\\t', CASE WHEN o_orderkey % 2 = 0 THEN concat(chr(0), 'old', chr(0), 'n', o_custkey) ELSE concat('n', o_custkey) END, chr(0), '-\\t-\\tbin', chr(0))")
    return o.select("o_orderkey", text.alias("content")).lateralJoin(git.Numstat(F.col("content").outer())).drop("content")


def _stored_stream(rows, kind):
    """The rows' records, written as NUL-separated files and read back in splits."""
    from tidemark.sources import streams
    from tidemark.sources.store import folder

    path = f"{folder(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    streams.write_stream(rows, path)
    return streams.read_stream(rows.sparkSession, path, kind)


@query(
    "s08_stream",
    "SELECT concat('n', o_custkey, '/', o_orderkey % 7, '.go') AS path, CASE o_orderkey % 4 WHEN 0 THEN 'R090' WHEN 1 THEN 'C' WHEN 2 THEN 'M' ELSE 'D' END AS status, CASE WHEN o_orderkey % 4 < 2 THEN concat('M', o_custkey) END AS old_path, NULL::VARCHAR AS error, count(*) AS n FROM orders GROUP BY ALL",
    "t:orders",
)
def _(o):
    status = "CASE o_orderkey % 4 WHEN 0 THEN 'R090' WHEN 1 THEN 'C' WHEN 2 THEN 'M' ELSE 'D' END"
    tokens = F.expr(f"CASE WHEN o_orderkey % 4 < 2 THEN array({status}, concat('M', o_custkey), concat('n', o_custkey, '/', o_orderkey % 7, '.go')) ELSE array({status}, concat('n', o_custkey, '/', o_orderkey % 7, '.go')) END")
    return _stored_stream(o.select(tokens.alias("tokens")), "name-status").groupBy("path", "status", "old_path", "error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s09_stream",
    """SELECT path, additions, deletions, error, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 < 4 THEN concat('n', o_custkey) END AS path, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 50 END AS additions, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 20 END AS deletions,
  CASE WHEN o_orderkey % 5 = 4 THEN concat('invalid numstat record: x', o_custkey) END AS error FROM orders WHERE o_orderkey % 5 <> 3) GROUP BY ALL""",
    "t:orders",
)
def _(o):
    counts = "concat(o_orderkey % 50, '\\t', o_orderkey % 20, '\\t')"
    tokens = F.expr(f"CASE o_orderkey % 5 WHEN 0 THEN array({counts}, concat('old', o_custkey), concat('n', o_custkey)) WHEN 3 THEN array('-\\t-\\tbin') WHEN 4 THEN array(concat('x', o_custkey)) ELSE array(concat({counts}, 'n', o_custkey)) END")
    return _stored_stream(o.select(tokens.alias("tokens")), "numstat").groupBy("path", "additions", "deletions", "error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s07_byte_batches",
    """WITH RECURSIVE p AS MATERIALIZED (SELECT path, row_number() OVER (ORDER BY path) AS i, sum(length(path) + 1) OVER (ORDER BY path) AS upto, length(path) + 1 AS size FROM (SELECT DISTINCT concat(repeat('d/', (o_orderkey % 9)::INT), o_custkey, '.go') AS path FROM orders)),
s AS (SELECT 1 AS batch, 1::BIGINT AS i, 0::HUGEINT AS before UNION ALL SELECT s.batch + 1, n.i, n.upto - n.size FROM s, LATERAL (SELECT min(i) AS j FROM p WHERE p.upto > s.before + 4096 AND p.i > s.i) x JOIN p n ON n.i = x.j)
SELECT path, s.batch::BIGINT AS batch FROM p ASOF JOIN s ON p.i >= s.i""",
    "t:orders",
)
def _(o):
    from tidemark.operators.batching import byte_batches

    paths = o.select(F.expr("concat(repeat('d/', cast(o_orderkey % 9 as int)), o_custkey, '.go')").alias("path")).distinct()
    return byte_batches(paths, F.octet_length("path") + 1, ["path"], 4096)


@query("s11_nul_list", "SELECT o_orderkey, unnest(['a', concat('b', o_custkey)]) AS path FROM orders", "t:orders")
def _(o):
    return o.select("o_orderkey", F.explode(git.nul_list(F.expr("concat('a', chr(0), chr(0), 'b', o_custkey, chr(0))"))).alias("path"))


_LINES = "CASE p_partkey % 5 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_brand, ''] WHEN 2 THEN [''] WHEN 3 THEN ['', '', p_type] ELSE [] END"
_TEXT = "CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, '\\r\\n', p_type, '\\n') WHEN 1 THEN concat(p_brand, '\\n\\n') WHEN 2 THEN '\\n' WHEN 3 THEN concat('\\r\\n\\n', p_type) WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN '' END END"


@query("s15_code_lines", f"SELECT concat('p', p_partkey) AS file, unnest(generate_series(1, len(l))) AS line, unnest(l) AS text FROM (SELECT p_partkey, {_LINES} AS l FROM part)", "t:part")
def _(p):
    return parsers.code_lines(p.select(F.expr("concat('p', p_partkey)").alias("file"), F.expr(_TEXT).alias("content")))


@query("s15_long_lines", "SELECT concat('p', p_partkey) AS file, unnest([1, 2]) AS line, unnest([p_brand, p_type]) AS text FROM part WHERE greatest(length(p_brand), length(p_type) + 1) < 22", "t:part")
def _(p):
    """A line as long as the cap, its carriage return included, and its file goes."""
    files = p.select(F.expr("concat('p', p_partkey)").alias("file"), F.expr("concat(p_brand, '\\n', p_type, '\\r\\n')").alias("content"))
    return parsers.code_lines(files, longest=22)


@query("s17_jsonl_payload", f"SELECT 'mypy' AS tool, event_type AS rule, {_MAPPED} AS severity, concat('f', user_id, '.py') AS file, (event_id % 90)::INT AS line, 1 AS \"column\", concat('m', event_id) AS message, 'type' AS category FROM events", "t:events")
def _(e):
    line = F.to_json(F.struct(F.expr("concat('f', user_id, '.py')").alias("file"), (F.col("event_id") % 90).alias("line"), F.lit(1).alias("column"), F.expr(_SEVERITY).alias("severity"), F.col("event_type").alias("code"), F.expr("concat('m', event_id)").alias("message")))
    return payloads.json_lines(e.select(F.concat(line, F.lit("\nnot json\n")).alias("payload")), "mypy")


@query("s18_json_payload", "SELECT 'ruff' AS tool, CASE event_id % 3 WHEN 0 THEN 'S101' WHEN 1 THEN 'F401' ELSE 'C901' END AS rule, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, concat('f', user_id, '.py') AS file, (event_id % 90)::INT AS line, 2 AS \"column\", concat('m', event_id) AS message, CASE event_id % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' ELSE 'complexity' END AS category FROM events", "t:events")
def _(e):
    item = F.struct(F.expr("CASE event_id % 3 WHEN 0 THEN 'S101' WHEN 1 THEN 'F401' ELSE 'C901' END").alias("code"), F.expr("concat('m', event_id)").alias("message"), F.struct((F.col("event_id") % 90).alias("row"), F.lit(2).alias("column")).alias("location"), F.expr("concat('f', user_id, '.py')").alias("filename"))
    return payloads.json_document(e.select(F.to_json(F.array(item)).alias("payload")), "ruff")


@query("s18_nested_payload", "SELECT 'eslint' AS tool, 'no-unused-vars' AS rule, CASE event_id % 2 WHEN 0 THEN 'high' ELSE 'warning' END AS severity, concat('f', user_id, '.ts') AS file, (event_id % 90)::INT AS line, 3 AS \"column\", concat('m', event_id) AS message, 'unused' AS category FROM events", "t:events")
def _(e):
    message = F.struct(F.lit("no-unused-vars").alias("ruleId"), (2 - F.col("event_id") % 2).alias("severity"), F.expr("concat('m', event_id)").alias("message"), (F.col("event_id") % 90).alias("line"), F.lit(3).alias("column"))
    file = F.struct(F.expr("concat('f', user_id, '.ts')").alias("filePath"), F.array(message).alias("messages"))
    return payloads.eslint(e.select(F.to_json(F.array(file)).alias("payload")))


_GOSEC = """CASE event_id % 6 WHEN 1 THEN '{broken' WHEN 3 THEN 'null' WHEN 5 THEN NULL ELSE concat('{"Issues":[{"severity":"HIGH","confidence":"', CASE WHEN event_id % 4 = 0 THEN 'HIGH' ELSE 'LOW' END, '","rule_id":"G', event_id % 7, '","details":"m', event_id, '","file":"f', event_id, '.go","line":"', CASE event_id % 6 WHEN 2 THEN '' ELSE concat(event_id % 90, '-', event_id % 90 + 2) END, '","column":"', CASE event_id % 6 WHEN 4 THEN 'x' ELSE '4' END, '"}]}') END"""


@query(
    "s18_gosec_results",
    """SELECT event_id, 'gosec' AS tool, concat('G', event_id % 7) AS rule, CASE WHEN event_id % 4 = 0 THEN 'critical' ELSE 'high' END AS severity, concat('f', event_id, '.go') AS file, CASE event_id % 6 WHEN 2 THEN 0 ELSE event_id % 90 END::INT AS line, CASE event_id % 6 WHEN 4 THEN 0 ELSE 4 END::INT AS "column",
  concat('m', event_id) AS message, 'security' AS category, NULL::VARCHAR AS error FROM events WHERE event_id % 6 IN (0, 2, 4)
UNION ALL SELECT event_id, 'gosec', NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE event_id % 6 WHEN 1 THEN 'gosec output parse warning: malformed document' WHEN 2 THEN concat('gosec output parse warning: file=f', event_id, '.go line="" column="4" err=empty position')
  ELSE concat('gosec output parse warning: file=f', event_id, '.go line="', event_id % 90, '-', event_id % 90 + 2, '" column="x" err=strconv.Atoi: parsing "x": invalid syntax') END FROM events WHERE event_id % 6 IN (1, 2, 4)""",
    "t:events",
)
def _(e):
    return payloads.results(e.select("event_id", F.expr(_GOSEC).alias("payload")), "gosec", keep=["event_id"])


#: By tool one document with a finding; each part has one of every tool, sound, broken, blank or of another shape.
_OUTPUTS = {
    "golangci-lint": '{"Issues":[{"FromLinter":"govet","Text":"m","Severity":"error","Pos":{"Filename":"f","Line":3,"Column":4}}]}',
    "gosec": '{"Issues":[{"severity":"LOW","confidence":"LOW","rule_id":"G1","details":"m","file":"f","line":"3","column":"4"}]}',
    "ruff": '[{"code":"F1","message":"m","location":{"row":3,"column":4},"filename":"f"}]',
    "pylint": '[{"type":"error","line":3,"column":4,"path":"f","symbol":"s","message":"m","message-id":"E1"}]',
    "bandit": '{"results":[{"filename":"f","test_name":"n","issue_text":"m","line_number":3,"test_id":"B1"}]}',
    "eslint": '[{"filePath":"f","messages":[{"ruleId":"semi","severity":1,"message":"m","line":3,"column":4},{"severity":2,"message":"m"}]}]',
}


@query(
    "a02_tool_errors",
    f"""SELECT tool, coalesce(count(*) FILTER (k = 0), 0) * CASE WHEN tool = 'eslint' THEN 2 ELSE 1 END AS findings, count(*) FILTER (k = 1 OR k = 3 OR k = 2 AND tool NOT IN ('golangci-lint', 'ruff')) AS errors
FROM (SELECT unnest({list(_OUTPUTS)}) AS tool, unnest([(p_partkey + i) % 4 FOR i IN range({len(_OUTPUTS)})]) AS k FROM part) GROUP BY tool HAVING findings + errors > 0""",
    "t:part",
)
def _(p):
    from functools import reduce

    def of(i, tool, text):
        k = (F.col("p_partkey") + i) % 4
        other = "[{}, 1]" if text.startswith("{") else "{}"
        payload = F.when(k == 0, text).when(k == 1, text[:-1]).when(k == 2, " ").otherwise(other)
        return payloads.results(p.select(payload.alias("payload")), tool).select("tool", "error")

    rows = reduce(lambda a, b: a.unionByName(b), (of(i, t, x) for i, (t, x) in enumerate(_OUTPUTS.items())))
    return rows.groupBy("tool").agg(F.count_if(F.col("error").isNull()).alias("findings"), F.count("error").alias("errors"))


@query("s19_tsc_text", "SELECT 'tsc' AS tool, concat('TS', event_id) AS rule, CASE event_id % 2 WHEN 0 THEN 'high' ELSE 'warning' END AS severity, concat('src/f', user_id, '.ts') AS file, (event_id % 90)::INT AS line, 4 AS \"column\", concat('text: ', event_id) AS message, 'type' AS category FROM events", "t:events")
def _(e):
    return payloads.tsc(e.select(F.expr("concat('Found\\nsrc/f', user_id, '.ts(', event_id % 90, ',4): ', CASE event_id % 2 WHEN 0 THEN 'error' ELSE 'warning' END, ' TS', event_id, ': text: ', event_id, '\\n')").alias("payload")))


@query("s20_dot_edges", "SELECT concat('m.f', l_partkey) AS caller, concat('m.g', l_suppkey) AS callee FROM lineitem", "t:lineitem")
def _(li):
    return payloads.dot_edges(li.select(F.expr("concat('digraph {\\n  \"m.f', l_partkey, '\" -> \"m.g', l_suppkey, '\";\\n}')").alias("dot")))


@query("s21_module_graph", "SELECT concat('s', p_partkey) AS source, unnest([concat('a', p_size), 'b']) AS resolved FROM part", "t:part")
def _(p):
    return payloads.module_graph(p.select(F.expr("""concat('{"modules":[{"source":"s', p_partkey, '","dependencies":[{"resolved":"a', p_size, '"},{"resolved":"b"}]}]}')""").alias("payload")))


@query("s22_expand_globs", "SELECT DISTINCT concat(CASE WHEN p_partkey % 4 = 0 THEN 'vendor/' ELSE 'lib/' END, 'd', p_size, '/f', p_partkey % 50, '.go') AS path FROM part WHERE p_partkey % 4 <> 0 AND p_size < 10", "t:part")
def _(p):
    from tidemark.operators.paths import expand

    return expand(p.select(F.expr("concat(CASE WHEN p_partkey % 4 = 0 THEN 'vendor/' ELSE 'lib/' END, 'd', p_size, '/f', p_partkey % 50, '.go')").alias("path")).distinct(), ["**/d?/*.go"])


@query("s26_scope_paths", "SELECT unnest(CASE WHEN p_partkey % 2 = 0 THEN [concat('a', p_partkey), 'b'] ELSE [concat('m', p_partkey), 'n'] END) AS path FROM part", "t:part")
def _(p):
    text = """CASE WHEN p_partkey % 2 = 0 THEN concat('{"files":["a', p_partkey, '","b"]}') ELSE concat('{"files":{"modified":["m', p_partkey, '"],"added":["n"],"deleted":["x"]}}') END"""
    return payloads.scope_paths(p.select(F.expr(text).alias("payload")))


_PY = "concat('import os\\n\\ndef f', p_partkey, '(a, b: int = 1):\\n    g', p_size, '(a)\\n    return os.path.join(b)\\n\\nclass C(B):\\n    x: int\\n    def m(self):\\n        self.f', p_partkey, '()\\n')"


@query("s28_python_symbols", "SELECT p_partkey, unnest(['import', 'function', 'type', 'function']) AS symbol_kind, unnest(['os', concat('f', p_partkey), 'C', 'C.m']) AS name, unnest(['', '(a, b: int)', '(B) {x: int}', '(self)']) AS sig, unnest([1, 3, 7, 9]) AS start_line FROM part", "t:part")
def _(p):
    files = p.select("p_partkey", F.lit("python").alias("language"), F.expr(_PY).alias("content"))
    return parsers.symbols(files).select("p_partkey", "symbol_kind", "name", "sig", "start_line")


_CALLS = "concat('class C(B):\\n  def m(self):\\n    self.open()\\n    x = sum(a)\\n    def inner():\\n      deep', p_size, '()\\n    return obj[0]() or f', p_partkey, '()()\\n\\ndef g():\\n  print(1)\\n  class D:\\n    def n(self):\\n      a.b[0].c.go()\\n  top(len(x))\\n')"


@query(
    "s31_python_calls",
    """SELECT p_partkey, unnest(['C.m', 'C.m', 'C.m', 'C.m', 'C.inner', 'g', 'D.n']) AS caller, unnest(['sum', '<subscript>', '<chained>', concat('f', p_partkey), concat('deep', p_size), 'top', 'c.go']) AS target,
  unnest([4, 7, 7, 7, 6, 14, 13]) AS line, unnest([9, 12, 24, 24, 7, 3, 7])::INT AS column, unnest([false, false, false, false, false, false, true]) AS is_method FROM part""",
    "t:part",
)
def _(p):
    return parsers.calls(p.select("p_partkey", F.expr(_CALLS).alias("content"))).select("p_partkey", "caller", "target", "line", "column", "is_method")


_GO = "concat('package p\\n\\nfunc (t *T) M', p_partkey, '(a int) error {\\n\\treturn nil\\n}\\n\\nfunc F() {}\\n')"


@query("s27_go_symbols", "SELECT p_partkey, unnest([concat('T.M', p_partkey), 'F']) AS name, unnest(['(a int) error', '()']) AS sig, unnest([3, 7]) AS start_line FROM part", "t:part")
def _(p):
    return parsers.symbols(p.select("p_partkey", F.lit("go").alias("language"), F.expr(_GO).alias("content"))).select("p_partkey", "name", "sig", "start_line")


@query("s29_typescript_symbols", "SELECT p_partkey, unnest([concat('f', p_partkey), 'I']) AS name, unnest(['(a: string): void', 'x: number;']) AS sig FROM part", "t:part")
def _(p):
    text = F.expr("concat('export function f', p_partkey, '(a: string): void { }\\ninterface I { x: number; }\\n')")
    return parsers.symbols(p.select("p_partkey", F.lit("typescript").alias("language"), text.alias("content"))).select("p_partkey", "name", "sig")


_TS = "concat('export const f', p_partkey, ' = async (a: string) => {\\n  await repo.find', p_size, '(a, make(a))\\n  if (a) { return new Row(a) }\\n}\\nclass K {\\n  run(): void { this.go(); // skipped()\\n  }\\n}\\n')"


@query(
    "s32_typescript_calls",
    """SELECT p_partkey, unnest([concat('f', p_partkey), concat('f', p_partkey), concat('f', p_partkey), 'K.run']) AS caller, unnest([concat('repo.find', p_size), 'make', 'Row', 'this.go']) AS target,
  unnest([2, 2, 3, 6]) AS line, unnest([1, 1, 1, 1])::INT AS column, unnest([true, false, false, true]) AS is_method FROM part""",
    "t:part",
)
def _(p):
    return parsers.calls(p.select("p_partkey", F.expr(_TS).alias("content")), language="typescript").select("p_partkey", "caller", "target", "line", "column", "is_method")


_VERSION = "concat('import os', CASE WHEN {1} % 3 = 0 THEN ' as o' ELSE '' END, '\\n\\ndef f', p_partkey % 50, '(a', CASE WHEN {1} % 2 = 0 THEN ', b' ELSE '' END, '):\\n  return a + ', {1} % 5, '\\n\\nclass C:\\n  x: int\\n', CASE WHEN {1} % 7 = 0 THEN '  y: str\\n' ELSE '' END, CASE WHEN {1} % 4 = 0 THEN 'V = 1\\n' ELSE '' END)"


@query(
    "c19_semantic_diff",
    """WITH v AS (SELECT concat('m', p_partkey, '.py') AS file, concat('f', p_partkey % 50) AS f, p_partkey AS b, p_partkey + p_size AS a FROM part)
SELECT file, 'import' AS symbol_kind, 'os' AS name, 'modified' AS change_type, 'sig' AS changed FROM v WHERE (a % 3 = 0) <> (b % 3 = 0)
UNION ALL SELECT file, 'function', f, 'modified', concat_ws(',', CASE WHEN a % 2 <> b % 2 THEN 'sig' END, CASE WHEN a % 5 <> b % 5 THEN 'body_hash' END) FROM v WHERE a % 2 <> b % 2 OR a % 5 <> b % 5
UNION ALL SELECT file, 'type', 'C', 'modified', 'sig' FROM v WHERE (a % 7 = 0) <> (b % 7 = 0)
UNION ALL SELECT file, 'variable', 'V', CASE WHEN a % 4 = 0 THEN 'added' ELSE 'removed' END, '' FROM v WHERE (a % 4 = 0) <> (b % 4 = 0)""",
    "t:part",
)
def _(p):
    from tidemark.operators.symbols import semantic_diff

    side = lambda n: p.select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("file"), F.lit("python").alias("language"), F.expr(_VERSION.replace("{1}", n)).alias("content"))
    d = semantic_diff(side("p_partkey"), side("(p_partkey + p_size)"))
    return d.select("file", "symbol_kind", "name", "change_type", F.array_join("changed", ",").alias("changed"))


@query(
    "c20_batch_errors",
    """WITH v AS (SELECT p_partkey AS b, p_partkey + p_size AS a, p_partkey % 6 AS k, concat('m', p_partkey, CASE p_partkey % 6 WHEN 5 THEN '.rb' ELSE '.py' END) AS file FROM part)
SELECT file, CASE WHEN k < 5 THEN 'python' END AS language, CASE k WHEN 1 THEN 'parsing before file: failed to parse python file: line 2: unexpected indent' WHEN 2 THEN 'parsing after file: failed to parse python file: line 2: unexpected indent' WHEN 4 THEN 'parsing after file: failed to read file' WHEN 5 THEN 'no extractor registered for extension: .rb' END AS error,
  CASE k WHEN 3 THEN 1 WHEN 0 THEN 0 END::BIGINT AS functions_added, CASE WHEN k IN (0, 3) THEN 0 END::BIGINT AS functions_removed, CASE WHEN k = 0 THEN (a % 2 <> b % 2 OR a % 5 <> b % 5)::INT WHEN k = 3 THEN 0 END::BIGINT AS functions_modified,
  CASE k WHEN 3 THEN 1 WHEN 0 THEN 0 END::BIGINT AS types_added, CASE WHEN k IN (0, 3) THEN 0 END::BIGINT AS types_removed, CASE WHEN k = 0 THEN ((a % 7 = 0) <> (b % 7 = 0))::INT WHEN k = 3 THEN 0 END::BIGINT AS types_modified,
  CASE WHEN k = 3 THEN (a % 4 = 0)::INT WHEN k = 0 THEN (a % 4 = 0 AND b % 4 <> 0)::INT END::BIGINT AS variables_added, CASE WHEN k = 3 THEN 0 WHEN k = 0 THEN (a % 4 <> 0 AND b % 4 = 0)::INT END::BIGINT AS variables_removed, CASE WHEN k IN (0, 3) THEN 0 END::BIGINT AS variables_modified,
  CASE k WHEN 3 THEN 1 WHEN 0 THEN 0 END::BIGINT AS imports_added, CASE WHEN k IN (0, 3) THEN 0 END::BIGINT AS imports_removed FROM v""",
    "t:part",
)
def _(p):
    from tidemark.operators.symbols import batch_diff

    k, broken = F.col("p_partkey") % 6, F.lit("x = 1\n  y\n")
    path = F.concat(F.lit("m"), "p_partkey", F.when(k == 5, ".rb").otherwise(".py"))
    before, after = (F.expr(_VERSION.replace("{1}", n)) for n in ("p_partkey", "(p_partkey + p_size)"))
    return batch_diff(p.select(
        F.when(k != 3, path).alias("before_path"), F.when(k == 1, broken).otherwise(before).alias("before"), path.alias("after_path"), F.when(k == 2, broken).when(k != 4, after).alias("after"),
    ))


_FIELDS = """WITH b AS (SELECT concat('T', p_partkey) AS type, unnest(['size', 'brand']) AS field, unnest([p_size::VARCHAR, p_brand]) AS declared FROM part WHERE p_partkey % 5 <> 0), a AS (
  SELECT concat('T', p_partkey) AS type, unnest(['size', CASE WHEN p_partkey % 3 = 0 THEN 'label' ELSE 'brand' END]) AS field, unnest([CASE WHEN p_partkey % 4 = 0 THEN 'long' ELSE p_size::VARCHAR END, p_brand]) AS declared FROM part WHERE p_partkey % 7 <> 0)"""


def _field_versions(p):
    name = F.concat(F.lit("T"), "p_partkey").alias("name")
    before = p.where("p_partkey % 5 <> 0").select(F.lit("x.go").alias("file"), name, F.array(F.concat(F.lit("size: "), "p_size"), F.concat(F.lit("brand: "), "p_brand")).alias("fields"))
    size, label = F.when(F.col("p_partkey") % 4 == 0, "long").otherwise(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 3 == 0, "label").otherwise("brand")
    after = p.where("p_partkey % 7 <> 0").select(F.lit("x.go").alias("file"), name, F.array(F.concat(F.lit("size: "), size), F.concat(label, F.lit(": "), "p_brand")).alias("fields"))
    return before, after


@query(
    "j02_type_fields",
    f"""{_FIELDS}
SELECT type, string_agg(concat(field, ':', CASE WHEN b.declared IS NULL THEN 'added' WHEN a.declared IS NULL THEN 'removed' ELSE 'modified' END, ':', coalesce(b.declared, '-'), ':', coalesce(a.declared, '-')), '|' ORDER BY field) AS fields FROM b FULL JOIN a USING (type, field) WHERE a.declared IS DISTINCT FROM b.declared GROUP BY type""",
    "t:part",
)
def _(p):
    from tidemark.operators.symbols import type_fields_diff

    d = type_fields_diff(*_field_versions(p))
    return d.select("type", F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["name"], x["change"], x["old"], x["new"])), "|").alias("fields"))


@query(
    "m32_type_buckets",
    f"""{_FIELDS}
SELECT type, coalesce(string_agg(concat(field, ' ', b.declared), ', ' ORDER BY field) FILTER (b.declared IS NOT NULL), '') AS before, coalesce(string_agg(concat(field, ' ', a.declared), ', ' ORDER BY field) FILTER (a.declared IS NOT NULL), '') AS after,
  string_agg(concat(field, ':', CASE WHEN b.declared IS NULL THEN 'added' WHEN a.declared IS NULL THEN 'removed' ELSE 'modified' END), ',' ORDER BY field) AS changes FROM b FULL JOIN a USING (type, field) WHERE a.declared IS DISTINCT FROM b.declared GROUP BY type""",
    "t:part",
)
def _(p):
    from tidemark.operators.symbols import field_sides, type_fields_diff

    before, after, labels = field_sides(F.col("fields"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["name"], x["type"])), ", ")
    return type_fields_diff(*_field_versions(p)).select("type", shown(before).alias("before"), shown(after).alias("after"), F.array_join(labels, ",").alias("changes"))


#: By kind of file: none, unreadable, broken, no document, nothing found, null lists, filled, filled beside a list that is none.
_PHASE_TEXT = "CASE k WHEN 1 THEN NULL WHEN 2 THEN '{broken' WHEN 3 THEN '[]' WHEN 4 THEN '{\"flows\": [], \"nil_sources\": []}' WHEN 5 THEN 'null' WHEN 6 THEN '{\"flows\": [{\"id\": \"f\", \"note\": \"\\\\\"flows\\\\\": []\"}]}' WHEN 7 THEN '{\"flows\": [1], \"nil_sources\": 2}' WHEN 8 THEN '{\"flows\": null, \"nil_sources\": [{}]}' END"
_KINDS = "SELECT p_partkey AS folder, unnest(['go', 'typescript', 'python', 'ruby']) AS language, unnest([1, 2, 3, 0]) AS place, unnest([p_partkey % 9, p_partkey // 9 % 9, p_size % 9, 6]) AS k FROM part"


def _phase_files(p):
    kinds = F.array(*(F.struct(F.lit(n).alias("language"), k.alias("k")) for n, k in (("go", F.col("p_partkey") % 9), ("typescript", F.floor(F.col("p_partkey") / 9) % 9), ("python", F.col("p_size") % 9), ("ruby", F.lit(6)))))
    return p.select(F.col("p_partkey").alias("folder"), F.inline(kinds)).where("k > 0").select("folder", "language", F.expr(_PHASE_TEXT).alias("content"))


@query(
    "s24_phase_status",
    f"""SELECT folder, CASE WHEN min(place) FILTER (k >= 4 AND k <> 7) IS NULL THEN 'failed' WHEN arg_min(k, place) FILTER (k >= 4 AND k <> 7) IN (6, 8) THEN 'completed' ELSE 'empty' END AS status,
  coalesce(string_agg(language || CASE k WHEN 1 THEN '-flow.json read error' ELSE '-flow.json parse error' END, ', ' ORDER BY place) FILTER (k IN (1, 2, 3, 7)), '') AS errors FROM ({_KINDS}) WHERE k > 0 AND place > 0 GROUP BY folder""",
    "t:part",
)
def _(p):
    from tidemark.sources.phases import LANGUAGES, phase_status

    return phase_status(_phase_files(p), LANGUAGES, "dataflow", ["folder"])


@query("t08_first_language", f"SELECT folder, arg_min(language, place) AS language, arg_min(k, place) AS k FROM ({_KINDS}) WHERE k IN (4, 5, 6, 8) AND place > 0 GROUP BY folder", "t:part")
def _(p):
    from tidemark.sources.phases import LANGUAGES, primary_documents

    first = primary_documents(_phase_files(p), LANGUAGES, "dataflow", ["folder"])
    return first.select("folder", "language", F.when(F.col("content") == "null", 5).when(F.col("content").contains("note"), 6).when(F.col("content").contains("{}"), 8).otherwise(4).cast("long").alias("k"))


_SYMBOL_TEXT = "CASE p_partkey % 8 WHEN 0 THEN '{\"functions\": {\"modified\": []}, \"types\": null}' WHEN 1 THEN '{\"imports\": {\"removed\": [{}]}}' WHEN 2 THEN '{\"functions\": []}' WHEN 3 THEN '[]' WHEN 4 THEN '[{\"functions\": [{\"change_type\": \"modified\"}]}]' WHEN 5 THEN '[{\"functions\": [{\"change_type\": \"added\", \"after\": {}}], \"types\": []}]' WHEN 6 THEN '[{\"imports\": [{\"change_type\": \"modified\"}]}, {\"types\": [{\"change_type\": \"removed\"}]}]' ELSE '[3]' END"


@query("s24_symbol_documents", "SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN 'completed' WHEN 5 THEN 'completed' WHEN 6 THEN 'completed' WHEN 2 THEN 'failed' WHEN 7 THEN 'failed' ELSE 'empty' END AS status FROM part", "t:part")
def _(p):
    from tidemark.sources.phases import phase_status

    return phase_status(p.select("p_partkey", F.lit("go").alias("language"), F.expr(_SYMBOL_TEXT).alias("content")), ["go"], "ast", ["p_partkey"]).select("p_partkey", "status")


_TOKENS = "CASE event_id % 7 WHEN 0 THEN ' Golang' WHEN 1 THEN 'mixed' WHEN 2 THEN NULL WHEN 3 THEN 'Rust' WHEN 4 THEN 'c++' WHEN 5 THEN 'JS' ELSE 'python' END"


@query("m29_language_token", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'go' WHEN 3 THEN 'rust' WHEN 5 THEN 'typescript' WHEN 6 THEN 'python' ELSE CASE WHEN event_id % 2 = 0 THEN 'typescript' ELSE 'unknown' END END AS token FROM events", "t:events")
def _(e):
    from tidemark.sources.phases import language_token

    return e.select("event_id", language_token(F.expr(_TOKENS), F.when(F.col("event_id") % 2 == 0, "ts").otherwise("unknown")).alias("token"))


@query("m28_json_lists", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('{\"xs\":[\"', p_brand, '\"]}') ELSE '{\"xs\":[]}' END AS doc FROM part", "t:part")
def _(p):
    xs = F.coalesce(F.when(F.col("p_size") % 2 == 0, F.array("p_brand")), F.expr("cast(array() as array<string>)"))
    return p.select("p_partkey", F.to_json(F.struct(xs.alias("xs"))).alias("doc"))


_PART_LANGUAGE = "CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END"


def _read_back(spark, path, schema):
    """Documents as name, file and what they hold, each file read whole; parts of a document have its name."""
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    named = read.withColumn("file", F.substring_index(F.input_file_name(), "/", -1))
    return named.withColumn("name", F.regexp_replace("file", r"\.part-\d{5}", ""))


@query(
    "k04_symbol_documents",
    f"SELECT name, p_partkey AS id, p_name AS label, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS place FROM (SELECT p_partkey, p_name, unnest(['mixed-ast.json', concat({_PART_LANGUAGE}, '-ast.json')]) AS name FROM part)",
    "t:part",
)
def _(p):
    from tidemark.sources import documents
    from tidemark.sources.store import folder, stored

    path = f"{folder(p.sparkSession)}/documents-{uuid.uuid4().hex}"
    made = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))
    documents.write_symbol_documents(p.select(F.expr(_PART_LANGUAGE).alias("language"), made.alias("document"), F.col("p_partkey").alias("ord")), path, parts="true")
    # an element is a row of the reader; its place is the one in the file, behind those of the files before
    rows = stored(_read_back(p.sparkSession, path, "id LONG, label STRING").withColumn("at", F.monotonically_increasing_id()), "read")
    sizes = rows.groupBy("name", "file").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file", (F.sum("n").over(Window.partitionBy("name").orderBy("file")) - F.col("n")).alias("before"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1)
    return placed.join(F.broadcast(before), "file").select("name", "id", "label", (F.col("before") + F.col("nth")).cast("long").alias("place"))


@query(
    "k03_finding_documents",
    f"""WITH f AS (SELECT unnest(['static-analysis.json', concat(l, '-lint.json')]) AS name, severity, error FROM (SELECT {_PART_LANGUAGE} AS l, CASE WHEN p_size % 9 > 0 THEN CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' ELSE 'odd' END END AS severity, CASE WHEN p_size % 9 = 0 THEN 1 END AS error FROM part))
SELECT name, count(severity) AS findings, count(error) AS errors, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'odd') AS unknown, CASE WHEN name IN ('static-analysis.json', 'go-lint.json') THEN '2.1' END AS gosec FROM f GROUP BY name""",
    "t:part",
)
def _(p):
    from tidemark.sources import documents
    from tidemark.sources.store import folder

    path = f"{folder(p.sparkSession)}/documents-{uuid.uuid4().hex}"
    language, ord_ = F.expr(_PART_LANGUAGE).alias("language"), F.col("p_partkey").alias("ord")
    severity = F.expr("CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' ELSE 'odd' END")
    findings = p.where("p_size % 9 > 0").select(language, ord_, severity.alias("severity"), F.col("p_name").alias("message"))
    errors = p.where("p_size % 9 = 0").select(language, ord_, F.col("p_name").alias("error"))
    versions = p.sparkSession.createDataFrame([("go", "gosec", "2.1")], "language string, tool string, version string")
    documents.write_finding_documents(findings, errors, versions, path, parts="true")
    read = _read_back(p.sparkSession, path, "tool_versions STRUCT<gosec STRING>, findings ARRAY<STRUCT<severity STRING>>, summary STRUCT<high LONG, unknown LONG>, errors ARRAY<STRING>")
    sizes = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c) for c in ("findings", "errors")]
    held = read.select("name", *sizes, "summary.high", "summary.unknown", F.col("tool_versions.gosec").alias("gosec"))
    return held.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("findings", "errors")), *(F.max(c).alias(c) for c in ("high", "unknown", "gosec")))
