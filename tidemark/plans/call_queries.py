"""Queries over call graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calls as ca
from tidemark.plans.registry import query

_BASE = "split_part({0}, '.', -1)"
_TEST = r"regexp_matches({0}, '(^|\.)(Test|Benchmark|Example|Fuzz)([^a-z.][^.]*)?$')"


@query("j13_resolve_calls", f"SELECT s.caller, s.file, s.target, s.line, f.name AS callee, f.file AS callee_file FROM {{call_sites}} s JOIN (SELECT *, row_number() OVER (PARTITION BY {_BASE.format('name')} ORDER BY ord) AS rn FROM {{functions}}) f ON {_BASE.format('s.target')} = {_BASE.format('f.name')} AND f.rn = 1", "call_sites", "functions")
def _(s, f):
    return ca.resolve(s, f)


@query("j14_attach_sites", "SELECT m.name, m.file, c.nth, c.line, c.target FROM (SELECT DISTINCT caller AS name, file FROM {call_sites} UNION SELECT 'none', 'none.py') m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file, caller ORDER BY line, target)::INT AS nth FROM {call_sites}) c ON c.caller = m.name AND c.file = m.file", "call_sites")
def _(s):
    m = s.select(F.col("caller").alias("name"), "file").distinct().union(s.sparkSession.createDataFrame([("none", "none.py")], "name string, file string"))
    return ca.attach(m, s).select("name", "file", "nth", "line", "target")


@query(
    "j15_resolve_node",
    """SELECT m.name, m.file, r.rank, r.node_file, r.qualified FROM {modified} m LEFT JOIN (
  SELECT * FROM (SELECT m.name, m.file, CASE WHEN n.file = m.file AND n.qualified = m.name THEN 1 WHEN n.file = m.file THEN 2 ELSE 3 END AS rank, n.file AS node_file, n.qualified,
    row_number() OVER (PARTITION BY m.name, m.file ORDER BY CASE WHEN n.file = m.file AND n.qualified = m.name THEN 1 WHEN n.file = m.file THEN 2 ELSE 3 END, n.file, n.qualified) AS rn
  FROM {modified} m JOIN {nodes} n ON (n.file = m.file OR ends_with(n.file, '/' || m.file)) AND (n.qualified = m.name OR n.bare = m.name)) WHERE rn = 1) r USING (name, file)""",
    "modified",
    "nodes",
)
def _(m, n):
    return ca.resolve_nodes(m, n)


@query("j16_callers", "SELECT m.file || ':' || m.name AS node, 'caller' AS direction, e.caller AS other, e.site_line, e.is_virtual FROM {edges} e JOIN {modified} m ON e.callee = m.file || ':' || m.name UNION ALL SELECT m.file || ':' || m.name, 'callee', e.callee, e.site_line, e.is_virtual FROM {edges} e JOIN {modified} m ON e.caller = m.file || ':' || m.name", "modified", "edges")
def _(m, e):
    return ca.neighbours(m, e)


_COUNTS = f"SELECT m.node, count(DISTINCT e.caller) AS callers, count(DISTINCT CASE WHEN {_TEST.format(chr(115) + 'plit_part(e.caller, ' + chr(39) + ':' + chr(39) + ', -1)')} THEN e.caller END) AS tests FROM (SELECT DISTINCT file || ':' || name AS node FROM {{modified}}) m LEFT JOIN {{edges}} e ON e.callee = m.node GROUP BY m.node"


@query("a05_direct_callers", _COUNTS, "modified", "edges")
def _(m, e):
    return ca.caller_counts(m, e)


@query("f26_impact_level", f"SELECT CASE WHEN callers >= 3 THEN 'HIGH' WHEN callers >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level, count(*) AS n FROM ({_COUNTS}) GROUP BY ALL", "modified", "edges")
def _(m, e):
    return ca.caller_counts(m, e).groupBy(ca.impact_level(F.col("callers")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("f14_uncovered", f"SELECT node FROM ({_COUNTS}) WHERE tests = 0", "modified", "edges")
def _(m, e):
    return ca.uncovered(ca.caller_counts(m, e)).select("node")


@query("f15_high_impact", f"SELECT node, callers FROM ({_COUNTS}) WHERE callers >= 3", "modified", "edges")
def _(m, e):
    return ca.high_impact(ca.caller_counts(m, e)).select("node", "callers")


@query("f18_orphans", "SELECT DISTINCT file || ':' || name AS node FROM {modified} WHERE file || ':' || name NOT IN (SELECT callee FROM {edges})", "modified", "edges")
def _(m, e):
    return ca.orphans(m, e)


@query("f19_impacted", "SELECT DISTINCT file || ':' || name AS node FROM {modified} WHERE file || ':' || name IN (SELECT callee FROM {edges})", "modified", "edges")
def _(m, e):
    return ca.impacted(m, e)


@query("a06_affected_packages", "SELECT regexp_replace(path, '/[^/]*$', '') AS package, min(ord) AS first_ord FROM {changed} GROUP BY ALL", "changed")
def _(c):
    return ca.affected_packages(c, path="path")


@query("a14_virtual_edges", "SELECT count(*) FILTER (is_virtual) AS n_virtual, count(*) AS n, CASE WHEN bool_or(is_virtual) THEN concat(count(*) FILTER (is_virtual), ' call edge(s) resolved through interfaces; targets are possible, not certain') END AS warning FROM {edges}", "edges")
def _(e):
    return ca.virtual_summary(e)


@query("a16_collect_edges", "SELECT caller, array_to_string(list_sort(list(DISTINCT callee)), ',') AS callees FROM {edges} GROUP BY caller", "edges")
def _(e):
    return e.groupBy("caller").agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("callees"))


@query("g02_reverse", "SELECT callee, array_to_string(list_sort(list(DISTINCT caller)), ',') AS callers FROM {edges} GROUP BY callee", "edges")
def _(e):
    return ca.reverse(e).select("callee", F.array_join("callers", ",").alias("callers"))


@query("g03_index", "SELECT file || ':' || qualified AS key, file, qualified FROM {nodes} UNION SELECT file || ':' || bare, file, qualified FROM {nodes}", "nodes")
def _(n):
    return ca.index(n)


@query("t04_top_callers", "SELECT callee, array_to_string(list_sort(list(caller) FILTER (rn <= 10)), ',') AS callers, greatest(count(*) - 10, 0)::BIGINT AS more FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller) AS rn FROM (SELECT DISTINCT callee, caller FROM {edges})) GROUP BY callee", "edges")
def _(e):
    return ca.top_callers(e)


@query("t04_top_callees", "SELECT caller, array_to_string(list_sort(list(callee) FILTER (rn <= 5)), ',') AS callees, greatest(count(*) - 5, 0)::BIGINT AS more FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY callee) AS rn FROM (SELECT DISTINCT callee, caller FROM {edges})) GROUP BY caller", "edges")
def _(e):
    return ca.top_callees(e)


@query("t05_first_500", "SELECT name, file FROM {modified} ORDER BY file, name LIMIT 500", "modified")
def _(m):
    return ca.first_modified(m)


@query(
    "g01_reachable",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 300 AS child, l_suppkey AS parent FROM lineitem WHERE l_suppkey <> l_partkey % 300),
r AS (SELECT 7::BIGINT AS node, 0 AS depth UNION SELECT e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.node WHERE r.depth < 10)
SELECT node::VARCHAR AS node, min(depth) AS depth FROM r WHERE node <> 7 GROUP BY node""",
    "t:lineitem",
)
def _(li):
    e = li.where("l_suppkey <> l_partkey % 300").select(F.col("l_suppkey").cast("string").alias("caller"), (F.col("l_partkey") % 300).cast("string").alias("callee"))
    return ca.reachable(e, li.sparkSession.createDataFrame([("7",)], "node string"), most=None).select("node", "depth")


@query("f27_test_functions", f"SELECT DISTINCT caller, {_TEST.format(chr(115) + 'plit_part(caller, ' + chr(39) + ':' + chr(39) + ', -1)')} AS is_test FROM {{edges}}", "edges")
def _(e):
    return e.select("caller", ca.is_test_function(F.substring_index("caller", ":", -1), "go").alias("is_test")).distinct()


# names and paths of all shapes, put together from parts of the tables
_NAMES = "concat(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Cls.' WHEN 2 THEN 'TestCls.' ELSE 'a.b.' END, CASE p_partkey % 11 WHEN 0 THEN 'test_x' WHEN 1 THEN 'TestX' WHEN 2 THEN 'x_test' WHEN 3 THEN 'testing' WHEN 4 THEN 'contest' WHEN 5 THEN 'describe' WHEN 6 THEN 'BeforeEach' WHEN 7 THEN 'spec_y' WHEN 8 THEN 'IT' WHEN 9 THEN 'xTest' ELSE 'run' END)"
_PATHS = "concat(CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'tests/' WHEN 2 THEN 'contest/' WHEN 3 THEN 'a/test/' WHEN 4 THEN '__tests__/' WHEN 5 THEN 'b/latests/c/' ELSE 'src/' END, CASE p_partkey % 9 WHEN 0 THEN 'test_x.py' WHEN 1 THEN 'x_test.py' WHEN 2 THEN 'conftest.py' WHEN 3 THEN 'x.test.ts' WHEN 4 THEN 'y.spec.tsx' WHEN 5 THEN 'z_spec.js' WHEN 6 THEN 'z_test.go' WHEN 7 THEN 'latest.ts' ELSE 'plain.py' END)"


@query(
    "f27_script_tests",
    f"""SELECT p_partkey, name, starts_with(last, 'test_') OR starts_with(last, 'Test') OR ends_with(last, '_test') AS python, lower(name) IN ('it', 'test', 'describe', 'beforeeach', 'aftereach', 'beforeall', 'afterall') OR starts_with(lower(name), 'test_') OR starts_with(lower(name), 'spec_') AS typescript
FROM (SELECT *, regexp_replace(name, '^.*\\.', '') AS last FROM (SELECT p_partkey, {_NAMES} AS name FROM part))""",
    "t:part",
)
def _(p):
    n = p.select("p_partkey", F.expr(_NAMES).alias("name"))
    return n.select("p_partkey", "name", ca.is_test_function(F.col("name"), "python").alias("python"), ca.is_test_function(F.col("name"), "typescript").alias("typescript"))


@query(
    "f28_test_files",
    f"""SELECT p_partkey, path, ends_with(base, '_test.go') AS go, starts_with(base, 'test_') OR ends_with(base, '_test.py') OR strpos(path, 'tests/') > 0 OR strpos(path, 'test/') > 0 AS python,
  regexp_matches(base, '\\.test\\.|\\.spec\\.|_test\\.|_spec\\.') OR strpos(path, '__tests__') > 0 OR strpos(path, '/test/') > 0 OR strpos(path, '/tests/') > 0 AS typescript
FROM (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM (SELECT p_partkey, {_PATHS} AS path FROM part))""",
    "t:part",
)
def _(p):
    f = p.select("p_partkey", F.expr(_PATHS).alias("path"))
    return f.select("p_partkey", "path", *(ca.is_test_file(F.col("path"), x).alias(x) for x in ("go", "python", "typescript")))


@query("j17_module_imports", "SELECT DISTINCT f.file, m.source FROM (SELECT concat('src/m', l_suppkey % 30, '.ts') AS source, concat('/w/lib/m', l_partkey % 50, '.ts') AS resolved FROM lineitem) m JOIN (SELECT DISTINCT concat('lib/m', p_partkey % 20, '.ts') AS file FROM part) f ON ends_with(m.resolved, '/' || f.file)", "t:lineitem", "t:part")
def _(li, p):
    m = li.select(F.expr("concat('src/m', l_suppkey % 30, '.ts')").alias("source"), F.expr("concat('/w/lib/m', l_partkey % 50, '.ts')").alias("resolved")).distinct()
    return ca.importers(m, p.select(F.expr("concat('lib/m', p_partkey % 20, '.ts')").alias("file")).distinct())


@query("j19_requested", "SELECT ord, name FROM {functions} WHERE split_part(name, '.', -1) IN ('fn7', 'fn8') OR name = 'K0.fn12'", "functions")
def _(f):
    return ca.requested(f, ["fn7", "fn8", "K0.fn12"]).select("ord", "name")


@query(
    "j20_zip_arguments",
    """SELECT concat('c', p_partkey) AS caller, concat('fn', p_size % 4) AS callee, i::INT AS position, list_extract(['a', 'bee', 'cx'], i + 1) AS parameter, list_extract(string_split(p_type, ' '), i + 1) AS argument
FROM part, range(3) AS r(i) WHERE i < p_size % 4 AND i < len(string_split(p_type, ' '))""",
    "t:part",
)
def _(p):
    calls = p.select(F.concat(F.lit("c"), "p_partkey").alias("caller"), F.concat(F.lit("fn"), F.col("p_size") % 4).alias("callee"), F.split("p_type", " ").alias("arguments"))
    functions = p.sparkSession.createDataFrame([(f"fn{n}", ["a", "bee", "cx"][:n]) for n in range(4)], "callee string, parameters array<string>")
    return ca.zip_arguments(calls, functions)


@query(
    "j23_interface_calls",
    """SELECT s.caller, concat('m', m.t % 9, '.go:T', m.t, '.M', m.k) AS callee, true AS is_virtual FROM (SELECT DISTINCT concat('c', p_partkey % 60) AS caller, p_size % 5 AS i, p_partkey % 3 AS k FROM part) s
JOIN (SELECT DISTINCT p_size % 5 AS i, p_partkey % 25 AS t FROM part WHERE p_partkey % 4 = 0) n ON n.i = s.i JOIN (SELECT DISTINCT p_partkey % 25 AS t, p_partkey % 3 AS k FROM part WHERE p_partkey % 2 = 0) m ON m.t = n.t AND m.k = s.k""",
    "t:part",
)
def _(p):
    sites = p.select(F.expr("concat('c', p_partkey % 60)").alias("caller"), F.expr("concat('I', p_size % 5)").alias("interface"), F.expr("concat('M', p_partkey % 3)").alias("method")).distinct()
    impl = p.where("p_partkey % 4 = 0").select(F.expr("concat('I', p_size % 5)").alias("interface"), F.expr("concat('T', p_partkey % 25)").alias("type")).distinct()
    methods = p.where("p_partkey % 2 = 0").select(F.expr("concat('T', p_partkey % 25)").alias("type"), F.expr("concat('M', p_partkey % 3)").alias("method"), F.expr("concat('m', p_partkey % 25 % 9, '.go')").alias("file")).distinct()
    return ca.interface_edges(sites, impl, methods)


_SSA = "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('func', p_size) WHEN 2 THEN concat('run$', p_size) WHEN 3 THEN 'function' WHEN 4 THEN 'func1x' ELSE concat('f', p_size) END"
_PARENT, _RECEIVER = "CASE WHEN p_partkey % 5 > 0 THEN concat('T.m', p_partkey % 5) END", "CASE WHEN p_partkey % 4 = 0 THEN '*T' ELSE '' END"


@query(
    "m30_closures",
    f"""SELECT p_partkey, CASE WHEN p IS NOT NULL AND (n = '' OR regexp_full_match(n, 'func[0-9]+') OR regexp_matches(n, '\\$[0-9]+$')) THEN p || '.<closure:' || n || '>' WHEN r <> '' THEN r || '.' || n ELSE n END AS shown
FROM (SELECT p_partkey, {_SSA} AS n, {_PARENT} AS p, {_RECEIVER} AS r FROM part)""",
    "t:part",
)
def _(p):
    return p.select("p_partkey", ca.shown_name(F.expr(_SSA), F.expr(_PARENT), F.expr(_RECEIVER)).alias("shown"))


@query("m31_base_name", "SELECT ord, split_part(name, '.', -1) AS base FROM {functions}", "functions")
def _(f):
    return f.select("ord", ca.base_symbol(F.col("name")).alias("base"))


@query(
    "c22_call_graph",
    f"""WITH m AS (SELECT file || ':' || name AS node FROM (SELECT * FROM {{modified}} ORDER BY file, name LIMIT 500)), c AS (
  SELECT m.node, count(DISTINCT e.caller) AS callers, count(DISTINCT CASE WHEN {_TEST.format("split_part(e.caller, ':', -1)")} THEN e.caller END) AS tests FROM m LEFT JOIN {{edges}} e ON e.callee = m.node GROUP BY m.node
), d AS (SELECT m.node, count(DISTINCT e.callee) AS callees FROM m LEFT JOIN {{edges}} e ON e.caller = m.node GROUP BY m.node)
SELECT node, callers, tests, callees, CASE WHEN callers >= 3 THEN 'HIGH' WHEN callers >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM c JOIN d USING (node)""",
    "modified",
    "edges",
)
def _(m, e):
    return ca.call_graph(m, e)["functions"].select("node", "callers", "tests", "callees", "impact")


@query(
    "c23_script_call_graph",
    """WITH f AS (SELECT *, split_part(name, '.', -1) AS base FROM {functions}), first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS rn FROM f) WHERE rn = 1),
r AS (SELECT s.file, s.caller, first.name, first.file AS callee_file FROM {call_sites} s JOIN first ON split_part(s.target, '.', -1) = first.base),
w AS (SELECT DISTINCT name, file FROM f WHERE base IN ('fn7', 'fn8', 'fn9') OR name = 'K0.fn12')
SELECT w.name AS callee, w.file AS callee_file, count(r.caller) AS n_sites, count(DISTINCT r.file || ':' || r.caller) AS n_callers FROM w LEFT JOIN r ON r.name = w.name AND r.callee_file = w.file GROUP BY w.name, w.file""",
    "call_sites",
    "functions",
)
def _(s, f):
    return ca.script_call_graph(s, f, ["fn7", "fn8", "fn9", "K0.fn12"])
