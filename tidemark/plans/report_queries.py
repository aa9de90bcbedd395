"""Queries for Markdown reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.operators import calls as ca
from tidemark.operators import contexts as cx
from tidemark.operators import flows as fl
from tidemark.operators import reports as rp
from tidemark.operators import symbols as sy
from tidemark.plans import call_queries as cq
from tidemark.plans import flow_queries as fq
from tidemark.plans import review_queries as rq
from tidemark.plans import symbol_queries as sq
from tidemark.plans.registry import query

def _by_line(sql: str) -> str:
    """The lines of a document, numbered."""
    return f"SELECT unnest(generate_series(1, len(l))) AS line, unnest(l) AS text FROM (SELECT string_split(regexp_replace(document, '\\n\\z', ''), chr(10)) AS l FROM ({sql}))"


_KIND = "CASE pos % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'type' WHEN 2 THEN 'import' ELSE 'variable' END"


def _changes(b, a):
    d = sy.diff(b, a, ["file", "name"], ["kind", "sig", "body", "pos"])
    pos = F.coalesce("before.pos", "after.pos")
    shown = lambda side: F.when(F.col(side).isNotNull(), rp.shown_signature(F.col("name"), F.array(F.struct(F.lit("x").alias("name"), F.col(f"{side}.sig").alias("type")), F.struct(F.lit("y").alias("name"), F.lit("").alias("type"))), F.array(F.lit("error")), F.when(pos % 3 == 0, "*T"), pos % 5 == 0))
    fields = F.when(F.col("change_type") == "modified", F.array(F.struct(F.lit("size").alias("name"), F.lit("modified").alias("change"), F.col("before.sig").alias("old"), F.col("after.sig").alias("new")))).otherwise(F.array().cast("array<struct<name:string,change:string,old:string,new:string>>"))
    return d.select(
        "file", F.lit("go").alias("language"), F.expr(_KIND.replace("pos", "coalesce(before.pos, after.pos)")).alias("symbol_kind"), "name", "change_type", F.array_join("changed", ", ").alias("changes"), shown("before").alias("before"), shown("after").alias("after"),
        F.coalesce("after.kind", "before.kind").alias("kind"), pos.alias("start_line"), (pos + 7).alias("end_line"), fields.alias("fields"), F.when(pos % 8 == 2, "al").alias("alias"), pos.alias("ord"),
    )


_ICON = "CASE change_type WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE '~' END"
_CAP = "upper(left(change_type, 1)) || substr(change_type, 2)"
_SIG = "concat(CASE WHEN pos % 5 = 0 THEN 'async ' ELSE '' END, CASE WHEN pos % 3 = 0 THEN '(*T) ' ELSE '' END, 'func ', name, '(x: ', {0}, ', y) -> error')"
_FENCE = "'```' || chr(10) || " + _SIG + " || chr(10) || '```' || chr(10) || chr(10)"
_N, _NN = "chr(10)", "chr(10) || chr(10)"
_BLOCKS = f"""SELECT *, {_KIND} AS k, CASE {_KIND}
  WHEN 'function' THEN '### ' || {_ICON} || ' `' || name || '`' || {_NN} || '**Status:** ' || {_CAP} || {_NN} || CASE change_type WHEN 'added' THEN {_FENCE.format('asig')} WHEN 'removed' THEN {_FENCE.format('bsig')}
    ELSE '**Changes:** ' || concat_ws(', ', CASE WHEN bsig <> asig THEN 'sig' END, CASE WHEN bbody <> abody THEN 'body' END) || {_NN} || '**Before:**' || {_N} || {_FENCE.format('bsig')} || '**After:**' || {_N} || {_FENCE.format('asig')} END
  WHEN 'type' THEN '### ' || {_ICON} || ' `' || name || '` (' || kind || ')' || {_NN} || '**Status:** ' || {_CAP} || {_N} || '**Lines:** ' || pos || '-' || pos + 7 || {_NN} || CASE WHEN change_type = 'modified' THEN '**Field Changes:**' || {_NN} || '| Field | Change | Old Type | New Type |' || {_N} || '|-------|--------|----------|----------|' || {_N} || '| size | modified | ' || bsig || ' | ' || asig || ' |' || {_NN} ELSE '' END
  WHEN 'import' THEN '- ' || {_ICON} || ' `' || name || '`' || CASE WHEN pos % 8 = 2 THEN ' as al' ELSE '' END || {_N} END AS block FROM (SELECT d.*, coalesce(a.kind, b.kind) AS kind FROM ({sq._DIFF}) d LEFT JOIN {{after_symbols}} a USING (file, name) LEFT JOIN {{before_symbols}} b USING (file, name))"""
_count = lambda k, c: f"count(*) FILTER (k = '{k}' AND change_type = '{c}')"
_TABLE = " || ".join([f"'| Category | Added | Removed | Modified |' || {_N} || '|----------|-------|---------|----------|' || {_N}", *(f"'| {t} | ' || {_count(k, 'added')} || ' | ' || {_count(k, 'removed')} || ' | ' || " + ("'-'" if k == "import" else _count(k, "modified")) + f" || ' |' || {_N}" for k, t in rp._KINDS), _N])
_section = lambda k, t: f"CASE WHEN count(*) FILTER (k = '{k}') > 0 THEN '## {t}' || {_NN} || string_agg(block, '' ORDER BY pos, name) FILTER (k = '{k}') ELSE '' END"
_DOCUMENTS = f"SELECT 'go' AS language, file, '# Semantic Changes: ' || file || {_NN} || '**Language:** go' || {_NN} || '## Summary' || {_NN} || {_TABLE} || {_section('function', 'Functions')} || {_section('type', 'Types')} || {_section('import', 'Imports')} AS document FROM ({_BLOCKS}) GROUP BY file"


@query("k08_semantic_documents", _DOCUMENTS, "before_symbols", "after_symbols")
def _(b, a):
    return rp.semantic_documents(_changes(b, a))


@query("k08_semantic_report", _by_line(f"SELECT (SELECT '# Semantic Diff Report' || {_NN} || '## Overall Summary' || {_NN} || '**Files analyzed:** ' || count(DISTINCT file) || {_NN} || {_TABLE} || '---' || {_NN} FROM ({_BLOCKS})) || (SELECT string_agg(document || {_N} || '---' || {_NN}, '' ORDER BY file) FROM ({_DOCUMENTS})) AS document"), "before_symbols", "after_symbols")
def _(b, a):
    return cx.lines(rp.semantic_report(_changes(b, a)))


def impact_inputs(m, e):
    """What impact_report takes, from modified functions and edges."""
    graph = ca.call_graph(m, e)
    near = graph["neighbours"]
    other = F.substring_index("other", ":", -1)
    shown = rp.place(other, F.substring_index("other", ":", 1), F.col("site_line"))
    first = near.groupBy("node", "direction", "other").agg(F.min("site_line").alias("site_line")).withColumn("shown", shown)
    top = lambda d, n: F.array_compact(F.transform(F.array_sort(F.collect_list(F.when((F.col("direction") == d) & (F.col("rn") <= n), F.struct("other", "shown")))), lambda x: x["shown"]))
    ranked = first.withColumn("rn", F.row_number().over(rq.Window.partitionBy("node", "direction").orderBy("other")))
    lists = ranked.groupBy("node").agg(top("caller", ca.SHOWN_CALLERS).alias("callers_shown"), top("callee", ca.SHOWN_CALLEES).alias("callees_shown"))
    tests = graph["coverage"].groupBy("node").agg(F.transform(F.array_sort(F.collect_list("test")), lambda x: F.concat(F.lit("`"), x, F.lit("`"))).alias("tests"))
    empty = F.expr("cast(array() as array<string>)")
    rows = graph["functions"].drop("tests").join(lists, "node", "left").join(tests, "node", "left")
    functions = rows.select(
        F.substring_index("node", ":", -1).alias("function"), F.substring_index("node", ":", 1).alias("file"), F.col("callers").alias("n_callers"), F.col("callees").alias("n_callees"),
        F.coalesce("callers_shown", empty).alias("callers"), F.coalesce("callees_shown", empty).alias("callees"), F.coalesce("tests", empty).alias("tests"),
    )
    files = m.select(F.col("file").alias("path"), F.xxhash64("file").alias("o")).distinct()
    packages = files.groupBy(F.col("path").alias("package")).agg(F.lit(0).alias("first_ord"))
    totals = graph["totals"].crossJoin(packages.agg(F.count(F.lit(1)).alias("n_packages"))).withColumn("transitive_callers", F.lit(0))
    return functions, totals, packages


_AT = "'`' || split_part({0}, ':', -1) || '` at `' || split_part({0}, ':', 1) || ':' || site_line || '`'"
_IMPACT = f"""WITH m AS (SELECT DISTINCT file || ':' || name AS node FROM (SELECT * FROM {{modified}} ORDER BY file, name LIMIT 500)),
r AS (SELECT m.node, e.caller AS other, min(e.site_line) AS site_line FROM {{edges}} e JOIN m ON e.callee = m.node GROUP BY ALL), e AS (SELECT m.node, e.callee AS other, min(e.site_line) AS site_line FROM {{edges}} e JOIN m ON e.caller = m.node GROUP BY ALL),
rs AS (SELECT node, count(*) AS n, string_agg('- ' || {_AT.format('other')} || {_N}, '' ORDER BY other) FILTER (rn <= 10) AS t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS rn FROM r) GROUP BY node),
es AS (SELECT node, count(*) AS n, string_agg('- ' || {_AT.format('other')} || {_N}, '' ORDER BY other) FILTER (rn <= 5) AS t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS rn FROM e) GROUP BY node),
ts AS (SELECT node, string_agg('- `' || other || '`' || {_N}, '' ORDER BY other) AS t FROM r WHERE {cq._TEST.format("split_part(other, ':', -1)")} GROUP BY node),
b AS (SELECT split_part(node, ':', -1) AS function, split_part(node, ':', 1) AS file, coalesce(rs.n, 0) AS n, '### `' || split_part(node, ':', -1) || '`' || {_NN} || '**File:** `' || split_part(node, ':', 1) || '`' || {_N} || '**Risk Level:** ' || CASE WHEN coalesce(rs.n, 0) >= 3 THEN 'HIGH' WHEN coalesce(rs.n, 0) >= 1 THEN 'MEDIUM' ELSE 'LOW' END || {_N} || '**Callers:** ' || coalesce(rs.n, 0) || {_NN}
  || CASE WHEN ts.t IS NULL THEN '**Test Coverage:** No tests found' || {_NN} ELSE '**Test Coverage:** Has tests' || {_NN} || '<details>' || {_N} || '<summary>Tests covering this function</summary>' || {_NN} || ts.t || {_N} || '</details>' || {_NN} END
  || CASE WHEN rs.n IS NULL THEN '**Direct Callers:** None' || {_NN} ELSE '**Direct Callers:**' || {_NN} || rs.t || CASE WHEN rs.n > 10 THEN '- ... and ' || rs.n - 10 || ' more' || {_N} ELSE '' END || {_N} END
  || CASE WHEN es.n IS NULL THEN '**Calls:** None' || {_NN} ELSE '**Calls:**' || {_NN} || es.t || CASE WHEN es.n > 5 THEN '- ... and ' || es.n - 5 || ' more' || {_N} ELSE '' END || {_N} END || '---' || {_NN} AS block
  FROM m LEFT JOIN rs USING (node) LEFT JOIN es USING (node) LEFT JOIN ts USING (node)),
p AS (SELECT DISTINCT file FROM {{modified}})
SELECT '# Impact Summary' || {_NN} || '**Language:** go' || {_NN} || '## Summary Metrics' || {_NN} || '| Metric | Value |' || {_N} || '|--------|-------|' || {_N} || '| Modified Functions | ' || (SELECT count(*) FROM m) || ' |' || {_N} || '| Direct Callers | ' || (SELECT sum(n) FROM b) || ' |' || {_N} || '| Transitive Callers | 0 |' || {_N}
  || '| Affected Tests | ' || (SELECT count(*) FROM r WHERE {cq._TEST.format("split_part(other, ':', -1)")}) || ' |' || {_N} || '| Affected Packages | ' || (SELECT count(*) FROM p) || ' |' || {_NN} || '### Affected Packages' || {_NN} || (SELECT string_agg('- `' || file || '`' || {_N}, '' ORDER BY file) FROM p) || {_N}
  || {" || ".join(f"coalesce((SELECT {fq._q(t).replace(chr(10), "' || chr(10) || '")} || string_agg(block, '' ORDER BY file, function) FROM b WHERE n {c} HAVING count(*) > 0), '')" for (_, t), c in zip(rp.IMPACT, (">= 3", "BETWEEN 1 AND 2", "= 0"), strict=True))} AS document"""


@query("k09_impact_report", _by_line(_IMPACT), "modified", "edges")
def _(m, e):
    return cx.lines(rp.impact_report(*impact_inputs(m, e), "go"))


def security_inputs(c):
    """What security_report takes, from TypeScript lines."""
    a = fl.analysis(c, "typescript", fq.TYPESCRIPT_SANITIZERS, reused=True)
    flows = a["flows"].select(
        "id", "risk", F.concat(F.lit("Data from "), "source_type", F.lit(" flows to "), "sink_type").alias("description"), "source_file", "source_line", "source_type", "sink_file", "sink_line", "sink_type",
        F.col("sink_pattern").alias("function"), "sanitized", F.lit("").alias("sanitizers"), F.lit("").alias("source_context"), F.lit("").alias("sink_context"),
    )
    return a["statistics"].withColumn("language", F.lit("typescript")), flows, a["nil_sources"]


_E = lambda c: rq._escape(c)
_R = "upper(left(risk, 1)) || substr(risk, 2)"
_SECURITY = f"""{fq._positional_sql('typescript').replace('k.type AS ktype FROM', 'k.type AS ktype, k.pattern AS kpattern FROM')}, hn AS ({{nulls}}),
o AS (SELECT *, row_number() OVER (ORDER BY CASE risk WHEN 'critical' THEN 0 ELSE 1 END, file, sline, kline, id) AS nth FROM judged WHERE risk IN ('critical', 'high')),
fb AS (SELECT string_agg('### ' || upper(risk) || ' Flow ' || nth || ': ' || {_E("'Data from ' || stype || ' flows to ' || ktype")} || {_NN} || '**Risk Level:** ' || {_R} || {_NN} || '**Source:** `' || {_E('file')} || ':' || sline || '` (Type: ' || {_E('stype')} || ')' || {_NN} || '**Sink:** `' || {_E('file')} || ':' || kline || '` (Function: ' || {_E('kpattern')} || ')' || {_NN} || '**Sanitized:** No' || {_NN} || '**Recommendation:** ' || {dims.mapped_sql('ktype', dims.RECOMMENDATIONS, fq._q(dims.OTHER_RECOMMENDATION))} || {_NN} || '---' || {_NN}, '' ORDER BY nth) AS t FROM o),
nb AS (SELECT string_agg('| ' || {_E('file')} || ' | ' || line || ' | ' || {_E('variable')} || ' | ' || {_E('pattern')} || ' | ' || {_E('origin')} || ' | ' || CASE WHEN is_checked THEN 'Yes' ELSE 'No' END || ' | ' || {_R} || ' |' || {_N}, '' ORDER BY file, line, variable, pattern) AS t FROM (SELECT *, CASE WHEN is_checked THEN 'low' WHEN usage_line > 0 THEN 'high' ELSE 'medium' END AS risk FROM hn)),
n AS (SELECT (SELECT count(*) FROM s) AS a, (SELECT count(*) FROM k) AS b, (SELECT count(*) FROM judged) AS c, (SELECT count(*) FROM judged WHERE NOT sanitized) AS d, (SELECT count(*) FROM judged WHERE risk = 'critical') AS e, (SELECT count(*) FROM judged WHERE risk = 'high') AS f, (SELECT count(*) FROM hn) AS g, (SELECT count(*) FROM hn WHERE NOT is_checked) AS h)
SELECT {{text}} AS document FROM n, fb, nb"""


def _lines(text, **columns):
    """SQL for a text with {{names}} of columns."""
    out = fq._q(text).replace("\n", "' || chr(10) || '")
    for k, v in columns.items():
        out = out.replace("<" + k + ">", f"' || {v} || '")
    return out


_REPORT = _lines(
    "# Security Data Flow Analysis\n\n**Generated:** now\n\n## Executive Summary\n\n| Metric | Value |\n|--------|-------|\n| Languages Analyzed | 1 |\n| Total Sources | <a> |\n| Total Sinks | <b> |\n| Total Flows | <c> |\n| Unsanitized Flows | <d> |\n| Critical Risk Flows | <e> |\n| High Risk Flows | <f> |\n| Nil/Null Risks | <g> |\n\n## Risk Assessment\n\n"
    "### CRITICAL (<e> issues)\n\nCritical security vulnerabilities detected that require immediate attention.\n\n### HIGH (<f> issues)\n\nHigh-risk security issues that should be addressed promptly.\n\n### NIL SAFETY (<h> issues)\n\nUnchecked nil/null values that may cause runtime panics or crashes.\n\n"
    + rp.LIMITS + "## Critical & High Risk Flows\n\n<fb>## Nil/Null Safety Issues\n\n| File | Line | Variable | Pattern | Origin | Checked | Risk |\n|------|------|----------|---------|--------|---------|------|\n<nb>\n## Language Breakdown\n\n### Typescript\n\n| Metric | Value |\n|--------|-------|\n| Sources | <a> |\n| Sinks | <b> |\n| Flows | <c> |\n| Unsanitized | <d> |\n| Critical | <e> |\n| High | <f> |\n| Nil Risks | <g> |\n\n"
    + rp.ADVICE,
    **{x: x for x in "abcdefgh"}, fb="fb.t", nb="nb.t",
)


@query("k10_security_report", _by_line(_SECURITY.replace("{nulls}", fq._NULLS.replace("h.type AS origin, h.at", "h.type AS origin, h.at") + "SELECT n.*, h.pattern FROM nulls n JOIN h USING (file, line, ord, nth)").replace("{text}", _REPORT)), "typescript_lines")
def _(c):
    statistics, flows, nils = security_inputs(c)
    return cx.lines(rp.security_report(statistics, flows, nils, "now"))
