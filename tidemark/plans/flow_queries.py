"""Queries over source lines: pattern hits, flows, nil risks; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.functions.patterns import GO_NIL, GO_SANITIZER, GO_SINKS, GO_SOURCES, LIBRARY, PYTHON_SANITIZERS, PYTHON_SINKS, PYTHON_SOURCES, TYPESCRIPT_NULL, TYPESCRIPT_SANITIZERS, TYPESCRIPT_SINKS, TYPESCRIPT_SOURCES
from tidemark.operators import flows as fl
from tidemark.plans.registry import query

_q = lambda x: "'" + x.replace("'", "''") + "'"
_rows = lambda ps: "(VALUES " + ", ".join(f"({i}, {_q(t)}, {_q(p)}, {_q(d)})" for i, (t, p, d) in enumerate(ps)) + ") AS p(ord, type, expression, pattern)"
#: Go lines without comments, line after line: rel is the CTE cl.
_CLEAN = r"""WITH RECURSIVE raw AS (SELECT file, line, text FROM {code_lines}),
st AS (
  SELECT file, 0 AS line, false AS inside, '' AS kept FROM raw GROUP BY file
  UNION ALL
  SELECT r.file, r.line, CASE WHEN st.inside AND strpos(r.text, '*/') = 0 THEN true ELSE contains(regexp_replace(CASE WHEN st.inside THEN substr(r.text, strpos(r.text, '*/') + 2) ELSE r.text END, '//.*|/\*.*?\*/', ' ', 'g'), '/*') END,
    CASE WHEN st.inside AND strpos(r.text, '*/') = 0 THEN '' ELSE regexp_replace(CASE WHEN st.inside THEN substr(r.text, strpos(r.text, '*/') + 2) ELSE r.text END, '//.*|/\*.*?\*/|/\*.*', '', 'g') END
  FROM st JOIN raw r ON r.file = st.file AND r.line = st.line + 1
),
cl AS (SELECT file, line, kept AS text FROM st WHERE line > 0)
"""
# equal texts are matched once
_hits = lambda ps: f"SELECT l.file, l.line, l.text, h.ord, h.type, h.pattern, h.expression FROM cl l JOIN (SELECT x.text, p.* FROM (SELECT DISTINCT text FROM cl) x JOIN {_rows(ps)} ON regexp_matches(x.text, p.expression)) h ON h.text = l.text"
_S, _K = _hits(GO_SOURCES), _hits(GO_SINKS)
_V1, _V2 = (_q(p) for p in fl._VARIABLE)
_VAR = f"coalesce(CASE WHEN regexp_extract(text, {_V1}, 1) NOT IN ('', 'if', 'for', 'switch', '_') THEN regexp_extract(text, {_V1}, 1) END, CASE WHEN regexp_extract(text, {_V2}, 1) NOT IN ('', 'if', 'for', 'switch', '_') THEN regexp_extract(text, {_V2}, 1) END, '')"
_RISK = """CASE WHEN {clean} THEN 'info' WHEN {s} IN ('http_body', 'http_query', 'http_header', 'http_path', 'user_input') AND {k} IN ('command_exec', 'database') THEN 'critical'
 WHEN {s} IN ('http_body', 'http_query', 'http_header', 'http_path', 'user_input') AND {k} IN ({shown}) THEN 'high'
 WHEN {s} IN ('env_var', 'file_read') AND {k} IN ('command_exec', 'database') THEN 'medium' WHEN {k} = 'file_write' THEN 'medium' WHEN {k} = 'logging' THEN 'low' ELSE 'info' END"""
_SHOWN = "'http_response', 'template', 'redirect'"


def _risk_sql(s, k, clean, ssrf=False):
    return _RISK.replace("{s}", s).replace("{k}", k).replace("{clean}", clean).replace("{shown}", _SHOWN + (", 'ssrf'" if ssrf else ""))


@query("j08_pattern_hits", _CLEAN + f"SELECT 'source' AS role, file, line, ord, type, length(regexp_extract(text, '^(.*?)(' || expression || ')', 1)) + 1 AS col FROM ({_S}) UNION ALL SELECT 'sink', file, line, ord, type, length(regexp_extract(text, '^(.*?)(' || expression || ')', 1)) + 1 FROM ({_K})", "code_lines")
def _(c):
    code = fl.code_only(c)
    parts = [fl.hits(code, p).select(F.lit(r).alias("role"), "file", "line", "ord", "type", F.col("column").cast("long").alias("col")) for p, r in ((GO_SOURCES, "source"), (GO_SINKS, "sink"))]
    return parts[0].unionByName(parts[1])


# every match of a pattern: the parts between matches give their places
_MATCHES = """SELECT l.file, l.line, m.* FROM {lines} l JOIN (SELECT text, ord, type, pattern, nth, place, CASE
  WHEN regexp_matches(before, '(\\w+)\\s*=\\s*$') THEN regexp_extract(before, '(\\w+)\\s*=\\s*$', 1)
  WHEN regexp_matches(before, '(\\w+)\\s*:=\\s*$') THEN regexp_extract(before, '(\\w+)\\s*:=\\s*$', 1)
  WHEN regexp_matches(before, '(\\w+)\\s*:\\s*\\w+\\s*=\\s*$') THEN regexp_extract(before, '(\\w+)\\s*:\\s*\\w+\\s*=\\s*$', 1)
  WHEN regexp_matches(rest, '^\\w+\\.(\\w+)') THEN regexp_extract(rest, '^\\w+\\.(\\w+)', 1)
  WHEN regexp_matches(rest, '^\\w+') THEN regexp_extract(rest, '^(\\w+)', 1) ELSE '<unknown>' END AS variable
FROM (SELECT *, rtrim(left(text, place - 1)) AS before, substr(text, place) AS rest FROM (
  SELECT text, ord, type, pattern, nth, 1 + list_sum(list_transform(parts[1:nth + 1], lambda x: length(x)))::INT + coalesce(list_sum(list_transform(found[1:nth], lambda x: length(x))), 0)::INT AS place FROM (
    SELECT *, unnest(range(len(found)))::INT AS nth FROM (
      SELECT l.text, p.ord, p.type, p.pattern, string_split_regex(l.text, p.expression) AS parts, regexp_extract_all(l.text, p.expression) AS found
      FROM (SELECT DISTINCT text FROM {lines}) l JOIN {rows} ON regexp_matches(l.text, p.expression)))))) m ON m.text = l.text"""


def _matches(lines, patterns):
    return _MATCHES.replace("{lines}", lines).replace("{rows}", _rows(patterns))


_LANGUAGE = {"python": ("python_lines", PYTHON_SOURCES, PYTHON_SINKS, PYTHON_SANITIZERS), "typescript": ("typescript_lines", TYPESCRIPT_SOURCES, TYPESCRIPT_SINKS, TYPESCRIPT_SANITIZERS)}
for _language, (_lines, _sources, _sinks, _) in _LANGUAGE.items():

    @query(f"j08_{_language}_hits", f"SELECT 'source' AS role, file, line, ord, nth, type, place AS col, variable FROM ({_matches('{' + _lines + '}', _sources)}) UNION ALL SELECT 'sink', file, line, ord, nth, type, place, variable FROM ({_matches('{' + _lines + '}', _sinks)})", _lines)
    def _(c, sources=_sources, sinks=_sinks):
        parts = [fl.every_hit(c, p).select(F.lit(r).alias("role"), "file", "line", "ord", "nth", "type", F.col("column").alias("col"), "variable") for p, r in ((sources, "source"), (sinks, "sink"))]
        return parts[0].unionByName(parts[1])


@query("m04_nil_patterns", _CLEAN + "SELECT l.file, l.line, p.ord, regexp_extract(l.text, p.pattern, 1) AS variable FROM cl l JOIN (VALUES " + ", ".join(f"({i}, {_q(p)})" for i, p in enumerate(GO_NIL)) + ") AS p(ord, pattern) ON regexp_extract(l.text, p.pattern, 1) <> ''", "code_lines")
def _(c):
    each = [F.when(F.regexp_extract("text", p, 1) != "", F.struct(F.lit(i).alias("ord"), F.regexp_extract("text", p, 1).alias("variable"))) for i, p in enumerate(GO_NIL)]
    return fl.code_only(c).select("file", "line", F.explode(F.array_compact(F.array(*each))).alias("n")).select("file", "line", "n.*")


@query("m05_assigned_variable", f"SELECT file, line, {_VAR} AS variable FROM {{code_lines}}", "code_lines")
def _(c):
    return c.select("file", "line", fl.assigned_variable(F.col("text")).alias("variable"))


@query("m06_called_function", r"SELECT file, line, regexp_extract(text, '(\w+(?:\.\w+)*)\s*\(', 1) AS function FROM {code_lines}", "code_lines")
def _(c):
    return c.select("file", "line", fl.called_function(F.col("text")).alias("function"))


@query("m07_match_column", r"SELECT doc_id, CASE WHEN regexp_matches(text, '[aeiou]\w+ing\b') THEN strlen(regexp_extract(text, '^((?s:.)*?)[aeiou]\w+ing\b', 1)) + 1 ELSE 0 END::INT AS col FROM documents", "t:documents")
def _(d):
    return d.select("doc_id", F.coalesce(fl.match_column(F.col("text"), r"[aeiou]\w+ing\b"), F.lit(0)).alias("col"))


_MENTION = "(regexp_matches({t}, '(^|[^A-Za-z0-9_])' || {n} || '([^A-Za-z0-9_]|$)') OR contains({t}, {n} || '.') OR contains({t}, {n} || '[') OR contains({t}, '*' || {n}) OR contains({t}, '&' || {n}) OR contains({t}, {n} || 'Str') OR contains({t}, {n} || 'Bytes'))"


def _mention(t, n):
    return _MENTION.replace("{t}", t).replace("{n}", n)


@query("m08_identifier", f"SELECT file, line FROM {{code_lines}} WHERE {_mention('text', chr(39) + 'a' + chr(39))}", "code_lines")
def _(c):
    return c.where(fl.identifier_in(F.col("text"), "a")).select("file", "line")


@query("m12_compact", "SELECT file, line, replace(replace(text, ' ', ''), chr(9), '') AS text FROM {code_lines}", "code_lines")
def _(c):
    return c.select("file", "line", fl.compact(F.col("text")).alias("text"))


@query("f24_flow_risk", "SELECT s.t AS source_type, k.t AS sink_type, c AS sanitized, " + _risk_sql("s.t", "k.t", "c") + f" AS risk FROM (SELECT DISTINCT type AS t FROM {_rows(GO_SOURCES)}) s, (SELECT DISTINCT type AS t FROM {_rows(GO_SINKS)}) k, (VALUES (true), (false)) AS x(c)", "t:region")
def _(r):
    return _grid(r.sparkSession, "go", False)


@query("f25_flow_risk_python", "SELECT s.t AS source_type, k.t AS sink_type, c AS sanitized, " + _risk_sql("s.t", "k.t", "c", True) + f" AS risk FROM (SELECT DISTINCT type AS t FROM {_rows(LIBRARY['python'][0])}) s, (SELECT DISTINCT type AS t FROM {_rows(LIBRARY['python'][1])}) k, (VALUES (true), (false)) AS x(c)", "t:region")
def _(r):
    return _grid(r.sparkSession, "python", True)


def _grid(spark, language, ssrf):
    """Every pair of types, from the fixed libraries."""
    sources, sinks = LIBRARY[language]
    pairs = [(s, k, c) for s in sorted({x[0] for x in sources}) for k in sorted({x[0] for x in sinks}) for c in (True, False)]
    rows = spark.createDataFrame(pairs, "source_type string, sink_type string, sanitized boolean")
    return rows.withColumn("risk", fl.risk(F.col("source_type"), F.col("sink_type"), F.col("sanitized"), ssrf))


_PID = "substr(sha256(concat(file, ':', sline, ':', stype, ':', file, ':', kline, ':', ktype)), 1, 16)"


def _positional_sql(language):
    """CTEs: lines, s, k, pairs (every pair), first (of each id), checked (with sanitized), judged (with risk)."""
    lines, sources, sinks, sanitizers = _LANGUAGE[language]
    cleaners = "(VALUES " + ", ".join(f"('{t}', {_q('(?i)' + '|'.join(ps))})" for t, ps in sanitizers.items()) + ") AS c(type, expression)"
    return f"""WITH lines AS (SELECT * FROM {{{lines}}}), s AS ({_matches('lines', sources)}), k AS ({_matches('lines', sinks)}),
pairs AS (SELECT s.file, s.line AS sline, s.ord AS sord, s.nth AS snth, s.type AS stype, k.line AS kline, k.ord AS kord, k.nth AS knth, k.type AS ktype FROM s JOIN k ON s.file = k.file AND s.line <= k.line),
first AS (SELECT * FROM (SELECT *, {_PID} AS id, row_number() OVER (PARTITION BY file, {_PID} ORDER BY sline, sord, snth, kline, kord, knth) AS rn FROM pairs) WHERE rn = 1),
cleaning AS (SELECT l.file, l.line, h.type FROM lines l JOIN (SELECT x.text, c.type FROM (SELECT DISTINCT text FROM lines) x JOIN {cleaners} ON regexp_matches(x.text, c.expression)) h ON h.text = l.text),
checked AS (SELECT f.*, EXISTS (SELECT 1 FROM cleaning c WHERE c.file = f.file AND c.type = f.ktype AND c.line BETWEEN f.sline AND f.kline) AS sanitized FROM first f),
judged AS (SELECT *, {_risk_sql('stype', 'ktype', 'sanitized', True)} AS risk FROM checked)
"""


_POSITIONAL = _positional_sql("python")


def positional(c):
    return fl.positional_flows(fl.every_hit(c, PYTHON_SOURCES), fl.every_hit(c, PYTHON_SINKS))


def firsts(c, language="python"):
    _, sources, sinks, sanitizers = _LANGUAGE[language]
    found = fl.stored_hits(fl.sanitizing_counts(c, sanitizers), {"sources": sources, "sinks": sinks})
    return fl.first_flows(found["sources"], found["sinks"])


def judged(c, language="python"):
    f = fl.window_sanitized(firsts(c, language), _LANGUAGE[language][3])
    return f.withColumn("risk", fl.risk(F.col("source_type"), F.col("sink_type"), F.col("sanitized"), True))


@query("j10_positional_flows", _POSITIONAL + "SELECT file, sline AS source_line, stype AS source_type, kline AS sink_line, ktype AS sink_type FROM pairs", "python_lines")
def _(c):
    return positional(c).select(F.col("source_file").alias("file"), "source_line", "source_type", "sink_line", "sink_type")


@query("w03_first_flow", _POSITIONAL + "SELECT id, file, sline AS source_line, sord AS source_ord, kline AS sink_line, kord AS sink_ord FROM first", "python_lines")
def _(c):
    return firsts(c).select("id", F.col("source_file").alias("file"), "source_line", "source_ord", "sink_line", "sink_ord")


@query("j11_window_sanitized", _POSITIONAL + "SELECT id, ktype AS sink_type, sanitized FROM checked", "python_lines")
def _(c):
    return judged(c).select("id", "sink_type", "sanitized")


@query("j11_typescript_sanitized", _positional_sql("typescript") + "SELECT id, ktype AS sink_type, sanitized, risk FROM judged", "typescript_lines")
def _(c):
    return judged(c, "typescript").select("id", "sink_type", "sanitized", "risk")


# the first later line that checks or uses a name that may be null
_NULLS = rf"""WITH lines AS (SELECT * FROM {{typescript_lines}}), h AS ({_matches('lines', [(o, p.replace('(?!' + chr(92) + '!)', ''), d) for p, d, o in TYPESCRIPT_NULL])}),
e AS (
  SELECT h.file, h.line, h.ord, h.nth, h.variable, min(l.line) FILTER (regexp_matches(l.text, '\b' || h.variable || '\b\s*(!==?|===?)\s*(null|undefined)|(null|undefined)\s*(!==?|===?)\s*\b' || h.variable || '\b')) AS c,
    min(l.line) FILTER (regexp_matches(l.text, '\b' || h.variable || '\b\s*(?:\.|\[)')) AS u
  FROM h LEFT JOIN lines l ON l.file = h.file AND l.line > h.line AND h.variable <> '<unknown>' GROUP BY ALL
),
nulls AS (
  SELECT h.file, h.line, h.ord, h.nth, h.variable, h.type AS origin, h.place AS col, coalesce(c <= coalesce(u, c), false) AS is_checked, CASE WHEN c <= coalesce(u, c) THEN c ELSE 0 END AS check_line, CASE WHEN u < coalesce(c, u + 1) THEN u ELSE 0 END AS usage_line
  FROM h JOIN e USING (file, line, ord, nth)
)
"""


@query("j12_null_typescript", _NULLS + "SELECT *, CASE WHEN is_checked THEN 'low' WHEN usage_line > 0 THEN 'high' ELSE 'medium' END AS risk FROM nulls", "typescript_lines")
def _(c):
    return fl.null_risks(c).withColumnRenamed("column", "col").drop("pattern")


_FLOW_COUNTS = "count(*) AS total_flows, count(*) FILTER (NOT sanitized) AS unsanitized_flows, count(*) FILTER (risk = 'critical') AS critical_flows, count(*) FILTER (risk = 'high') AS high_risk_flows"


@query(
    "a04_flow_stats",
    _POSITIONAL + f"SELECT file, coalesce(a.n, 0) AS total_sources, coalesce(b.n, 0) AS total_sinks, coalesce(total_flows, 0) AS total_flows, coalesce(unsanitized_flows, 0) AS unsanitized_flows, coalesce(critical_flows, 0) AS critical_flows, coalesce(high_risk_flows, 0) AS high_risk_flows, 0::BIGINT AS nil_risks, 0::BIGINT AS unchecked_nil_risks "
    f"FROM (SELECT file, count(*) AS n FROM s GROUP BY file) a FULL JOIN (SELECT file, count(*) AS n FROM k GROUP BY file) b USING (file) LEFT JOIN (SELECT file, {_FLOW_COUNTS} FROM judged GROUP BY file) USING (file)",
    "python_lines",
)
def _(c):
    a = fl.analysis(c, "python", PYTHON_SANITIZERS)
    return fl.statistics(a["sources"], a["sinks"], a["flows"].withColumnRenamed("source_file", "file"), a["nil_sources"], ["file"])


@query(
    "c21_analysis_python",
    _POSITIONAL + f"SELECT (SELECT count(*) FROM s) AS total_sources, (SELECT count(*) FROM k) AS total_sinks, {_FLOW_COUNTS}, 0::BIGINT AS nil_risks, 0::BIGINT AS unchecked_nil_risks FROM judged",
    "python_lines",
)
def _(c):
    return fl.analysis(c, "python", PYTHON_SANITIZERS)["statistics"]


@query(
    "c21_analysis_typescript",
    _positional_sql("typescript") + f"SELECT (SELECT count(*) FROM s) AS total_sources, (SELECT count(*) FROM k) AS total_sinks, {_FLOW_COUNTS}, (SELECT count(*) FROM ({_NULLS} SELECT * FROM nulls)) AS nil_risks, (SELECT count(*) FROM ({_NULLS} SELECT * FROM nulls WHERE NOT is_checked)) AS unchecked_nil_risks FROM judged",
    "typescript_lines",
)
def _(c):
    return fl.analysis(c, "typescript", TYPESCRIPT_SANITIZERS)["statistics"]


@query("f30_recommendation", _POSITIONAL + f"SELECT ktype AS sink_type, {dims.mapped_sql('ktype', dims.RECOMMENDATIONS, _q(dims.OTHER_RECOMMENDATION))} AS recommendation, count(*) AS n FROM checked WHERE NOT sanitized GROUP BY ALL", "python_lines")
def _(c):
    return judged(c).where(~F.col("sanitized")).groupBy("sink_type", fl.recommendation(F.col("sink_type")).alias("recommendation")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_flow_buckets", _POSITIONAL + "SELECT id, CASE WHEN risk IN ('critical', 'high') THEN 'high' ELSE 'medium' END AS bucket FROM judged WHERE risk IN ('critical', 'high', 'medium')", "python_lines")
def _(c):
    return judged(c).where(F.col("risk").isin("critical", "high", "medium")).select("id", F.when(F.col("risk") == "medium", "medium").otherwise("high").alias("bucket"))


@query("t01_flows_by_risk", _POSITIONAL + "SELECT id, risk FROM judged", "python_lines")
def _(c):
    return fl.by_risk(judged(c)).select("id", "risk")


# tracked flows: the fold, line by line
_LHS = r"regexp_extract(text, '^\s*([A-Za-z_]\w*)\s*:?=\s*(.+)$', 1)"
_RHS = r"regexp_extract(text, '^\s*([A-Za-z_]\w*)\s*:?=\s*(.+)$', 2)"
_ANY = f"len(list_filter({{names}}, lambda n: {_mention('{text}', 'n')})) > 0"


def _any(names, text):
    return _ANY.replace("{names}", names).replace("{text}", text)


#: send is the one function that the lines define, of parameters a and bee.
_ARGS = "regexp_extract(text, 'send\\s*\\(([^)]*)\\)', 1)"


def _step(names, var):
    one = f"CASE WHEN {_any(names, 'l.arg1')} THEN ['a'] ELSE [] END"
    # the second argument is looked at with the first parameter tracked already
    both = f"list_concat({names}, {one})"
    more = f"list_distinct(list_concat({both}, CASE WHEN {_any(both, 'l.arg2')} THEN ['bee'] ELSE [] END))"
    return f"CASE WHEN l.lhs = '_' THEN {names} WHEN l.lhs = '' THEN CASE WHEN l.args = '' OR NOT d.defined THEN {names} ELSE {more} END WHEN {_any(names, 'l.rhs')} THEN list_distinct(list_append({names}, l.lhs)) WHEN l.lhs <> {var} THEN list_filter({names}, lambda n: n <> l.lhs) ELSE {names} END"


_TAINT = (
    _CLEAN
    + f""", l AS (SELECT *, {_LHS} AS lhs, {_RHS} AS rhs, {_VAR} AS var, {_ARGS} AS args, trim(split_part({_ARGS}, ',', 1)) AS arg1, CASE WHEN contains({_ARGS}, ',') THEN trim(split_part({_ARGS}, ',', 2)) ELSE '' END AS arg2 FROM cl),
d AS (SELECT file, bool_or(ltrim(text) LIKE 'func send(%') AS defined FROM l GROUP BY file),
src AS (SELECT h.file, h.line, h.ord, h.type, h.pattern, l.var FROM ({_S}) h JOIN l ON l.file = h.file AND l.line = h.line WHERE l.var <> ''),
t AS (
  SELECT s.file, s.line AS sline, s.var, s.line AS pos, {_step('[s.var]', 's.var')} AS names FROM (SELECT DISTINCT file, line, var FROM src) s JOIN l ON l.file = s.file AND l.line = s.line JOIN d ON d.file = s.file
  UNION ALL
  SELECT t.file, t.sline, t.var, l.line, {_step('t.names', 't.var')} FROM t JOIN l ON l.file = t.file AND l.line = t.pos + 1 JOIN d ON d.file = t.file
) """
)


@query("w06_taint_fold", _TAINT + "SELECT file, sline AS line, var AS name, array_to_string(list_sort(names), ',') AS names FROM (SELECT *, row_number() OVER (PARTITION BY file, sline, var ORDER BY pos DESC) AS rn FROM t) WHERE rn = 1", "code_lines")
def _(c):
    return fl.taint_sets(c, GO_SOURCES)


_TRACKED = (
    _TAINT
    + f""", k AS (SELECT h.file, h.line, h.ord, h.type, h.pattern, h.text FROM ({_K}) h),
f AS (
  SELECT src.file, src.line AS sline, src.ord AS sord, src.type AS stype, src.pattern AS spattern, src.var, k.line AS kline, k.ord AS kord, k.type AS ktype, k.pattern AS kpattern, k.text AS ktext, t.names
  FROM src JOIN t ON t.file = src.file AND t.sline = src.line JOIN k ON k.file = src.file AND k.line = t.pos + 1 WHERE {_any('t.names', 'k.text')}
),
w AS (
  SELECT f.file, f.sline, f.sord, f.kline, f.kord, list(l.var) AS given FROM f JOIN l ON l.file = f.file AND l.line >= f.sline AND l.line < f.kline
  WHERE regexp_matches(l.text, {_q(GO_SANITIZER)}) AND {_any('f.names', 'l.text')} GROUP BY ALL
),
g AS (
  SELECT f.*, CASE WHEN w.given IS NULL THEN false WHEN regexp_matches(ktext, {_q(GO_SANITIZER)}) THEN true WHEN len(list_filter(w.given, lambda v: v <> '')) = 0 THEN true ELSE {_any("list_filter(w.given, lambda v: v <> '')", 'ktext')} END AS sanitized
  FROM f LEFT JOIN w USING (file, sline, sord, kline, kord)
) """
)


def tracked(c):
    return fl.tracked_flows(c, GO_SOURCES, GO_SINKS)


@query("j09_tracked_flows", _TRACKED + f"SELECT file, sline AS source_line, stype AS source_type, var AS variable, kline AS sink_line, ktype AS sink_type, sanitized, {_risk_sql('stype', 'ktype', 'sanitized')} AS risk FROM g", "code_lines")
def _(c):
    t = tracked(c).withColumn("risk", fl.risk(F.col("source_type"), F.col("sink_type"), F.col("sanitized")))
    return t.select(F.col("source_file").alias("file"), "source_line", "source_type", "variable", "sink_line", "sink_type", "sanitized", "risk")


@query("m13_flow_id", _TRACKED + "SELECT 'flow_' || substr(sha256(concat(file, ':', sline, ':', stype, '|', file, ':', kline, ':', ktype, '|', spattern, '|', kpattern)), 1, 16) AS id FROM g", "code_lines")
def _(c):
    return tracked(c).select(fl.flow_id().alias("id"))


@query(
    "m22_descriptions",
    _TRACKED + "SELECT file, sline AS source_line, kline AS sink_line, concat('Data from ', stype, ' (', spattern, ') in variable ''', var, ''' flows to ', ktype, ' (', kpattern, ')', CASE WHEN sanitized THEN ' [sanitized]' ELSE ' [unsanitized - potential vulnerability]' END) AS description FROM g",
    "code_lines",
)
def _(c):
    return tracked(c).select(F.col("source_file").alias("file"), "source_line", "sink_line", fl.described().alias("description"))


@query(
    "w07_path_steps",
    _TRACKED
    + """SELECT file, sline AS source_line, kline AS sink_line, unnest(range(1, len(p) + 1))::INT AS step, unnest(p) AS text FROM (
  SELECT *, list_filter([concat(split_part(file, '/', 2), ':', sline, ' - Source: ', spattern), CASE WHEN sline < kline - 1 THEN concat('... ', kline - sline - 1, ' lines ...') END, concat(split_part(file, '/', 2), ':', kline, ' - Sink: ', kpattern)], lambda x: x IS NOT NULL) AS p FROM g)""",
    "code_lines",
)
def _(c):
    path = fl.numbered(fl.flow_path(F.col("source_file"), F.col("source_line"), F.col("source_pattern"), F.col("sink_line"), F.col("sink_pattern")))
    return tracked(c).select(F.col("source_file").alias("file"), "source_line", "sink_line", F.explode(path).alias("s")).select("file", "source_line", "sink_line", "s.*")


_NIL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, variable ORDER BY line DESC, ord DESC) AS rn FROM (SELECT l.file, l.line, l.text, p.ord, regexp_extract(l.text, p.pattern, 1) AS variable FROM cl l JOIN (VALUES " + ", ".join(f"({i}, {_q(p)})" for i, p in enumerate(GO_NIL)) + ") AS p(ord, pattern) ON regexp_extract(l.text, p.pattern, 1) NOT IN ('', '_'))) WHERE rn = 1"
_ORIGIN = "CASE WHEN contains(text, '[') THEN 'map_lookup' WHEN contains(text, '.(') THEN 'type_assertion' WHEN contains(text, 'Query') THEN 'database_query' WHEN contains(text, 'Unmarshal') THEN 'json_unmarshal' WHEN contains(text, 'Find') OR contains(text, 'Get') OR contains(text, 'Lookup') THEN 'lookup_operation' WHEN contains(text, 'Value(') THEN 'context_value' WHEN contains(text, '<-') THEN 'channel_receive' ELSE 'unknown' END"


@query("f29_nil_origin", _CLEAN + f"SELECT file, variable, line, {_ORIGIN} AS origin FROM ({_NIL})", "code_lines")
def _(c):
    return fl.nil_sources(fl.code_only(c)).select("file", "variable", "line", fl.nil_origin(F.col("text")).alias("origin"))


_NIL_RISK = f"""SELECT n.file, n.variable, n.line, any_value({_ORIGIN.replace('(text', '(n.text')}) AS origin,
  max(CASE WHEN contains(c, n.variable || '.') OR contains(c, '*' || n.variable) OR contains(c, n.variable || '[') THEN l.line END) AS usage_line
FROM ({_NIL}) n LEFT JOIN (SELECT file, line, replace(replace(text, ' ', ''), chr(9), '') AS c FROM cl) l ON l.file = n.file AND l.line > n.line
WHERE NOT contains(n.text, ', ok') AND NOT contains(n.text, ', _') GROUP BY n.file, n.variable, n.line
HAVING count(*) FILTER (contains(c, 'if' || n.variable || '!=nil') OR contains(c, 'if' || n.variable || '==nil') OR contains(c, 'ifnil!=' || n.variable) OR contains(c, 'ifnil==' || n.variable) OR contains(c, n.variable || '!=nil{{') OR contains(c, n.variable || '==nil{{')) = 0"""


@query("w04_nil_resolution", _CLEAN + f"SELECT *, CASE WHEN usage_line IS NULL THEN 'medium' ELSE 'high' END AS risk FROM ({_NIL_RISK})", "code_lines")
def _(c):
    return fl.nil_risks(c).drop("is_checked")


@query("f13_nil_high", _CLEAN + f"SELECT file, count(*) AS n FROM ({_NIL_RISK}) WHERE usage_line IS NOT NULL GROUP BY file", "code_lines")
def _(c):
    return fl.nil_risks(c).where("risk = 'high'").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("a12_flow_summary", _TRACKED + f"SELECT count(*) FILTER (risk IN ('critical', 'high')) AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk IN ('low', 'info')) AS low, count(*) FILTER (sanitized) AS sanitized FROM (SELECT *, {_risk_sql('stype', 'ktype', 'sanitized')} AS risk FROM g)", "code_lines")
def _(c):
    t = tracked(c).withColumn("risk", fl.risk(F.col("source_type"), F.col("sink_type"), F.col("sanitized")))
    r = F.col("risk")
    return t.agg(F.count_if(r.isin("critical", "high")).alias("high"), F.count_if(r == "medium").alias("medium"), F.count_if(r.isin("low", "info")).alias("low"), F.count_if("sanitized").alias("sanitized"))


@query(
    "c21_analysis_go",
    _TRACKED + f"SELECT (SELECT count(*) FROM ({_S})) AS total_sources, (SELECT count(*) FROM k) AS total_sinks, {_FLOW_COUNTS}, (SELECT count(*) FROM ({_NIL_RISK})) AS nil_risks, (SELECT count(*) FROM ({_NIL_RISK})) AS unchecked_nil_risks FROM (SELECT *, {_risk_sql('stype', 'ktype', 'sanitized')} AS risk FROM g)",
    "code_lines",
)
def _(c):
    return fl.analysis(c, "go")["statistics"]


@query("w05_code_lines", _CLEAN + "SELECT file, line, text FROM cl", "code_lines")
def _(c):
    return fl.code_only(c)


_COMMENTED = "(SELECT concat('f', p_partkey % 50) AS file, CAST(p_partkey AS INT) AS line, concat('a', p_partkey, CASE (p_partkey - p_partkey % 50) / 50 % 4 WHEN 0 THEN ' // b' WHEN 1 THEN ' /* c' WHEN 2 THEN ' d' ELSE ' e */ f' END) AS text FROM part)"


@query("w05_comment_state", f"SELECT file, line, CASE k WHEN 0 THEN concat('a', line, ' ') WHEN 1 THEN concat('a', line, ' ') WHEN 2 THEN CASE WHEN line < 100 THEN text ELSE '' END ELSE CASE WHEN line < 50 THEN text ELSE ' f' END END AS text FROM (SELECT *, (line - line % 50) / 50 % 4 AS k FROM {_COMMENTED})", "t:part")
def _(p):
    k = F.floor(F.col("p_partkey") / 50) % 4
    tail = F.when(k == 0, " // b").when(k == 1, " /* c").when(k == 2, " d").otherwise(" e */ f")
    return fl.code_only(p.select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), F.col("p_partkey").cast("int").alias("line"), F.concat(F.lit("a"), "p_partkey", tail).alias("text")))


@query("x04_nil_sources_in_sql", _CLEAN + f"SELECT file, variable, line, usage_line FROM ({_NIL_RISK})", "code_lines")
def _(c):
    from tidemark.sources import extensions

    extensions.install(c.sparkSession)
    return c.sparkSession.sql("SELECT * FROM analyze_lines(TABLE(SELECT file, line, text FROM {lines}) PARTITION BY file ORDER BY (line), 'go-nil-sources')", lines=fl.code_only(c.select("file", "line", "text")))
