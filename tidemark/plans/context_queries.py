"""The seven reviewers' documents line by line, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calls as ca
from tidemark.operators import contexts as cx
from tidemark.operators import findings as fi
from tidemark.operators import review as rv
from tidemark.plans import call_queries as cq
from tidemark.plans import flow_queries as fq
from tidemark.plans import review_queries as rq
from tidemark.plans.registry import query
from tidemark.sources.store import stored


def graphs(m, e):
    """Modified functions with their callers, callees and tests."""
    near = ca.neighbours(m.select("file", "name").distinct(), e)
    other = lambda part, name: F.substring_index("other", ":", part).alias(name)
    call = F.struct(other(-1, "Function"), other(1, "File"), F.col("site_line").cast("int").alias("Line"))
    up, name = F.col("direction") == "caller", F.substring_index("other", ":", -1)
    listed = lambda cond, item: F.array_sort(F.collect_list(F.when(cond, item)))
    test = F.struct(name.alias("TestFunction"), other(1, "File"), F.col("site_line").cast("int").alias("Line"))
    g = near.groupBy("node").agg(listed(up, call).alias("Callers"), listed(~up, call).alias("Callees"), listed(up & ca.is_test_function(name, "go"), test).alias("TestCoverage"))
    all_of = m.select(F.concat("file", F.lit(":"), "name").alias("node"), F.col("name").alias("Function"), F.col("file").alias("File")).distinct()
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<struct<{kind}:string,File:string,Line:int>>")).alias(c)
    return all_of.join(g, "node", "left").select("Function", "File", none("Callers", "Function"), none("Callees", "Function"), none("TestCoverage", "TestFunction"))


def _context(name, f, b, a, m, e, c):
    t = rq._tables(f, b, a, m, e, c)
    pos = F.col("pos").cast("int")
    side = lambda sig, lo, hi: F.struct(F.col(sig).alias("Signature"), (pos + lo).alias("LineStart"), (pos + hi).alias("LineEnd"))
    package = F.concat(F.lit("p_"), F.col("pos") % 5).alias("Package")
    functions = lambda rows: rows.select(package, F.col("name").alias("Name"), F.col("file").alias("File"), side("old_sig", 0, 7).alias("Before"), side("new_sig", 1, 9).alias("After"), F.when(F.col("old_sig") != F.col("new_sig"), F.array(F.lit("body"), F.lit("signature_changed"))).otherwise(F.array().cast("array<string>")).alias("Changes"))
    symbols = lambda rows: rows.select(package, F.col("name").alias("Name"), F.col("file").alias("File"), pos.alias("LineStart"))
    fields = lambda sig, other: F.struct(F.array(F.struct(F.lit("size").alias("Name"), F.col(sig).alias("Type")), F.struct(F.lit(other).alias("Name"), F.lit("int").alias("Type")), F.struct(F.lit("same").alias("Name"), F.lit("T[K]").alias("Type"))).alias("Fields"))
    types = lambda rows: rows.select(F.col("name").alias("Name"), F.lit("struct").alias("Kind"), F.col("file").alias("File"), fields("old_sig", "gone").alias("Before"), fields("new_sig", "fresh").alias("After"))
    imports = lambda rows: rows.select(F.col("file").alias("File"), F.col("name").alias("Path"), F.lit("").alias("Module"))
    of = lambda kind, change: rv.changes_of(t, kind, change)
    found = lambda rows: rows.select("ord", F.col("severity").alias("Severity"), F.col("tool").alias("Tool"), F.col("rule").alias("Rule"), F.col("file").alias("File"), F.col("line").cast("int").alias("Line"), F.col("message").alias("Message"))
    end = lambda kind, line, text: F.struct(F.col(kind).alias("Type"), F.col("source_file").alias("File"), F.col(line).cast("int").alias("Line"), F.lit(text).alias("Expression"))
    flows = lambda rows: rows.select(F.concat("source_file", F.lit(":"), F.lpad(F.col("source_line").cast("string"), 6, "0"), F.lit(":"), F.lpad(F.col("sink_line").cast("string"), 6, "0")).alias("ID"), F.col("risk").alias("Risk"), F.concat(F.lit("from "), "source_type").alias("Notes"), F.col("sanitized").alias("Sanitized"), end("source_type", "source_line", "x := <in>").alias("Source"), end("sink_type", "sink_line", "out(x)").alias("Sink"))
    nils = lambda rows: rows.select(F.col("variable").alias("Variable"), F.col("file").alias("File"), F.col("line").cast("int").alias("Line"), F.col("is_checked").alias("Checked"), F.lit(0).alias("CheckLine"), F.col("origin").alias("Expression"), F.col("risk").alias("Risk"), F.coalesce(F.concat(F.lit("used in line "), "usage_line"), F.lit("")).alias("Notes"))
    needs_graph = name in ("business-logic-reviewer", "test-reviewer", "consequences-reviewer", "dead-code-reviewer")
    g = stored(graphs(m, e), "graph") if needs_graph else None  # read for each table that it is part of
    callers = lambda: F.size(F.array_distinct(F.transform("Callers", lambda x: F.concat(x["File"], F.lit(":"), x["Function"]))))
    tables = {
        "code-reviewer": lambda: {"Findings": found(fi.for_quality(t["findings"])), "ModifiedFunctions": functions(of("function", "modified")), "AddedFunctions": symbols(of("function", "added")), "ModifiedTypes": types(of("type", "modified"))},
        "security-reviewer": lambda: {"Findings": found(fi.for_security(t["findings"])), "HighRiskFlows": flows(rv.high_risk(t)), "MediumRiskFlows": flows(t["flows"].where("risk = 'medium'"))},
        "business-logic-reviewer": lambda: {"HighImpactFunctions": g.where(callers() >= rv.HIGH_IMPACT), "ModifiedFunctions": functions(of("function", "modified"))},
        "test-reviewer": lambda: {"AllModifiedFunctionsGraph": g, "UncoveredFunctions": g.where(F.size("TestCoverage") == 0)},
        "nil-safety-reviewer": lambda: {"NilSources": nils(t["nil_sources"]), "HighRiskNilSources": nils(t["nil_sources"].where("risk = 'high'"))},
        "consequences-reviewer": lambda: {
            "SignatureChanges": functions(rv.signature_changes(t)), "TypeSurfaceChanges": types(of("type", "modified")), "ImportsAdded": imports(of("import", "added")), "ImportsRemoved": imports(of("import", "removed")), "CallerImpactedFunctions": g.where(F.size("Callers") > 0),
            "ErrorReturnsAdded": of("error_return", "added").select(F.col("name").alias("Function"), F.col("file").alias("File"), pos.alias("Line"), F.lit("error").alias("ErrorType"), F.lit("new").alias("Message")), "ErrorChecksRemoved": of("error_check", "removed").select(F.col("name").alias("Function"), F.col("file").alias("File"), pos.alias("Line")),
        },
        "dead-code-reviewer": lambda: {"DeletedFunctions": symbols(of("function", "removed")), "DeletedTypes": of("type", "removed").select(F.col("name").alias("Type")), "RemovedImports": imports(of("import", "removed")), "OrphanFunctions": g.where(F.size("Callers") == 0), "ZombieTests": g.where((F.size("Callers") > 0) & (F.size("TestCoverage") == F.size("Callers")))},
    }[name]()
    tables["FocusAreas"] = rv.focus_areas(name, t).select(F.struct("ord", "title").alias("ord"), F.col("title").alias("Title"), F.col("description").alias("Description"))
    if name in ("business-logic-reviewer", "test-reviewer"):
        return cx.reviewer_document(f.sparkSession, name, tables, partial=True, warnings=("slow | graph",))
    return cx.reviewer_document(f.sparkSession, name, tables)


_E = rq._escape


def _q(text: str) -> str:
    return fq._q(text).replace("\n", "' || chr(10) || '")


def _t(text: str, **columns: str) -> str:
    """SQL of a text with <names> for expressions."""
    out = _q(text)
    for k, v in columns.items():
        out = out.replace(f"<{k}>", f"' || {v} || '")
    return out


def _rows(source: str, order: str, text: str) -> str:
    """All rows of a source as texts in a row, '' without any."""
    return f"(SELECT coalesce(string_agg({text}, '' ORDER BY {order}), '') FROM ({source}))"


def _n(source: str) -> str:
    return f"(SELECT count(*) FROM ({source}))"


def _some(source: str, yes: str, no: str) -> str:
    return f"CASE WHEN {_n(source)} > 0 THEN {yes} ELSE {no} END"


def _ch(kind: str, change: str, more: str = "") -> str:
    return f"SELECT *, coalesce(apos, bpos) AS pos FROM ch WHERE symbol_kind = '{kind}' AND change_type = '{change}'{more}"


_CH = f"""ch AS MATERIALIZED (SELECT d.*, a.pos AS apos, b.pos AS bpos FROM {rq._CHANGED} d LEFT JOIN {{after_symbols}} a USING (file, name) LEFT JOIN {{before_symbols}} b USING (file, name))"""
_LISTS = f"""md AS (SELECT DISTINCT file, name, file || ':' || name AS node FROM {{modified}}),
up AS (SELECT node, split_part(caller, ':', -1) AS f, split_part(caller, ':', 1) AS p, site_line AS l, caller FROM md JOIN {{edges}} ON callee = node), dn AS (SELECT node, split_part(callee, ':', -1) AS f, split_part(callee, ':', 1) AS p, site_line AS l FROM md JOIN {{edges}} ON caller = node),
u AS (SELECT node, count(*) AS n, count(DISTINCT caller) AS d, string_agg(rn || '. `' || {_E('f')} || '` - `' || {_E('p')} || ':' || l || '`' || chr(10), '' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY f, p, l) AS rn FROM up) GROUP BY node),
wn AS (SELECT node, count(*) AS n, string_agg(rn || '. `' || {_E('f')} || '`' || chr(10), '' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY f, p, l) AS rn FROM dn) GROUP BY node),
te AS (SELECT node, count(*) AS n, string_agg(rn || '. `' || {_E('f')} || '` - `' || {_E('p')} || ':' || l || '`' || chr(10), '' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY f, p, l) AS rn FROM up WHERE {cq._TEST.format('f')}) GROUP BY node),
gr AS MATERIALIZED (SELECT md.file, md.name, coalesce(u.n, 0) AS nu, coalesce(u.d, 0) AS du, coalesce(wn.n, 0) AS nw, coalesce(te.n, 0) AS nt, coalesce(u.t, '') AS tu, coalesce(wn.t, '') AS tw, coalesce(te.t, '') AS tt FROM md LEFT JOIN u USING (node) LEFT JOIN wn USING (node) LEFT JOIN te USING (node))"""
_NAMES = dict(name=_E("name"), file=_E("file"), pkg="'p\\_' || pos % 5", pos="pos", end="pos + 9", start="pos + 1", old=_E("bsig"), new=_E("asig"))
_TYPE_ROWS = _rows(_ch("type", "modified"), "name, file", _t("\n#### `<name>`<kind>\n**File:** `<file>`\n\n| Field | Before | After |\n|-------|--------|-------|\n<size>| fresh | - | int (added) |\n| gone | int | (deleted) |\n", kind="{kind}", size=f"CASE WHEN bsig <> asig THEN '| size | ' || {_E('bsig')} || ' | ' || {_E('asig')} || ' |' || chr(10) ELSE '' END", **{k: _NAMES[k] for k in ("name", "file")}))
_MODIFIED, _SIGNED = _ch("function", "modified"), _ch("function", "modified", " AND bsig <> asig")
_FIND = "SELECT * FROM {{findings}} WHERE lower(trim(category)) {} 'security'"
_CELLS = {c: _E(c) for c in ("severity", "tool", "rule", "file", "message")} | {"line": "line"}
_GRAPH_ROWS = lambda where, up, down: _rows(f"SELECT * FROM gr WHERE {where}", "name, file", _t(f"\n#### `<name>`\n**File:** `<file>`\n**Risk Level:** <level> (<n> direct callers)\n\n**{up}:**\n\n<up>\n**{down}:**\n\n<down>", name=_E("name"), file=_E("file"), n="nu", up="tu", down="tw", level="CASE WHEN nu >= 3 THEN 'HIGH' WHEN nu >= 1 THEN 'MEDIUM' ELSE 'LOW' END"))
_FL = f"SELECT *, file || ':' || lpad(sline::VARCHAR, 6, '0') || ':' || lpad(kline::VARCHAR, 6, '0') AS id FROM {rq._RANKED}"
_HIGH, _MEDIUM = _FL + " WHERE risk IN ('critical', 'high')", _FL + " WHERE risk = 'medium'"
_FLOW_CELLS = dict(id=_E("id"), st=_E("stype"), kt=_E("ktype"), file=_E("file"), sl="sline", risk="risk", note=_E("'from ' || stype"), san="CASE WHEN sanitized THEN 'Yes' ELSE 'No' END")
_NIL = f"SELECT *, CASE WHEN usage_line IS NULL THEN 'medium' ELSE 'high' END AS risk FROM ({fq._NIL_RISK})"
_NIL_CELLS = dict(v=_E("variable"), file=_E("file"), line="line", risk="risk", origin=_E("origin"), note="coalesce('used in line ' || usage_line, '')")
_WARN = "\n\n> Warning: call graph analysis is partial.\n\n\n\n**Call Graph Warnings:**\n\n- slow \\| graph\n\n\n"


def _imports_sql(change: str) -> str:
    return _rows(_ch("import", change), "file, name", _t("- `<name>` in `<file>`\n", name=_E("name"), file=_E("file")))


_BODIES = {
    "code-reviewer": [
        _t("# Pre-Analysis Context: Code Quality\n\n## Static Analysis Findings (<n> issues)\n\n", n=_n(_FIND.format("<>"))),
        _some(_FIND.format("<>"), _q("\n| Severity | Tool | File | Line | Message |\n|----------|------|------|------|---------|\n") + " || " + _rows(_FIND.format("<>"), "ord", _t("| <severity> | <tool> | <file> | <line> | <message> |\n", **_CELLS)), _q("\nNo static analysis findings.\n")),
        _t("\n\n## Semantic Changes\n\n\n### Functions Modified (<n>)\n", n=_n(_MODIFIED)),
        _rows(_MODIFIED, "'p_' || pos % 5, name, file", _t("\n#### `<pkg>.<name>`\n**File:** `<file>:<start>-<end>`\n<changes>\n\n<diff>\n", changes="CASE WHEN bsig <> asig THEN '**Changes:** body, signature\\_changed' ELSE '' END", diff="CASE WHEN bsig <> asig THEN " + _t("\n```diff\n- <old>\n+ <new>\n```\n", old=_NAMES["old"], new=_NAMES["new"]) + " ELSE '' END", **{k: _NAMES[k] for k in ("pkg", "name", "file", "start", "end")})),
        _t("\n\n### Functions Added (<n>)\n", n=_n(_ch("function", "added"))), _rows(_ch("function", "added"), "'p_' || pos % 5, name, file", _t("\n- `<pkg>.<name>` at `<file>:<pos>`\n", **{k: _NAMES[k] for k in ("pkg", "name", "file", "pos")})),
        _t("\n\n### Types Modified (<n>)\n", n=_n(_ch("type", "modified"))), _TYPE_ROWS.replace("{kind}", "''"), _q("\n"),
    ],
    "security-reviewer": [
        _t("# Pre-Analysis Context: Security\n\n## Security Scanner Findings (<n> issues)\n\n", n=_n(_FIND.format("="))),
        _some(_FIND.format("="), _q("\n| Severity | Tool | Rule | File | Line | Message |\n|----------|------|------|------|------|---------|\n") + " || " + _rows(_FIND.format("="), "ord", _t("| <severity> | <tool> | <rule> | <file> | <line> | <message> |\n", **_CELLS)), _q("\nNo security scanner findings.\n")),
        _t("\n\n## Data Flow Analysis\n\n\n### High Risk Flows (<n>)\n", n=_n(_HIGH)),
        _rows(_HIGH, "id, risk, stype, ktype, sanitized", _t("\n#### <id>: <st> -> <kt>\n**File:** `<file>:<sl>`\n**Risk:** <risk>\n**Notes:** <note>\n\n**Source:** `x := &lt;in&gt;`\n**Sink:** `out\\(x\\)`\n**Sanitized:** <san>\n", **_FLOW_CELLS)),
        _t("\n\n### Medium Risk Flows (<n>)\n\n", n=_n(_MEDIUM)), _rows(_MEDIUM, "id, risk, stype, ktype, sanitized", _t("- <st> -> <kt> at `<file>:<sl>` (<note>)\n", **_FLOW_CELLS)), _q(""),
    ],
    "business-logic-reviewer": [
        _q("# Pre-Analysis Context: Business Logic\n\n## Impact Analysis\n\n\n### High Impact Changes\n" + _WARN + "\n"), _GRAPH_ROWS("du >= 3", "Direct Callers (signature change affects these)", "Callees (this function depends on)"),
        _q("\n\n\n## Semantic Changes\n\n\n### Functions with Logic Changes\n\n"),
        f"(SELECT coalesce(string_agg({_t('<rn>. **`<pkg>.<name>`** - <changes>' + chr(10), rn='rn', pkg=_NAMES['pkg'], name=_NAMES['name'], changes=chr(67) + 'ASE WHEN bsig <> asig THEN ' + chr(39) + 'body, signature' + chr(92) + '_changed' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END')}, '' ORDER BY rn), '') FROM (SELECT *, row_number() OVER (ORDER BY 'p_' || pos % 5, name, file) AS rn FROM ({_MODIFIED})))",
    ],
    "test-reviewer": [
        _q("# Pre-Analysis Context: Testing\n\n## Test Coverage for Modified Code\n\n" + _WARN + "\n| Function | File | Tests | Status |\n|----------|------|-------|--------|\n"),
        _rows("SELECT * FROM gr", "name, file", _t("| `<name>` | <file> | <n> tests | <state> |\n", name=_E("name"), file=_E("file"), n="nt", state="CASE nt WHEN 0 THEN 'No tests' ELSE nt || ' tests' END")), _q("\n\n## Uncovered New Code\n\n"),
        _some("SELECT * FROM gr WHERE nt = 0", _q("\n\n") + " || " + _rows("SELECT * FROM gr WHERE nt = 0", "name, file", _t("- `<name>` at `<file>` - **No tests found**\n", name=_E("name"), file=_E("file"))), _q("\n\nAll modified code has test coverage.\n\n")),
    ],
    "nil-safety-reviewer": [
        _q("# Pre-Analysis Context: Nil Safety\n\n## Nil Source Analysis\n\n"),
        _some(_NIL, _q("\n| Variable | File | Line | Checked? | Risk |\n|----------|------|------|----------|------|\n") + " || " + _rows(_NIL, "variable, file, line", _t("| `<v>` | <file> | <line> | No | <risk> |\n", **_NIL_CELLS)), _q("\nNo nil sources detected in changed code.\n")), _q("\n\n## High Risk Nil Sources\n\n"),
        _rows(_NIL + " WHERE usage_line IS NOT NULL", "variable, file, line", _t("\n### `<v>` at `<file>:<line>`\n**Expression:** `<origin>`\n**Checked:** No\n**Notes:** <note>\n", **_NIL_CELLS)),
    ],
    "consequences-reviewer": [
        _t("# Pre-Analysis Context: Consequences\n\n## API Surface Changes\n\n\n### Signature Changes (<n>)\n", n=_n(_SIGNED)),
        _some(_SIGNED, _q("\n") + " || " + _rows(_SIGNED, "'p_' || pos % 5, name, file", _t("\n#### `<pkg>.<name>`\n**File:** `<file>:<start>-<end>`\n\n```diff\n- <old>\n+ <new>\n```\n", **{k: _NAMES[k] for k in ("pkg", "name", "file", "start", "end", "old", "new")})) + " || chr(10)", _q("\nNo signature changes detected.\n")),
        _t("\n\n### Type Shape Changes (<n>)\n", n=_n(_ch("type", "modified"))), _some(_ch("type", "modified"), _q("\n") + " || " + _TYPE_ROWS.replace("{kind}", "' (struct)'") + " || chr(10)", _q("\nNo type shape changes.\n")), _q("\n\n### Dependency Changes\n"),
        f"CASE WHEN {_n(_ch('import', 'added'))} + {_n(_ch('import', 'removed'))} > 0 THEN " + _t("\n**Added imports (<n>):**\n\n", n=_n(_ch("import", "added"))) + " || " + _imports_sql("added") + " || " + _t("\n**Removed imports (<n>):**\n\n", n=_n(_ch("import", "removed"))) + " || " + _imports_sql("removed") + " ELSE " + _q("\nNo import changes.\n") + " END",
        _q("\n\n## Caller Chain Impact\n\n"), _some("SELECT * FROM gr WHERE nu > 0", _q("\n") + " || " + _GRAPH_ROWS("nu > 0", "Direct callers (may break if behaviour or signature shifted)", "Callees (implicit dependencies this function relies on)") + " || chr(10)", _q("\nNo caller chain data available.\n")),
        _t("\n\n## Error Contract Shifts\n\n### New error returns (<n>)\n", n=_n(_ch("error_return", "added"))), _some(_ch("error_return", "added"), _q("\n\n") + " || " + _rows(_ch("error_return", "added"), "name, file", _t("- `<name>` at `<file>:<pos>` returns `error` - new\n", **{k: _NAMES[k] for k in ("name", "file", "pos")})), _q("\nNo new error returns.\n")),
        _t("\n\n### Removed error checks (<n>)\n", n=_n(_ch("error_check", "removed"))), _some(_ch("error_check", "removed"), _q("\n\n") + " || " + _rows(_ch("error_check", "removed"), "name, file", _t("- `<name>` at `<file>:<pos>`\n", **{k: _NAMES[k] for k in ("name", "file", "pos")})), _q("\nNo removed error checks.\n")), _q("\n"),
    ],
    "dead-code-reviewer": [
        _t("# Pre-Analysis Context: Dead Code\n\n## Deleted Symbols\n\n\n### Deleted Functions (<n>)\n", n=_n(_ch("function", "removed"))),
        _some(_ch("function", "removed"), _q("\n\n") + " || " + _rows(_ch("function", "removed"), "'p_' || pos % 5, name, file", _t("- `<pkg>.<name>` at `<file>:<pos>`\n", **{k: _NAMES[k] for k in ("pkg", "name", "file", "pos")})), _q("\nNo deleted functions.\n")),
        _t("\n\n### Deleted Types (<n>)\n", n=_n(_ch("type", "removed"))), _some(_ch("type", "removed"), _q("\n\n") + " || " + _rows(_ch("type", "removed"), "name", _t("- `<name>`\n", name=_E("name"))), _q("\nNo deleted types.\n")),
        _t("\n\n### Removed Imports (<n>)\n", n=_n(_ch("import", "removed"))), _some(_ch("import", "removed"), _q("\n\n") + " || " + _imports_sql("removed"), _q("\nNo removed imports.\n")),
        _q("\n\n## Orphan Candidates\n\nFunctions modified in the change set whose reachable callers are missing.\n\n"),
        _some("SELECT * FROM gr WHERE nu = 0", _q("\n| Function | File | Callers | Callees |\n|----------|------|---------|---------|\n") + " || " + _rows("SELECT * FROM gr WHERE nu = 0", "name, file", _t("| `<name>` | <file> | 0 | <n> |\n", name=_E("name"), file=_E("file"), n="nw")), _q("\nNo orphan functions identified from the call graph.\n")),
        _q("\n\n## Zombie Tests\n\nTests that exercise functions which no longer have any production callers.\n\n"),
        _some("SELECT * FROM gr WHERE nu > 0 AND nt = nu", _q("\n") + " || " + _rows("SELECT * FROM gr WHERE nu > 0 AND nt = nu", "name, file", _t("\n### `<name>`\n**File:** `<file>`\n**Tests still referencing it:**\n\n<tests>", name=_E("name"), file=_E("file"), tests="tt")) + " || chr(10)", _q("\nNo zombie tests detected.\n")), _q("\n"),
    ],
}
_FOCUS = _q("\n\n## Focus Areas\n\nBased on analysis, pay special attention to:\n\n")
_AREAS = {name: (with_, counts) for name, with_, counts in rq._AREAS.values()}

for _key, _name in (("code", "code-reviewer"), ("security", "security-reviewer"), ("business", "business-logic-reviewer"), ("test", "test-reviewer"), ("nil", "nil-safety-reviewer"), ("consequences", "consequences-reviewer"), ("dead_code", "dead-code-reviewer")):
    _with, _counts = _AREAS[_name]
    _ctes = (_with + ", " if _with else "WITH ") + _CH + ", " + _LISTS + f", fa AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord, title) AS rn FROM ({rq._areas_sql(_name, _counts)}))"
    _areas = _rows("SELECT * FROM fa", "rn", _t("<rn>. **<t>** - <d>\n", rn="rn", t=_E("title"), d=_E("description"))) + " || " + _some("SELECT * FROM fa", _q("\n"), _q("\n\nNo specific focus areas identified.\n\n"))
    _document = " || ".join([*_BODIES[_name], _FOCUS, _areas])

    @query(f"k07_{_key}_context", f"{_ctes}, doc AS (SELECT {_document} AS t), ll AS (SELECT string_split(left(t, length(t) - 1), chr(10)) AS l FROM doc) SELECT unnest(generate_series(1, len(l))) AS line, unnest(l) AS text FROM ll", *rq._INPUTS)
    def _(*frames, name=_name):
        return cx.lines(_context(name, *frames))
