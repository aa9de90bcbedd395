"""Queries over findings and changed files, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dims
from tidemark.operators import findings as fi
from tidemark.operators import paths as pa
from tidemark.plans.registry import query

_RANK = dims.mapped_sql("severity", dims.SEVERITY_RANK, "0")
_EXT = r"regexp_extract({}, '[^/](\.[^./]*)$', 1)"
_DIR = "CASE WHEN strpos({0}, '/') = 0 THEN '.' ELSE regexp_replace({0}, '/[^/]*$', '') END"
_DEDUP = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line, message ORDER BY {_RANK} DESC, ord) AS rn, min(ord) OVER (PARTITION BY file, line, message) AS first_ord FROM {{findings}}) WHERE rn = 1"""


@query("w01_dedup_findings", f"SELECT ord, tool, rule, severity, file, line, message, category, first_ord FROM ({_DEDUP})", "findings")
def _(f):
    return fi.dedup(f)


@query("a01_severity_summary", "SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in dims.SEVERITIES) + ", count(*) FILTER (severity NOT IN ('critical', 'high', 'warning', 'info')) AS unknown FROM {findings}", "findings")
def _(f):
    return fi.summary(f)


@query("a01_severity_errors", "SELECT ord, concat('unknown severity \"', severity, '\" for finding ', file, ':', line, ' (', message, ')') AS error FROM {findings} WHERE severity NOT IN ('critical', 'high', 'warning', 'info')", "findings")
def _(f):
    return fi.unknown_severities(f)


@query("a02_merge_versions", "SELECT tool, max_by(v, k) AS version FROM (SELECT tool, concat('1.', max(ord)) AS v, ord % 3 AS k FROM {findings} GROUP BY tool, k) GROUP BY tool", "findings")
def _(f):
    part = lambda k: f.where(F.col("ord") % 3 == k).groupBy("tool").agg(F.concat(F.lit("1."), F.max("ord")).alias("version"))
    return fi.merge_versions([part(k) for k in range(3)])


@query("j18_changed_only", "SELECT * FROM {findings} WHERE file IN (SELECT path FROM {changed})", "findings", "changed")
def _(f, c):
    return fi.keep_changed(f, c)


@query("a02_merge_results", "SELECT rule, count(*) AS n, max(ord) AS last_ord FROM (SELECT ord, rule FROM {findings} WHERE tool = 'tool0' UNION ALL SELECT ord, rule FROM {findings} WHERE tool <> 'tool0') GROUP BY rule", "findings")
def _(f):
    parts = [f.where("tool = 'tool0'"), f.where("tool <> 'tool0'")]
    return fi.merge(parts).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last_ord"))


@query("u06_append_outputs", "SELECT * FROM {findings} WHERE tool = 'tool1' UNION ALL SELECT * FROM {findings} WHERE tool = 'tool2'", "findings")
def _(f):
    return fi.merge([f.where("tool = 'tool1'"), f.where("tool = 'tool2'")])


@query("minimum_slice", f"SELECT severity, count(*) AS n FROM ({_DEDUP}) WHERE file IN (SELECT path FROM {{changed}}) GROUP BY severity", "findings", "changed")
def _(f, c):
    return fi.dedup(fi.keep_changed(f, c)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("f09_category_filter", "SELECT * FROM {findings} WHERE lower(trim(category)) = 'deprecation'", "findings")
def _(f):
    return fi.by_category(f, "Deprecation ")


@query("f10_min_severity", f"SELECT * FROM {{findings}} WHERE coalesce({dims.mapped_sql('lower(trim(severity))', dims.REVIEW_RANK)} >= 3, true)", "findings")
def _(f):
    return fi.at_least(f, "high")


@query("f11_quality_routing", "SELECT * FROM {findings} WHERE lower(trim(category)) <> 'security'", "findings")
def _(f):
    return fi.for_quality(f)


@query("f12_security_routing", "SELECT * FROM {findings} WHERE lower(trim(category)) = 'security'", "findings")
def _(f):
    return fi.for_security(f)


_LINTERS = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in dims.LINTERS) + ") AS l(linter, language, target_kind)"


@query(
    "f05_linter_targets",
    f"""SELECT DISTINCT linter, target_kind, CASE target_kind WHEN 'files' THEN path WHEN 'packages' THEN './' || regexp_replace(path, '/?[^/]*$', '') ELSE '.' END AS target
FROM (SELECT path, {dims.mapped_sql(f"lower({_EXT.format('path')})", dims.LINT_EXTENSIONS)} AS language FROM (SELECT CASE WHEN ord % 11 = 0 THEN upper(path) ELSE path END AS path FROM {{changed}})) JOIN {_LINTERS} USING (language)""",
    "changed",
)
def _(c):
    return fi.lint_targets(c.select(F.when(F.col("ord") % 11 == 0, F.upper("path")).otherwise(F.col("path")).alias("path")))


@query("f06_linter_eligibility", f"SELECT linter, language FROM {_LINTERS} WHERE language IN (SELECT {dims.mapped_sql(_EXT.format('path'), dims.SCOPE_EXTENSIONS)} FROM {{changed}})", "changed")
def _(c):
    return fi.eligible_linters(c.select(pa.language(F.col("path")).alias("language")))


_TOOLS = "CASE event_id % 9 WHEN 0 THEN 'golangci-lint' WHEN 1 THEN 'staticcheck' WHEN 2 THEN 'gosec' WHEN 3 THEN 'tsc' WHEN 4 THEN 'eslint' WHEN 5 THEN 'ruff' WHEN 6 THEN 'mypy' WHEN 7 THEN 'pylint' ELSE 'bandit' END"
_CODES = "CASE event_id % 13 WHEN 0 THEN 'SA1019' WHEN 1 THEN 'S1000' WHEN 2 THEN 'ST1005' WHEN 3 THEN 'E501' WHEN 4 THEN 'F401' WHEN 5 THEN 'UP006' WHEN 6 THEN 'W0611' WHEN 7 THEN 'gosec' WHEN 8 THEN 'unused' WHEN 9 THEN 'security/detect' WHEN 10 THEN 'no-unused-vars' WHEN 11 THEN 'B008' ELSE 'zzz' END"
_LEVELS = "CASE event_id % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'medium' WHEN 4 THEN '2' WHEN 5 THEN '1' WHEN 6 THEN 'fatal' WHEN 7 THEN 'refactor' WHEN 8 THEN 'convention' WHEN 9 THEN 'note' ELSE '' END"
_RAW = f"(SELECT event_id, {_TOOLS} AS tool, {_CODES} AS code, {_LEVELS} AS level, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'LOW' END AS confidence FROM events)"


def _raw(e):
    return e.select("event_id", F.expr(_TOOLS).alias("tool"), F.expr(_CODES).alias("code"), F.expr(_LEVELS).alias("level"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'LOW' END").alias("confidence"))


@query(
    "f22_severity_maps",
    f"""SELECT event_id, CASE
  WHEN tool IN ('golangci-lint', 'tsc') THEN CASE lower(level) WHEN 'error' THEN 'high' WHEN 'warning' THEN 'warning' ELSE 'info' END
  WHEN tool = 'staticcheck' THEN CASE WHEN code LIKE 'SA%' THEN 'warning' WHEN code LIKE 'S1%' OR code LIKE 'ST1%' THEN 'info' WHEN level = 'error' THEN 'high' ELSE 'warning' END
  WHEN tool IN ('gosec', 'bandit') THEN CASE WHEN upper(level) = 'HIGH' AND upper(confidence) = 'HIGH' THEN 'critical' WHEN upper(level) = 'HIGH' THEN 'high' WHEN upper(level) = 'MEDIUM' THEN 'warning' ELSE 'info' END
  WHEN tool = 'eslint' THEN CASE level WHEN '2' THEN 'high' WHEN '1' THEN 'warning' ELSE 'info' END
  WHEN tool = 'ruff' THEN CASE WHEN code LIKE 'S%' THEN 'high' WHEN left(code, 1) IN ('E', 'F', 'W', 'B') THEN 'warning' ELSE 'info' END
  WHEN tool = 'mypy' THEN CASE lower(level) WHEN 'error' THEN 'high' WHEN 'note' THEN 'info' ELSE 'warning' END
  ELSE CASE WHEN lower(level) IN ('fatal', 'error') THEN 'high' WHEN lower(level) = 'warning' THEN 'warning' ELSE 'info' END END AS severity FROM {_RAW}""",
    "t:events",
)
def _(e):
    return _raw(e).select("event_id", fi.severity_of(*map(F.col, ("tool", "level", "code", "confidence"))).alias("severity"))


@query(
    "f23_category_maps",
    f"""SELECT event_id, CASE tool
  WHEN 'golangci-lint' THEN CASE WHEN code = 'gosec' THEN 'security' WHEN code = 'unused' THEN 'unused' ELSE 'other' END
  WHEN 'staticcheck' THEN CASE WHEN regexp_matches(code, '^SA[1-57]') THEN 'bug' WHEN code LIKE 'SA6%' THEN 'performance' WHEN code LIKE 'SA8%' THEN 'style' WHEN code LIKE 'SA9%' THEN 'security' WHEN regexp_matches(code, '^(S1|ST1|QF)') THEN 'style' ELSE 'other' END
  WHEN 'eslint' THEN CASE WHEN code LIKE '@typescript-eslint/%' THEN 'type' WHEN contains(code, 'security') THEN 'security' WHEN contains(code, 'no-unused') THEN 'unused' WHEN code = 'parse-error' THEN 'bug' ELSE 'style' END
  WHEN 'ruff' THEN CASE WHEN code LIKE 'S%' THEN 'security' WHEN left(code, 1) IN ('F', 'B') THEN 'bug' WHEN left(code, 1) IN ('E', 'W', 'I') THEN 'style' WHEN code LIKE 'UP%' THEN 'deprecation' WHEN code LIKE 'C%' THEN 'complexity' ELSE 'other' END
  WHEN 'pylint' THEN CASE WHEN level IN ('fatal', 'error') THEN 'bug' WHEN level = 'warning' AND regexp_matches(code, '^W061[12]') THEN 'unused' WHEN level = 'warning' THEN 'bug' WHEN level = 'refactor' THEN 'complexity' WHEN level = 'convention' THEN 'style' ELSE 'other' END
  WHEN 'gosec' THEN 'security' WHEN 'bandit' THEN 'security' ELSE 'type' END AS category FROM {_RAW}""",
    "t:events",
)
def _(e):
    return _raw(e).select("event_id", fi.category_of(F.col("tool"), F.col("code"), F.col("level")).alias("category"))


@query("m25_gosec_line", "SELECT event_id, coalesce(try_cast(trim(split_part(s, '-', 1)) AS INT), 0) AS line FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat(event_id % 90, '-', event_id % 90 + 2) WHEN event_id % 3 = 1 THEN concat(' ', event_id % 50) ELSE 'x' END AS s FROM events)", "t:events")
def _(e):
    s = F.expr("CASE WHEN event_id % 3 = 0 THEN concat(event_id % 90, '-', event_id % 90 + 2) WHEN event_id % 3 = 1 THEN concat(' ', event_id % 50) ELSE 'x' END")
    return e.select("event_id", fi.first_line(s).alias("line"))


@query("f01_status_codes", "SELECT path, CASE WHEN left(status, 1) IN ('M', 'A', 'D', 'R', 'C') THEN left(status, 1) ELSE '?' END AS code FROM {changed}", "changed")
def _(c):
    return c.select("path", pa.status_code(F.col("status")).alias("code"))


@query("f02_status_buckets", "SELECT path, CASE left(status, 1) WHEN 'A' THEN 'added' WHEN 'D' THEN 'deleted' ELSE 'modified' END AS bucket, old_path IS NOT NULL AS renamed FROM {changed}", "changed")
def _(c):
    return c.select("path", pa.bucket(F.col("status")).alias("bucket"), F.col("old_path").isNotNull().alias("renamed"))


@query("f03_extension", f"SELECT DISTINCT path, {_EXT.format('path')} AS ext FROM {{changed}}", "changed")
def _(c):
    return c.select("path", pa.extension(F.col("path")).alias("ext")).distinct()


@query("f04_language_filter", "SELECT * FROM {changed} WHERE path LIKE '%.py'", "changed")
def _(c):
    return pa.of_language(c, "python")


@query("f07_flow_files", f"SELECT DISTINCT path, {dims.mapped_sql(_EXT.format('path'), dims.FLOW_EXTENSIONS)} AS language FROM {{changed}} WHERE {dims.mapped_sql(_EXT.format('path'), dims.FLOW_EXTENSIONS)} IS NOT NULL", "changed")
def _(c):
    return c.select("path", pa.language(F.col("path"), dims.FLOW_EXTENSIONS).alias("language")).where("language is not null").distinct()


@query("f08_go_sources", "SELECT DISTINCT f FROM (SELECT CASE WHEN ord % 3 = 0 THEN replace(path, '.go', '_test.go') ELSE path END AS f FROM {changed}) WHERE f LIKE '%.go' AND NOT f LIKE '%\\_test.go' ESCAPE '\\'", "changed")
def _(c):
    f = c.select(F.when(F.col("ord") % 3 == 0, F.replace("path", F.lit(".go"), F.lit("_test.go"))).otherwise(F.col("path")).alias("f"))
    return f.where(F.col("f").endswith(".go") & ~F.col("f").endswith("_test.go")).distinct()


_WORDS = "CASE event_id % 9 WHEN 0 THEN 'Golang' WHEN 1 THEN 'ts' WHEN 2 THEN 'PY' WHEN 3 THEN 'go' WHEN 4 THEN 'JavaScript' WHEN 5 THEN 'js' WHEN 6 THEN 'typescript' WHEN 7 THEN 'python' ELSE 'rust' END"


@query("f31_language_alias", f"SELECT event_id, CASE WHEN l IN ('go', 'golang') THEN 'go' WHEN l IN ('typescript', 'ts', 'javascript', 'js') THEN 'typescript' WHEN l IN ('python', 'py') THEN 'python' ELSE '' END AS language FROM (SELECT event_id, lower({_WORDS}) AS l FROM events)", "t:events")
def _(e):
    return e.select("event_id", dims.language_of(F.expr(_WORDS)).alias("language"))


@query("f21_diffs_of_language", f"SELECT event_id FROM events WHERE {_WORDS} IN ('ts', 'JavaScript', 'js', 'typescript')", "t:events")
def _(e):
    return pa.diffs_of(e.select("event_id", F.expr(_WORDS).alias("language")), "TS").select("event_id")


@query("a09_diff_languages", f"SELECT language, count(*) AS n FROM (SELECT {_WORDS} AS language FROM events) GROUP BY language", "t:events")
def _(e):
    return pa.diff_languages(e.select(F.expr(_WORDS).alias("language")))


@query("t03_language_order", "SELECT language, row_number() OVER (ORDER BY CASE language WHEN 'go' THEN 0 WHEN 'typescript' THEN 1 WHEN 'python' THEN 2 ELSE 9 END, language)::INT AS place FROM (SELECT DISTINCT " + _WORDS + " AS language FROM events)", "t:events")
def _(e):
    ordered = pa.diff_languages(e.select(F.expr(_WORDS).alias("language")))
    # one row a language
    rank = Window.orderBy(dims.mapped(F.col("language"), dims.LANGUAGE_PRIORITY, 99), "language")
    return ordered.select("language", F.row_number().over(rank).alias("place"))


@query(
    "j06_line_counts",
    """SELECT c.path, c.status, coalesce(n.additions, 0)::BIGINT AS additions, coalesce(n.deletions, 0)::BIGINT AS deletions
FROM (SELECT DISTINCT path, status FROM {changed}) c LEFT JOIN (SELECT path, sum(additions) AS additions, sum(deletions) AS deletions FROM {changed} WHERE status <> 'X' GROUP BY path) n USING (path)""",
    "changed",
)
def _(c):
    counts = c.where("status <> 'X'").groupBy(F.concat(F.lit("./"), "path").alias("path")).agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return pa.with_counts(c.select("path", "status").distinct(), counts)


_TWO = "SELECT DISTINCT concat(path, ord) AS path FROM {{changed}} WHERE left(status, 1) <> '{}'"


@query(
    "j07_presence_status",
    f"SELECT path, CASE WHEN b.path IS NOT NULL AND w.path IS NOT NULL THEN 'M' WHEN w.path IS NOT NULL THEN 'A' ELSE 'D' END AS status FROM ({_TWO.format('A')}) b FULL JOIN ({_TWO.format('D')}) w USING (path)".replace("{{", "{").replace("}}", "}"),
    "changed",
)
def _(c):
    named = c.withColumn("path", F.concat("path", "ord"))
    return pa.presence(named.where("left(status, 1) <> 'A'"), named.where("left(status, 1) <> 'D'"))


@query("a07_packages", f"SELECT DISTINCT {_DIR.format('path')} AS package FROM {{changed}}", "changed")
def _(c):
    return pa.packages(c)


@query(
    "a08_language",
    f"""SELECT languages, CASE len(languages) WHEN 0 THEN 'unknown' WHEN 1 THEN languages[1] ELSE 'mixed' END AS language
FROM (SELECT list_sort(list(DISTINCT l) FILTER (l IS NOT NULL)) AS languages FROM (SELECT {dims.mapped_sql(_EXT.format('path'), dims.SCOPE_EXTENSIONS)} AS l FROM {{changed}}))""",
    "changed",
)
def _(c):
    return pa.languages(c)


@query("a13_diff_totals", "SELECT count(*) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM {changed}", "changed")
def _(c):
    return c.agg(F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


@query("u01_union_paths", "SELECT path FROM {changed} WHERE status = 'M' UNION SELECT path FROM {changed} WHERE status = 'A'", "changed")
def _(c):
    return c.where("status = 'M'").select("path").union(c.where("status = 'A'").select("path")).distinct().orderBy("path")


@query("u02_modified_or_added", "SELECT path FROM {changed} WHERE left(status, 1) NOT IN ('A', 'D') UNION ALL SELECT path FROM {changed} WHERE status = 'A'", "changed")
def _(c):
    b = pa.bucket(F.col("status"))
    return c.where(b == "modified").select("path").unionAll(c.where(b == "added").select("path"))


@query("u03_touched_paths", "SELECT path, min(k) AS first_ord FROM (SELECT path, ord * 2 AS k FROM {changed} UNION ALL SELECT old_path, ord * 2 + 1 FROM {changed} WHERE old_path <> '') GROUP BY path", "changed")
def _(c):
    return pa.touched(c)


@query("u04_only_before", "SELECT file, name FROM {before_symbols} EXCEPT SELECT file, name FROM {after_symbols}", "before_symbols", "after_symbols")
def _(b, a):
    return b.select("file", "name").exceptAll(a.select("file", "name")).distinct()


@query("u05_in_both", "SELECT file, name FROM {before_symbols} INTERSECT SELECT file, name FROM {after_symbols}", "before_symbols", "after_symbols")
def _(b, a):
    return b.select("file", "name").intersect(a.select("file", "name"))


@query("u07_distinct_in_order", "SELECT path, min(ord) AS first_ord FROM {changed} GROUP BY path", "changed")
def _(c):
    return pa.first_seen(c, "path", "ord")


@query("t02_sorted_paths", "SELECT DISTINCT path FROM {changed} ORDER BY path", "changed")
def _(c):
    return c.select("path").distinct().orderBy("path")


@query("s10_numstat_path", "SELECT o_orderkey, replace(regexp_replace(p, '\\{[^{}]* => ([^{}]*)\\}', '\\1'), '//', '/') AS path FROM (SELECT o_orderkey, concat('a/{old', o_orderkey % 3, ' => ', CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE '' END, '}/b', o_custkey) AS p FROM orders)", "t:orders")
def _(o):
    from tidemark.sources.git import new_path

    p = F.expr("concat('a/{old', o_orderkey % 3, ' => ', CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE '' END, '}/b', o_custkey)")
    return o.select("o_orderkey", new_path(p).alias("path"))


@query("m11_glob_match", "SELECT DISTINCT path FROM {changed} WHERE regexp_matches(path, '^src/p1[^/]*/([^/]*/)*[^/]*\\.go$') OR regexp_matches(path, '^src/p2[^/]/m3\\.py$')", "changed")
def _(c):
    return pa.expand(c.select("path").distinct(), ["src/p1*/**/*.go", "src/p2?/m3.py"])


@query("m14_clean_path", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a/c' WHEN 1 THEN '../x' WHEN 2 THEN '/b' WHEN 3 THEN '.' ELSE concat('d', event_id, '/e') END AS path FROM events", "t:events")
def _(e):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN './a//b/../c/' WHEN 1 THEN 'q/../../x' WHEN 2 THEN '/../a/../b' WHEN 3 THEN 'a/..' ELSE concat('d', event_id, '//./e') END")
    return e.select("event_id", pa.clean(raw).alias("path"))


_GROUPED = "SELECT ord % 977 AS g, CASE WHEN ord % 977 % 3 = 0 THEN path WHEN ord % 977 % 3 = 1 THEN concat('lib/', CASE WHEN ord % 2 = 0 THEN 'a' ELSE 'a-b' END, '/', path) ELSE concat('top', ord % 2, '/x.go') END AS path FROM {changed}"


@query(
    "m15_common_ancestor",
    f"""WITH f AS (SELECT g, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS s FROM ({_GROUPED})), p AS (
  SELECT g, i, array_to_string(any_value(s[1:i]), '/') AS prefix FROM f, range(1, 9) AS r(i) GROUP BY g, i HAVING count(DISTINCT array_to_string(s[1:i], '/')) = 1 AND min(len(s)) >= i
)
SELECT f.g, coalesce(max_by(p.prefix, p.i), '.') AS ancestor FROM (SELECT DISTINCT g FROM f) f LEFT JOIN p USING (g) GROUP BY f.g""",
    "changed",
)
def _(c):
    third = F.col("ord") % 977 % 3
    path = F.when(third == 0, F.col("path")).when(third == 1, F.concat(F.lit("lib/"), F.when(F.col("ord") % 2 == 0, "a").otherwise("a-b"), F.lit("/"), "path")).otherwise(F.concat(F.lit("top"), F.col("ord") % 2, F.lit("/x.go")))
    return pa.common_ancestor(c.select((F.col("ord") % 977).alias("g"), path.alias("path")), by=["g"])


@query(
    "m11_glob_classes",
    """SELECT DISTINCT path FROM {changed} WHERE regexp_matches(path, '^src/p[1-3][^0-4/]/m[^/]*\\.(py|go)$') OR regexp_matches(path, '^src/([^/]*/)*m4\\.go$')""",
    "changed",
)
def _(c):
    return pa.expand(c.select("path").distinct(), ["src/p[1-3][^0-4]/m**.py", "src/p[1-3][^0-4]/m*.g[o]", "./src/**/m\\4.go"])


@query(
    "f33_path_errors",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'path cannot be empty' WHEN 1 THEN 'path must be relative' WHEN 2 THEN 'path contains path traversal' WHEN 3 THEN NULL WHEN 4 THEN 'path contains path traversal' ELSE NULL END AS error,
  CASE event_id % 4 WHEN 0 THEN 'ref cannot start with -' WHEN 1 THEN 'ref contains unsupported character' END AS ref_error FROM events""",
    "t:events",
)
def _(e):
    path = F.expr("CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('/etc/', event_id) WHEN 2 THEN concat('a/../../', event_id) WHEN 3 THEN concat('a/../b', event_id) WHEN 4 THEN concat('..\\\\x', event_id) ELSE concat('d/', event_id) END")
    ref = F.expr("CASE event_id % 4 WHEN 0 THEN concat('-x', event_id) WHEN 1 THEN concat('a b', event_id) WHEN 2 THEN '' ELSE concat('origin/f-', event_id, '~2^') END")
    return e.select("event_id", pa.path_error(path).alias("error"), pa.ref_error(ref).alias("ref_error"))


_RENAMED = "left(status, 1) IN ('R', 'C') AND coalesce(old_path, '') <> '' AND old_path <> path"
_SCOPE = f"""count(*) AS total_files, count(*) FILTER (left(status, 1) NOT IN ('A', 'D')) AS modified, count(*) FILTER (status = 'A') AS added, count(*) FILTER (status = 'D') AS deleted, count(*) FILTER ({_RENAMED}) AS renamed,
  sum(additions)::BIGINT AS total_additions, sum(deletions)::BIGINT AS total_deletions, CASE count(DISTINCT l) WHEN 1 THEN count(DISTINCT {_DIR.format('path')}) FILTER (l IS NOT NULL) ELSE count(DISTINCT {_DIR.format('path')}) END AS packages,
  coalesce(array_to_string(list_sort(list(DISTINCT l) FILTER (l IS NOT NULL)), ','), '') AS languages, CASE count(DISTINCT l) WHEN 0 THEN 'unknown' WHEN 1 THEN min(l) ELSE 'mixed' END AS language"""
_TYPED = f"(SELECT *, {dims.mapped_sql('lower(' + _EXT.format('path') + ')', dims.SCOPE_EXTENSIONS)} AS l FROM {{rows}})"


@query("c16_scope", f"SELECT {_SCOPE} FROM {_TYPED.replace('{rows}', '{changed}')}", "changed")
def _(c):
    return pa.scope(c)


@query("c16_scope_by_package", f"SELECT package, {_SCOPE} FROM (SELECT *, {_DIR.format('path')} AS package FROM {_TYPED.replace('{rows}', '{changed}')}) GROUP BY package", "changed")
def _(c):
    return pa.scope(c.withColumn("package", pa.dir_name(F.col("path"))), ["package"])


#: Groups of one language beside files of none, with folders of their own, extensions in any case.
_MIXED = """SELECT ord, ord % 499 AS g, concat('d', ord % 11, '/', ord % 7, CASE WHEN ord % 3 = 0 THEN concat('/notes', ord % 5, '/x.md') WHEN ord % 499 % 4 = 0 THEN '/x.GO' WHEN ord % 499 % 4 = 1 THEN '/x.py' WHEN ord % 499 % 4 = 2 THEN '/x.txt' WHEN ord % 2 = 0 THEN '/x.ts' ELSE '/x.go' END) AS path,
  status, CASE WHEN ord % 4 = 0 THEN '' WHEN ord % 4 = 1 THEN path ELSE old_path END AS old_path, additions, deletions FROM {changed}"""


@query("c16_scope_of_groups", f"SELECT g, {_SCOPE} FROM {_TYPED.replace('{rows}', '(' + _MIXED + ')')} GROUP BY g", "changed")
def _(c):
    end = F.expr("CASE WHEN ord % 3 = 0 THEN concat('/notes', ord % 5, '/x.md') WHEN ord % 499 % 4 = 0 THEN '/x.GO' WHEN ord % 499 % 4 = 1 THEN '/x.py' WHEN ord % 499 % 4 = 2 THEN '/x.txt' WHEN ord % 2 = 0 THEN '/x.ts' ELSE '/x.go' END")
    old = F.expr("CASE WHEN ord % 4 = 0 THEN '' WHEN ord % 4 = 1 THEN path ELSE old_path END")
    return pa.scope(c.select("ord", (F.col("ord") % 499).alias("g"), F.concat(F.lit("d"), F.col("ord") % 11, F.lit("/"), F.col("ord") % 7, end).alias("path"), "status", old.alias("old_path"), "additions", "deletions"), ["g"])


_ENTRIES = f"""SELECT CASE WHEN status = 'A' THEN 'added' WHEN status = 'D' THEN 'deleted' ELSE 'modified' END AS section, ord, path AS value, NULL AS old_path FROM {{changed}}
UNION ALL SELECT 'renamed', ord, path, old_path FROM {{changed}} WHERE {_RENAMED}
UNION ALL SELECT DISTINCT 'languages', 0, l, NULL FROM {_TYPED.replace('{rows}', '{changed}')} WHERE l IS NOT NULL
UNION ALL SELECT DISTINCT 'packages', 0, {_DIR.format('path')}, NULL FROM {_TYPED.replace('{rows}', '{changed}')} WHERE l IS NOT NULL OR (SELECT count(DISTINCT l) FROM {_TYPED.replace('{rows}', '{changed}')}) <> 1"""
_J = "json_quote({})::VARCHAR"


def _list_sql(name: str, section: str, pad: str, after: str, last: bool = False) -> str:
    """One list of a scope as lines: number, text."""
    comma = "" if last else ","
    shown = f"concat('{{{{', chr(10), '        \"old_path\": ', {_J.format('old_path')}, ',', chr(10), '        \"new_path\": ', {_J.format('value')}, chr(10), '      }}}}')".replace("{{", "{").replace("}}", "}") if section == "renamed" else _J.format("value")
    return f"""SELECT {after} AS part, 0 AS ord, CASE WHEN count(*) = 0 THEN '{pad}"{name}": []{comma}' ELSE '{pad}"{name}": [' END AS line FROM e WHERE section = '{section}'
UNION ALL SELECT {after} + 1, row_number() OVER (ORDER BY ord, value), concat('{pad}  ', {shown}, CASE WHEN row_number() OVER (ORDER BY ord, value) = count(*) OVER () THEN '' ELSE ',' END) FROM e WHERE section = '{section}'
UNION ALL SELECT {after} + 2, 0, '{pad}]{comma}' FROM e WHERE section = '{section}' HAVING count(*) > 0"""


_SCOPE_LINES = f"""WITH e AS MATERIALIZED ({_ENTRIES}), s AS (SELECT {_SCOPE} FROM {_TYPED.replace('{rows}', '{changed}')}), x AS (
SELECT 0 AS part, 0 AS ord, concat('{{', chr(10), '  "base_ref": "main",', chr(10), '  "head_ref": "a\\u0026b",', chr(10), '  "language": "', language, '",') AS line FROM s
UNION ALL {_list_sql('languages', 'languages', '  ', 10)} UNION ALL SELECT 20, 0, '  "files": {{'
UNION ALL {_list_sql('modified', 'modified', '    ', 30)} UNION ALL {_list_sql('added', 'added', '    ', 40)} UNION ALL {_list_sql('deleted', 'deleted', '    ', 50)} UNION ALL {_list_sql('renamed', 'renamed', '    ', 60, True)}
UNION ALL SELECT 70, 0, concat('  }},', chr(10), '  "stats": {{', chr(10), '    "total_files": ', total_files, ',', chr(10), '    "total_additions": ', total_additions, ',', chr(10), '    "total_deletions": ', total_deletions, chr(10), '  }},') FROM s
UNION ALL {_list_sql('packages_affected', 'packages', '  ', 80, True)} UNION ALL SELECT 90, 0, '}}')"""


@query("k02_scope_document", f"{_SCOPE_LINES} SELECT line, count(*) AS n FROM (SELECT unnest(string_split(line, chr(10))) AS line FROM x) GROUP BY line", "changed")
def _(c):
    """The lines of the document, counted; their order is tested with small ones."""
    lines = pa.scope_document(c, "main", "a&b").select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c17_scope_files",
    """WITH f AS (SELECT DISTINCT concat(path, ord % 40) AS path FROM {changed} WHERE ord % 6 < 5), b AS (SELECT DISTINCT concat(path, ord % 40) AS path FROM {changed} WHERE left(status, 1) <> 'A'), w AS (SELECT DISTINCT concat(path, ord % 40) AS path FROM {changed} WHERE left(status, 1) <> 'D'),
n AS (SELECT concat(path, ord % 40) AS path, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM {changed} WHERE status <> 'X' GROUP BY ALL)
SELECT f.path, CASE WHEN b.path IS NOT NULL AND w.path IS NOT NULL THEN 'M' WHEN w.path IS NOT NULL THEN 'A' ELSE 'D' END AS status, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions
FROM f LEFT JOIN b USING (path) LEFT JOIN w USING (path) LEFT JOIN n USING (path)""",
    "changed",
)
def _(c):
    named = c.withColumn("path", F.concat("path", F.col("ord") % 40))
    counts = named.where("status <> 'X'").groupBy(F.concat(F.lit("./"), "path").alias("path")).agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    listed = named.where("ord % 6 < 5").select(F.concat(F.lit("./"), "path").alias("path")).union(c.sparkSession.createDataFrame([("nowhere.go",)], "path string"))
    return pa.scope_files(listed, named.where("left(status, 1) <> 'A'"), named.where("left(status, 1) <> 'D'"), counts)


@query("c18_scope_all", "SELECT path, status, old_path, additions, deletions FROM {changed}", "changed")
def _(c):
    part = lambda k: c.where(F.col("ord") % 4 == k)
    names = c.select("path")
    return pa.scope_mode("all", part(0), part(1), c, part(3), names, names)


@query(
    "c18_scope_unstaged",
    """WITH u AS (SELECT DISTINCT concat(path, ord % 9) AS path FROM {changed} WHERE ord % 3 < 2), h AS (SELECT DISTINCT concat(path, ord % 9) AS path FROM {changed} WHERE ord % 9 < 6), w AS (SELECT DISTINCT concat(path, ord % 9) AS path FROM {changed} WHERE ord % 9 BETWEEN 2 AND 7),
n AS (SELECT concat(path, ord % 9) AS path, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM {changed} WHERE status <> 'X' GROUP BY ALL)
SELECT u.path, CASE WHEN h.path IS NOT NULL AND w.path IS NOT NULL THEN 'M' WHEN w.path IS NOT NULL THEN 'A' ELSE 'D' END AS status, NULL::VARCHAR AS old_path, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions
FROM u LEFT JOIN h USING (path) LEFT JOIN w USING (path) LEFT JOIN n USING (path) WHERE h.path IS NOT NULL OR w.path IS NOT NULL""",
    "changed",
)
def _(c):
    named = c.withColumn("path", F.concat("path", F.col("ord") % 9))
    against = named.where("status <> 'X'").groupBy("path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")).withColumns({"status": F.lit("M"), "old_path": F.lit(None).cast("string")})
    none = named.limit(0)
    return pa.scope_mode("unstaged", none, none, against, named.where("ord % 3 < 2"), named.where("ord % 9 < 6"), named.where("ord % 9 between 2 and 7"))


_PATTERNS = """SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN concat('./src/p', p_partkey % 300, '/m', p_size % 7, '.*') WHEN 1 THEN concat('src/p', p_partkey % 30, '?/*', p_size % 7, '.go') ELSE concat('**/p', p_partkey % 290, '/[m-z]', p_size % 7, '.py') END AS pattern FROM part"""
_EXPRESSIONS = """SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN concat('^src/p', p_partkey % 300, '/m', p_size % 7, '\\.[^/]*$') WHEN 1 THEN concat('^src/p', p_partkey % 30, '[^/]/[^/]*', p_size % 7, '\\.go$') ELSE concat('^([^/]*/)*p', p_partkey % 290, '/[m-z]', p_size % 7, '\\.py$') END AS expression FROM part WHERE p_size % 5 < 2"""


@query("s22_pattern_table", f"SELECT DISTINCT path FROM (SELECT DISTINCT path FROM {{changed}}) f JOIN ({_EXPRESSIONS}) e ON regexp_matches(f.path, e.expression)", "changed", "t:part")
def _(c, p):
    from tidemark.operators.globs import matching

    patterns = p.sparkSession.sql(_PATTERNS.replace("FROM part", "FROM {part}") + " WHERE p_size % 5 < 2", part=p)
    return matching(c.select("path").distinct(), patterns)


@query("t06_within_limit", "SELECT ord, path FROM {changed}", "changed")
def _(c):
    return pa.checked_count(c.select("ord", "path"), 100_000_000)
