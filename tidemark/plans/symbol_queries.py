"""Queries over parsed symbols, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import symbols as sy
from tidemark.plans.registry import query

_J = "{before_symbols} b FULL JOIN {after_symbols} a USING (file, name)"
_KIND = "CASE WHEN b.pos IS NULL THEN 'added' WHEN a.pos IS NULL THEN 'removed' WHEN b.kind IS DISTINCT FROM a.kind OR b.sig IS DISTINCT FROM a.sig OR b.body IS DISTINCT FROM a.body THEN 'modified' END"
_DIFF = f"SELECT file, name, {_KIND} AS change_type, b.sig AS bsig, a.sig AS asig, b.body AS bbody, a.body AS abody, b.pos % 4 AS bk, a.pos % 4 AS ak, coalesce(b.pos, a.pos) AS pos FROM {_J} WHERE {_KIND} IS NOT NULL"
_COLS = ["kind", "sig", "body"]


@query(
    "j01_symbol_diff",
    f"SELECT file, name, change_type, CASE WHEN change_type <> 'modified' THEN '' ELSE concat_ws(',', CASE WHEN bsig <> asig THEN 'sig' END, CASE WHEN bbody <> abody THEN 'body' END) END AS changed FROM ({_DIFF})",
    "before_symbols",
    "after_symbols",
)
def _(b, a):
    return sy.diff(b, a, ["file", "name"], _COLS).select("file", "name", "change_type", F.array_join("changed", ",").alias("changed"))


@query("j02_type_diff", f"SELECT name, change_type, bsig AS old, asig AS new FROM ({_DIFF.replace('b.body IS DISTINCT FROM a.body', 'false')}) WHERE change_type IS NOT NULL", "before_symbols", "after_symbols")
def _(b, a):
    return sy.diff(b, a, ["file", "name"], ["kind", "sig"]).select("name", "change_type", F.col("before.sig").alias("old"), F.col("after.sig").alias("new"))


@query("j03_field_diff", f"SELECT file, name, coalesce(b.sig, '-') AS old, coalesce(a.sig, '-') AS new, CASE WHEN b.sig IS NULL THEN 'added' WHEN a.sig IS NULL THEN 'removed' WHEN a.sig = b.sig THEN 'unchanged' ELSE 'modified' END AS state FROM {_J}", "before_symbols", "after_symbols")
def _(b, a):
    return sy.field_table(b, a, ["file", "name"], "sig")


@query("j04_variable_diff", f"SELECT file, name, CASE WHEN b.pos IS NULL THEN 'added' WHEN a.pos IS NULL THEN 'removed' ELSE 'modified' END AS change_type, substr(sha256(b.body::VARCHAR), 1, 16) AS old_hash, substr(sha256(a.body::VARCHAR), 1, 16) AS new_hash FROM {_J} WHERE b.body IS DISTINCT FROM a.body OR b.kind IS DISTINCT FROM a.kind", "before_symbols", "after_symbols")
def _(b, a):
    hashed = lambda d: d.withColumn("value", F.substring(F.sha2(F.col("body").cast("string"), 256), 1, 16))
    return sy.diff(hashed(b), hashed(a), ["file", "name"], ["kind", "value"]).select("file", "name", "change_type", F.col("before.value").alias("old_hash"), F.col("after.value").alias("new_hash"))


@query("j05_alias_diff", "SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change_type FROM (SELECT name AS path, sig FROM {before_symbols}) b FULL JOIN (SELECT name AS path, sig FROM {after_symbols}) a ON a.path = b.path WHERE a.sig IS DISTINCT FROM b.sig", "before_symbols", "after_symbols")
def _(b, a):
    imports = lambda d: d.select(F.col("name").alias("path"), F.col("sig").alias("alias"))
    return sy.diff(imports(b), imports(a), ["path"], ["alias"]).select("path", "change_type")


@query("j22_field_table", f"SELECT name, coalesce(b.body::VARCHAR, '-') AS old, coalesce(a.body::VARCHAR, '-') AS new, CASE WHEN b.body IS NULL THEN 'added' WHEN a.body IS NULL THEN 'removed' WHEN a.body = b.body THEN 'unchanged' ELSE 'modified' END AS state FROM {_J}", "before_symbols", "after_symbols")
def _(b, a):
    text = lambda d: d.withColumn("body", F.col("body").cast("string"))
    return sy.field_table(text(b), text(a), ["file", "name"], "body").drop("file")


_SYMBOL = "CASE coalesce(bk, ak) WHEN 0 THEN 'function' WHEN 1 THEN 'type' WHEN 2 THEN 'variable' ELSE 'import' END"


@query(
    "a03_change_summary",
    "SELECT file, " + ", ".join(f"count(*) FILTER (k = '{k}' AND change_type = '{c}') AS {k}s_{c}" for k in ("function", "type", "variable", "import") for c in ("added", "removed", "modified") if (k, c) != ("import", "modified")) + f" FROM (SELECT file, change_type, {_SYMBOL} AS k FROM ({_DIFF})) GROUP BY file",
    "before_symbols",
    "after_symbols",
)
def _(b, a):
    d = sy.diff(b, a, ["file", "name"], [*_COLS, "pos"])
    k = F.coalesce("before.pos", "after.pos") % 4
    return sy.change_summary(d.withColumn("symbol_kind", F.when(k == 0, "function").when(k == 1, "type").when(k == 2, "variable").otherwise("import")), ["file"])


@query("a15_last_occurrence", "SELECT file, kind, max(pos) AS pos FROM {before_symbols} GROUP BY file, kind", "before_symbols")
def _(b):
    return sy.last_by_key(b, ["file", "kind"]).select("file", "kind", "pos")


@query("w02_occurrence_suffix", "SELECT file, pos, CASE WHEN n = 1 THEN concat('init#', h) ELSE concat('init#', h, '#', n) END AS key FROM (SELECT file, pos, body::VARCHAR AS h, row_number() OVER (PARTITION BY file, body ORDER BY pos) AS n FROM {before_symbols})", "before_symbols")
def _(b):
    return sy.occurrence_names(b.withColumn("body_hash", F.col("body").cast("string"))).select("file", "pos", "key")


@query("m16_signature", "SELECT p_partkey, concat('func ', CASE WHEN p_partkey % 3 = 0 THEN '(s *T) ' ELSE '' END, 'fn', p_partkey, '(a ', p_brand, CASE WHEN p_size % 2 = 0 THEN ', b int' ELSE '' END, ')', CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' error' ELSE ' (int, error)' END) AS signature FROM part", "t:part")
def _(p):
    a = F.struct(F.lit("a").alias("name"), F.col("p_brand").alias("type"))
    b = F.struct(F.lit("b").alias("name"), F.lit("int").alias("type"))
    params = F.when(F.col("p_size") % 2 == 0, F.array(a, b)).otherwise(F.array(a))
    returns = F.expr("CASE p_size % 3 WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array('error') ELSE array('int', 'error') END")
    return p.select("p_partkey", sy.signature(F.concat(F.lit("fn"), "p_partkey"), params, returns, F.when(F.col("p_partkey") % 3 == 0, "s *T")).alias("signature"))


@query("m32_change_buckets", f"SELECT file, change_type, count(*) AS n, min(name || ':' || change_type) AS first_label FROM ({_DIFF}) GROUP BY file, change_type", "before_symbols", "after_symbols")
def _(b, a):
    d = sy.diff(b, a, ["file", "name"], _COLS)
    return d.groupBy("file", "change_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat("name", F.lit(":"), "change_type")).alias("first_label"))


@query("f17_signature_changed", f"SELECT file, name, bsig AS old, asig AS new FROM ({_DIFF}) WHERE change_type = 'modified' AND bsig <> asig", "before_symbols", "after_symbols")
def _(b, a):
    d = sy.diff(b, a, ["file", "name"], _COLS).where("change_type = 'modified' and before.sig <> after.sig")
    return d.select("file", "name", F.col("before.sig").alias("old"), F.col("after.sig").alias("new"))


_RECEIVER = "CASE WHEN {0} % 3 = 0 THEN concat('r', {0} % 5) ELSE '' END"
_FOLDER = "CASE pos % 4 WHEN 0 THEN concat('src/./', name, '//x.go') WHEN 1 THEN concat(name, '.go') WHEN 2 THEN concat('/a/', name, '/x.go') ELSE concat('../', name, '/x.go') END"


def _with_receivers(b, a):
    sides = [d.withColumn("receiver", F.expr(_RECEIVER.format("body"))) for d in (b, a)]
    return sy.diff(*sides, ["file", "name"], [*_COLS, "receiver", "pos"])


@query(
    "f20_modified_functions",
    f"SELECT {_FOLDER} AS file, CASE pos % 4 WHEN 0 THEN 'src/' || name WHEN 1 THEN 'main' WHEN 2 THEN name ELSE '../' || name END AS package, coalesce(nullif({_RECEIVER.format('abody')}, ''), nullif({_RECEIVER.format('bbody')}, ''), '') AS receiver FROM ({_DIFF}) WHERE change_type <> 'removed'",
    "before_symbols",
    "after_symbols",
)
def _(b, a):
    d = _with_receivers(b, a).where("change_type <> 'modified' or size(array_except(changed, array('pos'))) > 0")
    return sy.modified_functions(d.withColumn("pos", F.coalesce("before.pos", "after.pos")).withColumn("file", F.expr(_FOLDER))).select("file", "package", "receiver")


@query(
    "m32_function_buckets",
    f"""SELECT CASE change_type WHEN 'removed' THEN 'functions.deleted' ELSE concat('functions.', change_type) END AS bucket, file, name, CASE WHEN change_type = 'modified' THEN coalesce(nullif({_RECEIVER.format('abody')}, ''), nullif({_RECEIVER.format('bbody')}, ''), '') END AS receiver,
  bsig AS before, asig AS after, CASE WHEN change_type = 'modified' THEN concat_ws(',', CASE WHEN bbody <> abody THEN 'body' END, CASE WHEN bsig <> asig THEN 'signature_changed' END) ELSE '' END AS changes FROM ({_DIFF})""",
    "before_symbols",
    "after_symbols",
)
def _(b, a):
    d = _with_receivers(b, a).where("change_type <> 'modified' or size(array_except(changed, array('pos'))) > 0")
    body = F.when(F.array_contains("changed", "body"), "body").otherwise("")
    return sy.function_buckets(d.withColumn("body_diff", body)).withColumn("changes", F.array_join("changes", ","))


@query("c20_batch_diff", f"SELECT p.file, n_changes, CASE WHEN n_changes IS NULL THEN concat('no result for ', p.file) END AS error FROM (SELECT DISTINCT file FROM {{before_symbols}} UNION SELECT 'missing.go') p LEFT JOIN (SELECT file, count(*) AS n_changes FROM ({_DIFF}) GROUP BY file) USING (file)", "before_symbols", "after_symbols")
def _(b, a):
    n = sy.diff(b, a, ["file", "name"], _COLS).groupBy("file").agg(F.count(F.lit(1)).alias("n_changes"))
    pairs = b.select("file").distinct().union(b.sparkSession.createDataFrame([("missing.go",)], "file string"))
    return sy.batch(pairs, n).select("file", "n_changes", "error")
