"""Inputs of the operators, derived from the relational tables by SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

RELATIONS = {
    "findings": """
SELECT event_id AS ord, concat('tool', event_id % 3) AS tool, event_type AS rule,
  CASE event_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'warning' WHEN 3 THEN 'info' WHEN 4 THEN 'medium' WHEN 5 THEN 'High ' ELSE 'odd' END AS severity,
  concat('src/p', user_id % 300, '/m', user_id % 7, CASE user_id % 5 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.tsx' WHEN 3 THEN '.pyi' ELSE '.md' END) AS file,
  event_id % 5 AS line, concat('message ', event_id % 4) AS message,
  CASE event_id % 9 WHEN 0 THEN ' Security ' WHEN 1 THEN 'bug' WHEN 2 THEN 'style' WHEN 3 THEN 'performance' WHEN 4 THEN 'deprecation' WHEN 5 THEN 'complexity' WHEN 6 THEN 'unused' WHEN 7 THEN 'security' ELSE 'other' END AS category
FROM events""",
    "changed": """
SELECT o_orderkey AS ord, concat('src/p', o_custkey % 300, '/m', o_orderkey % 7, CASE o_custkey % 5 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.tsx' WHEN 3 THEN '.pyi' ELSE '.md' END) AS path,
  CASE o_orderkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'A' WHEN 2 THEN 'D' WHEN 3 THEN 'R100' WHEN 4 THEN 'C075' ELSE 'X' END AS status,
  CASE WHEN o_orderkey % 6 IN (3, 4) THEN concat('old/p', o_custkey % 300, '/m.go') END AS old_path,
  o_orderkey % 50 AS additions, o_orderkey % 20 AS deletions
FROM orders""",
    "before_symbols": """
SELECT concat('f', p_partkey % 40, '.go') AS file, concat('T', p_partkey % 9, '.', 'fn', p_partkey) AS name, p_type AS kind, concat('(', p_brand, ')') AS sig,
  p_size AS body, p_partkey AS pos FROM part WHERE p_partkey % 5 <> 0""",
    "after_symbols": """
SELECT concat('f', p_partkey % 40, '.go') AS file, concat('T', p_partkey % 9, '.', 'fn', p_partkey) AS name, p_type AS kind,
  CASE WHEN p_partkey % 11 = 0 THEN concat('(', p_brand, ', x)') ELSE concat('(', p_brand, ')') END AS sig,
  CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS body, p_partkey AS pos FROM part WHERE p_partkey % 7 <> 0""",
    "code_lines": """
SELECT file, line, CASE kind
    WHEN 0 THEN concat('  ', v, ' := r.FormValue("', v, '")') WHEN 1 THEN concat('  rows, err := db.Query("SELECT " + ', v, ')')
    WHEN 2 THEN concat('  ', v, ' = html.EscapeString(', v, ')') WHEN 3 THEN concat('  exec.Command("sh", ', v, ')')
    WHEN 4 THEN concat('  ', v, ' := os.Getenv("HOME")') WHEN 5 THEN concat('  fmt.Fprintf(w, ', v, 'Str)')
    WHEN 6 THEN concat('  if ', v, ' != nil {') WHEN 7 THEN concat('  ', v, ', ok := cache[key]')
    WHEN 8 THEN concat('  ', w, ' := ', v) WHEN 9 THEN concat('  ', v, ' := store.Find(key)')
    WHEN 10 THEN concat('  ', v, '.Close()') WHEN 11 THEN concat('  // db.Exec(', v, ')') WHEN 12 THEN concat('  log.Printf("x", ', w, ')')
    WHEN 13 THEN concat('  ', v, ' = "safe"') WHEN 14 THEN concat('  os.WriteFile(name, ', w, '[0])')
    WHEN 15 THEN concat('  ', v, ' := 1 // db.Exec(', v, ')') WHEN 16 THEN concat('  done() /* db.Exec(', v, ')') WHEN 17 THEN concat('  note */ ', w, ' := ', v, ' /* aside */')
    WHEN 18 THEN concat('  send(', v, ', g(', w, ')') ELSE 'func send(a string, bee []byte) {' END AS text
FROM (
  SELECT concat('pkg/f', l_orderkey - l_orderkey % 16, '.go') AS file, CASE WHEN l_partkey % 20 = 16 AND l_suppkey % 5 > 0 THEN 17 ELSE l_partkey % 20 END AS kind,
    CASE l_suppkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'bee' WHEN 2 THEN 'cx' ELSE 'data' END AS v, CASE l_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'bee' ELSE 'cx' END AS w,
    CAST(row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS line
  FROM lineitem) AS t""",
    "python_lines": """
SELECT file, line, CASE kind
    WHEN 0 THEN concat('    ', v, ' = request.args.get("q")') WHEN 1 THEN concat('    cursor.execute(f"select {', v, '}")') WHEN 2 THEN concat('    ', v, ' = html.escape(', v, ')')
    WHEN 3 THEN concat('    subprocess.run(["x", ', v, '], shell=False)') WHEN 4 THEN concat('    ', v, ' := os.getenv("A") or os.getenv("B")') WHEN 5 THEN concat('    return make_response(', v, ')')
    WHEN 6 THEN concat('    ', v, ': str = open(p).read()') WHEN 7 THEN concat('    logger.info(', v, ')  # print(', v, ')') WHEN 8 THEN concat('    requests.get(', v, ')')
    WHEN 9 THEN concat('    os.system(', v, ')') WHEN 10 THEN concat('    cursor.execute("select ?", (', v, ',))') WHEN 11 THEN concat('    return redirect(', v, ')') WHEN 12 THEN concat('    for ', v, ' in db:')
    ELSE concat('    ', v, ' += 1') END AS text
FROM (
  SELECT concat('app/m', l_orderkey - l_orderkey % 16, '.py') AS file, l_partkey % 29 AS kind, CASE l_suppkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'value' ELSE 'row' END AS v,
    CAST(row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS line
  FROM lineitem) AS t""",
    "typescript_lines": """
SELECT file, line, CASE kind
    WHEN 0 THEN concat('  const ', v, ' = await repo.findOne(id);') WHEN 1 THEN concat('  if (', v, ' === null) return;') WHEN 2 THEN concat('  const ', v, ': string = req.query.name;')
    WHEN 3 THEN concat('  res.send(', v, '.name);') WHEN 4 THEN concat('  const ', v, ' = cache.get(key);') WHEN 5 THEN concat('  if (undefined !== ', v, ') { go(', v, ') }') WHEN 6 THEN concat('  ', v, '[0] = 1;')
    WHEN 7 THEN concat('  let ', v, ' = JSON.parse(body) as Row | null;') WHEN 8 THEN concat('  exec(', v, ');') WHEN 9 THEN concat('  el.innerHTML = DOMPurify.sanitize(', v, ');') WHEN 10 THEN concat('  use(', v, '?.id ?? 0);')
    ELSE concat('  ', v, '++;') END AS text
FROM (
  SELECT concat('web/c', l_orderkey - l_orderkey % 16, '.ts') AS file, l_partkey % 19 AS kind, CASE l_suppkey % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'item' ELSE 'row' END AS v,
    CAST(row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS line
  FROM lineitem) AS t""",
    "edges": """
SELECT DISTINCT concat('m', l_suppkey % 40, '.go:', CASE l_suppkey % 10 WHEN 0 THEN 'Test' WHEN 1 THEN 'helper' ELSE 'Run' END, l_suppkey) AS caller,
  concat('m', l_partkey % 40, '.go:', 'fn', l_partkey % 600) AS callee, l_linenumber AS site_line, l_partkey % 5 = 0 AS is_virtual
FROM lineitem""",
    "modified": "SELECT DISTINCT concat('fn', p_partkey % 700) AS name, concat('m', p_partkey % 40, '.go') AS file FROM part",
    "call_sites": """
SELECT DISTINCT concat('C', l_suppkey % 7, '.run', l_suppkey) AS caller, concat('s', l_suppkey % 40, '.py') AS file,
  CASE l_partkey % 3 WHEN 0 THEN concat('fn', l_partkey % 500) WHEN 1 THEN concat('K', l_partkey % 3, '.fn', l_partkey % 500) ELSE concat('x.y.fn', l_partkey % 500) END AS target, l_linenumber AS line
FROM lineitem""",
    "functions": """
SELECT p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN concat('K', p_partkey % 3, '.fn', p_partkey % 400) ELSE concat('fn', p_partkey % 400) END AS name, concat('d', p_partkey % 30, '.py') AS file
FROM part""",
    "nodes": """
SELECT DISTINCT concat('root/m', p_partkey % 40, '.go') AS file, CASE p_partkey % 3 WHEN 0 THEN concat('T.fn', p_partkey % 700) ELSE concat('fn', p_partkey % 700) END AS qualified, concat('fn', p_partkey % 700) AS bare
FROM part""",
}


def sql(name: str) -> str:
    """The derivation as a subquery over the plain table names."""
    return f"({RELATIONS[name].strip()})"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", RELATIONS[name])]
    text = RELATIONS[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
