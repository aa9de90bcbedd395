"""Call graphs: resolution, callers and callees, tests, impact, bounded reachability.

Edges: caller, callee (node ids file:name), site_line, is_virtual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH, MAX_REACHED, SHOWN_CALLERS, SHOWN_CALLEES = 10, 10_000, 10, 5


def base_symbol(name: Column) -> Column:
    """M31."""
    return F.substring_index(name, ".", -1)


# Names of TypeScript test functions, in lower case.
TYPESCRIPT_TESTS = ("it", "test", "describe", "beforeeach", "aftereach", "beforeall", "afterall")


def is_test_function(name: Column, language: str) -> Column:
    """F27."""
    last = base_symbol(name)
    if language == "go":
        return name.rlike(r"(^|\.)(Test|Benchmark|Example|Fuzz)([^\p{Ll}.][^.]*)?$")
    if language == "python":
        return last.startswith("test_") | last.startswith("Test") | last.endswith("_test")
    lower = F.lower(name)
    return lower.isin(*TYPESCRIPT_TESTS) | lower.startswith("test_") | lower.startswith("spec_")


def is_test_file(path: Column, language: str) -> Column:
    """F28."""
    name = F.substring_index(path, "/", -1)
    if language == "go":
        return name.endswith("_test.go")
    if language == "python":
        return name.startswith("test_") | name.endswith("_test.py") | path.contains("tests/") | path.contains("test/")
    marked = name.contains(".test.") | name.contains(".spec.") | name.contains("_test.") | name.contains("_spec.")
    return marked | path.contains("__tests__") | path.contains("/test/") | path.contains("/tests/")


def impact_level(callers: Column) -> Column:
    """F26."""
    return F.when(callers >= 3, "HIGH").when(callers >= 1, "MEDIUM").otherwise("LOW")


def node(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit(":"), name)


def resolve(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """The first known function of a call site's target, by its full name or its base name.

    All alternatives need equal base names, so it is an equi-join on them; functions are reduced to
    the first of a name before it.
    """
    first = functions.withColumn("base", base_symbol(F.col("name")))
    by_base = first.groupBy("base").agg(F.min_by(F.struct("name", F.col("file").alias("callee_file")), "ord").alias("f"))
    return sites.withColumn("base", base_symbol(F.col("target"))).join(by_base, "base").select(*sites.columns, F.col("f.name").alias("callee"), "f.callee_file")


def attach(modified: DataFrame, sites: DataFrame) -> DataFrame:
    """Each modified function beside its call sites, one row a site, numbered in the order of line and target; a function without any has one row with nulls."""
    own = sites.select("file", F.col("caller").alias("name"), "line", "target")
    nth = F.row_number().over(Window.partitionBy("file", "name").orderBy("line", "target"))
    return modified.join(own.withColumn("nth", nth), ["file", "name"], "left")


def resolve_nodes(modified: DataFrame, nodes: DataFrame) -> DataFrame:
    """By file and qualified name, else file and bare name, else a node whose path ends in the file; the least of several.

    A node is found by the base name of its file together with either of its names, so files that
    share a base name meet only where they share a function's name too.
    """
    m = modified.withColumns({"__base": F.substring_index("file", "/", -1), "__name": F.col("name")})
    names = F.array_distinct(F.array("qualified", "bare"))
    n = nodes.select(F.col("file").alias("node_file"), "qualified", F.substring_index("file", "/", -1).alias("__base"), F.explode(names).alias("__name"))
    tail = F.col("node_file").endswith(F.concat(F.lit("/"), F.col("file"))) | (F.col("node_file") == F.col("file"))
    rank = F.when((F.col("node_file") == F.col("file")) & (F.col("qualified") == F.col("name")), 1).when(F.col("node_file") == F.col("file"), 2).otherwise(3)
    found = m.join(n, ["__base", "__name"]).where(tail).select("name", "file", rank.alias("rank"), "node_file", "qualified")
    best = found.groupBy("name", "file").agg(F.min(F.struct("rank", "node_file", "qualified")).alias("b"))
    return modified.join(best, ["name", "file"], "left").select("name", "file", "b.rank", "b.node_file", "b.qualified")


def neighbours(modified: DataFrame, edges: DataFrame) -> DataFrame:
    """Direction (caller or callee), function and the node on the other side."""
    m = modified.select(node(F.col("file"), F.col("name")).alias("node"))
    up = edges.join(m, edges["callee"] == m["node"]).select("node", F.lit("caller").alias("direction"), F.col("caller").alias("other"), "site_line", "is_virtual")
    down = edges.join(m, edges["caller"] == m["node"]).select("node", F.lit("callee").alias("direction"), F.col("callee").alias("other"), "site_line", "is_virtual")
    return up.unionByName(down)


def caller_counts(modified: DataFrame, edges: DataFrame) -> DataFrame:
    """By modified function distinct direct callers and distinct tests among them."""
    callers = neighbours(modified, edges).where("direction = 'caller'")
    name = F.substring_index("other", ":", -1)
    n = callers.groupBy("node").agg(F.count_distinct("other").alias("callers"), F.count_distinct(F.when(is_test_function(name, "go"), F.col("other"))).alias("tests"))
    m = modified.select(node(F.col("file"), F.col("name")).alias("node")).distinct()
    return m.join(n, "node", "left").fillna(0, ["callers", "tests"])


def uncovered(counts: DataFrame) -> DataFrame:
    """F14."""
    return counts.where("tests = 0")


def high_impact(counts: DataFrame, least: int = 3) -> DataFrame:
    """F15."""
    return counts.where(F.col("callers") >= least)


def orphans(modified: DataFrame, edges: DataFrame) -> DataFrame:
    """modified functions without callers."""
    m = modified.select(node(F.col("file"), F.col("name")).alias("node")).distinct()
    return m.join(edges, F.col("node") == F.col("callee"), "left_anti")


def impacted(modified: DataFrame, edges: DataFrame) -> DataFrame:
    """modified functions with callers."""
    m = modified.select(node(F.col("file"), F.col("name")).alias("node")).distinct()
    return m.join(edges, F.col("node") == F.col("callee"), "left_semi")


def top_callers(edges: DataFrame, shown: int = SHOWN_CALLERS) -> DataFrame:
    """The first callers of each function and how many more there are. Only shown rows of a function are gathered."""
    distinct = edges.select("callee", "caller").distinct()
    w = Window.partitionBy("callee")
    ranked = distinct.withColumns({"rn": F.row_number().over(w.orderBy("caller")), "n": F.count(F.lit(1)).over(w)})
    first = ranked.where(F.col("rn") <= shown).groupBy("callee", "n").agg(F.array_sort(F.collect_list("caller")).alias("callers"))
    return first.select("callee", F.array_join("callers", ",").alias("callers"), F.greatest(F.col("n") - shown, F.lit(0)).cast("long").alias("more"))


def first_modified(modified: DataFrame, most: int = 500) -> DataFrame:
    """The first functions by file and name, a bound of the report."""
    return modified.orderBy("file", "name").limit(most)


def reverse(edges: DataFrame) -> DataFrame:
    """Callee to its callers."""
    return edges.groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def index(nodes: DataFrame) -> DataFrame:
    """Keys by which a node is found: file and qualified name, file and bare name."""
    keys = F.array_distinct(F.array(node(F.col("file"), F.col("qualified")), node(F.col("file"), F.col("bare"))))
    return nodes.select(F.explode(keys).alias("key"), "file", "qualified").distinct()


def reachable(edges: DataFrame, start: DataFrame, depth: int = MAX_DEPTH, most: int | None = MAX_REACHED) -> DataFrame:
    """Nodes that reach a start node over calls, with their least distance; start nodes excluded.

    Breadth-first over incoming edges. A round joins the frontier and drops what was visited; its
    result is written to the shared folder, so lineage stays short. The search stops at most nodes:
    of the level that would go beyond, the first ones by name are taken, and every row's partial
    says so. With None for most it goes on to the depth.
    """
    from tidemark.sources.store import stored

    links = stored(edges.select("caller", "callee").distinct(), "links")
    frontier = stored(start.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited, n, partial = frontier, 0, False
    for d in range(1, depth + 1):
        step = links.join(frontier.select(F.col("node").alias("callee")), "callee").select(F.col("caller").alias("node")).distinct()
        frontier = stored(step.join(visited, "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        new = frontier.count()
        if not new:
            break
        if most is not None and n + new > most:
            visited, partial = visited.unionByName(frontier.orderBy("node").limit(most - n)), True
            break
        visited, n = visited.unionByName(frontier), n + new
    return visited.where("depth > 0").withColumn("partial", F.lit(partial))


def interface_edges(sites: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """A call of an interface's method reaches the method of every type that implements it. Types come to their methods before they come to the sites, so what many sites call is shuffled once."""
    reached = implements.join(sites.select("interface").distinct(), "interface", "left_semi").join(methods, "type")
    return reached.join(sites, ["interface", "method"]).select("caller", node(F.col("file"), F.concat("type", F.lit("."), "method")).alias("callee"), F.lit(True).alias("is_virtual"))


def shown_name(name: Column, parent: Column, receiver: Column) -> Column:
    """Receiver and name; a closure (no name, func and digits, or $ and digits at the end) is shown under the function that holds it."""
    plain = F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat(receiver, F.lit("."), name))
    closure = (name == "") | name.rlike(r"^func[0-9]+$") | name.rlike(r"\$[0-9]+$")
    return F.when(parent.isNotNull() & closure, F.concat(parent, F.lit(".<closure:"), name, F.lit(">"))).otherwise(plain)


def requested(functions: DataFrame, names: list[str]) -> DataFrame:
    """By name or base name."""
    return functions.where(F.col("name").isin(names) | base_symbol(F.col("name")).isin(names))


def importers(modules: DataFrame, files: DataFrame) -> DataFrame:
    """Who imports a file, by path suffix. A resolved path is listed under each of its suffixes, as many as it has segments, which makes it an equi-join on whole paths."""
    parts = F.split("resolved", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    listed = modules.select("source", "resolved").distinct().select("source", F.explode(F.array_distinct(F.concat(F.array("resolved"), tails))).alias("file"))
    return files.select("file").distinct().join(listed, "file").select("file", "source").distinct()


def zip_arguments(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Caller, callee, position, parameter and argument of each call to a known function, as far as both lists go. calls: caller, callee, arguments; functions: callee, parameters."""
    both = calls.join(functions, "callee")
    n = F.least(F.size("parameters"), F.size("arguments"))
    pairs = F.arrays_zip(F.slice("parameters", 1, n).alias("parameter"), F.slice("arguments", 1, n).alias("argument"))
    return both.select("caller", "callee", F.posexplode(pairs).alias("position", "z")).select("caller", "callee", "position", F.col("z.parameter"), F.col("z.argument"))


def virtual_summary(edges: DataFrame) -> DataFrame:
    """How many edges are virtual, and the one warning about them, null if there are none."""
    n = F.count_if("is_virtual")
    text = F.concat(n.cast("string"), F.lit(" call edge(s) resolved through interfaces; targets are possible, not certain"))
    return edges.agg(n.alias("n_virtual"), F.count(F.lit(1)).alias("n"), F.when(n > 0, text).alias("warning"))


def top_callees(edges: DataFrame, shown: int = SHOWN_CALLEES) -> DataFrame:
    """The first callees of each function and how many more there are."""
    turned = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return top_callers(turned, shown).select(F.col("callee").alias("caller"), F.col("callers").alias("callees"), "more")


def affected_packages(nodes: DataFrame, order: str = "ord", path: str = "file") -> DataFrame:
    """Distinct directories with the place where each came first."""
    from tidemark.operators.paths import dir_name, first_seen

    return first_seen(nodes.withColumn("package", dir_name(F.col(path))), "package", order)


def test_coverage(modified: DataFrame, edges: DataFrame, language: str = "go") -> DataFrame:
    """Tests that call each modified function directly, one row each."""
    callers = neighbours(modified, edges).where("direction = 'caller'")
    return callers.where(is_test_function(F.substring_index("other", ":", -1), language)).select("node", F.col("other").alias("test")).distinct()


def call_graph(modified: DataFrame, edges: DataFrame, language: str = "go", most: int = 500) -> dict[str, DataFrame]:
    """Functions (direct callers, callees, tests, impact), neighbours, coverage, packages and totals of the first modified functions. No modified function gives empty tables and zero totals."""
    m = first_modified(modified, most)
    near = neighbours(m, edges)
    counts = caller_counts(m, edges).withColumn("impact", impact_level(F.col("callers")))
    callees = near.where("direction = 'callee'").groupBy("node").agg(F.count_distinct("other").alias("callees"))
    functions = counts.join(callees, "node", "left").fillna(0, ["callees"])
    packages = affected_packages(near.where("direction = 'caller'").select(F.substring_index("other", ":", 1).alias("file"), F.xxhash64("other").alias("ord")))
    totals = functions.agg(F.count(F.lit(1)).alias("n_functions"), F.coalesce(F.sum("callers"), F.lit(0)).alias("direct_callers"), F.coalesce(F.sum("tests"), F.lit(0)).alias("affected_tests"))
    return {"functions": functions, "neighbours": near, "coverage": test_coverage(m, edges, language), "packages": packages, "totals": totals}


def script_call_graph(sites: DataFrame, functions: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A Python or TypeScript call graph: call sites with the functions that they resolve to, and the callers of each, for the requested names or all."""
    wanted = functions if not names else requested(functions, names)
    found = resolve(sites, functions)
    own = wanted.select(F.col("name").alias("callee"), F.col("file").alias("callee_file")).distinct()
    called = found.join(own, ["callee", "callee_file"], "left_semi")
    n = called.groupBy("callee", "callee_file").agg(F.count(F.lit(1)).alias("n_sites"), F.count_distinct("file", "caller").alias("n_callers"))
    return own.join(n, ["callee", "callee_file"], "left").fillna(0, ["n_sites", "n_callers"])
