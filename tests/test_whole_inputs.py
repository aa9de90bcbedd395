"""Registered queries read their whole tables: results against brute force over small ones."""

from collections import defaultdict

import pytest

from tidemark import catalog
from tidemark.operators import calls

LINEITEM = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
PART = "p_partkey long, p_size int"


def written(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Seven lines to an order; some pairs of supplier and part, and some suppliers, occur on late lines only."""
    path = str(tmp_path_factory.mktemp("tables"))
    lines = [(o, n, o * 31 + n * 7, (o % 5 + 1) * 10 + n % 3 if n > 2 else o % 5 + 1) for o in range(40) for n in range(1, 8)]
    parts = [(k, k % 50) for k in range(1, 1500)]
    written(spark, path, lines, LINEITEM, "lineitem")
    written(spark, path, parts, PART, "part")
    return path, lines, parts


def edges(lines):
    role = lambda s: {0: "Test", 1: "helper"}.get(s % 10, "Run")
    return {(f"m{s % 40}.go:{role(s)}{s}", f"m{p % 40}.go:fn{p % 600}", n, p % 5 == 0) for _, n, p, s in lines}


def run(spark, name, path):
    return catalog.queries()[name](spark, path).collect()


def test_call_graph_has_the_calls_of_every_line(spark, tables):
    path, lines, _ = tables
    callers, callees = defaultdict(set), defaultdict(set)
    for caller, callee, *_ in edges(lines):
        callers[callee].add(caller)
        callees[caller].add(callee)
    assert {r.callee: r.callers for r in run(spark, "g02_reverse", path)} == {k: ",".join(sorted(v)) for k, v in callers.items()}
    assert {r.caller: r.callees for r in run(spark, "a16_collect_edges", path)} == {k: ",".join(sorted(v)) for k, v in callees.items()}
    assert {r.caller for r in run(spark, "f27_test_functions", path)} == set(callees)
    counts = {r.node: (r.callers, r.tests) for r in run(spark, "a05_direct_callers", path)}
    assert any(n for n, _ in counts.values())
    assert counts == {m: (len(callers[m]), sum(":Test" in c for c in callers[m])) for m in counts}
    assert {r.node for r in run(spark, "f18_orphans", path)} == {m for m in counts if not callers[m]}


def sites(lines):
    target = lambda p: (f"fn{p % 500}", f"K{p % 3}.fn{p % 500}", f"x.y.fn{p % 500}")[p % 3]
    return {(f"C{s % 7}.run{s}", f"s{s % 40}.py", target(p), n) for _, n, p, s in lines}


def test_call_sites_of_every_line_are_resolved_and_attached_in_order(spark, tables):
    path, lines, parts = tables
    first = {}
    for k, _ in parts:
        first.setdefault(f"fn{k % 400}", (f"K{k % 3}.fn{k % 400}" if k % 4 == 0 else f"fn{k % 400}", f"d{k % 30}.py"))
    expected = {(*s, *first[base]) for s in sites(lines) if (base := s[2].split(".")[-1]) in first}
    assert {tuple(r) for r in run(spark, "j13_resolve_calls", path)} == expected
    own = defaultdict(list)
    for caller, file, target, line in sites(lines):
        own[caller, file].append((line, target))
    assert min(min(v)[0] for v in own.values()) == 1 < max(min(v)[0] for v in own.values())
    got = defaultdict(list)
    for r in run(spark, "j14_attach_sites", path):
        got[r.name, r.file].append((r.nth, r.line, r.target))
    assert {k: sorted(v) for k, v in got.items() if k[0] != "none"} == {k: [(i, *x) for i, x in enumerate(sorted(v), 1)] for k, v in own.items()}
    assert got["none", "none.py"] == [(None, None, None)]


def test_reachability_has_no_cap_on_nodes(spark, tmp_path):
    lines = [(i, 1, 7, s) for i, s in enumerate([8, *range(301, 10400)])] + [(20000, 1, 8, 20000), (20001, 2, 8, 9), (20002, 1, 9, 20001)]
    written(spark, str(tmp_path), lines, LINEITEM, "lineitem")
    got = {r.node: r.depth for r in run(spark, "g01_reachable", str(tmp_path))}
    assert got == {str(s): 1 for s in [8, *range(301, 10400)]} | {"20000": 2, "9": 2, "20001": 3}


def test_a_cap_that_stops_the_search_is_told(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c")], "caller string, callee string")
    start = spark.createDataFrame([("a",)], "node string")
    found = lambda **k: {(r.node, r.depth, r.partial) for r in calls.reachable(edges, start, **k).collect()}
    assert found(most=2) == {("b", 1, True), ("c", 2, True)}
    assert found() == found(most=None) == found(most=3) == {("b", 1, False), ("c", 2, False), ("d", 3, False)}
    assert found(depth=2, most=2) == {("b", 1, False), ("c", 2, False)}


def test_functions_of_every_part_are_taken_as_modified(spark, tables):
    path, _, parts = tables
    expected = {f"m{k % 40}.go:fn{k % 700}" for k, _ in parts}
    assert {r.node for r in run(spark, "a05_direct_callers", path)} == expected


def test_scope_of_all_takes_every_change(spark):
    from tidemark import catalog

    folder = "/root/testdata/sf0.001"
    assert catalog.queries()["c18_scope_all"](spark, folder).count() == spark.read.parquet(f"{folder}/orders.parquet").count()
