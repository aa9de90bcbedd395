"""Method sets and implemented interfaces against a lookup per type and name."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hierarchy as hi

FIELDS = "type string, name string, target string, pointer boolean"
METHODS = "type string, method string, signature string, pointer boolean, file string"


def lookup(root, name, embeds, declared):
    """(is method, signature, holder, needs a pointer) of a name, or None; breadth first, as a compiler looks it up."""
    level, seen = [(root, False, False)], set()
    while level:
        found, after = [], {}
        for at, indirect, many in level:
            if at in seen:
                continue
            for d in declared.get((at, name), []):
                found += [(*d, at, indirect)] * (2 if many else 1)
            for target, pointer in embeds.get(at, []):
                n, ind, m = after.get(target, (0, False, False))
                after[target] = (n + 1, ind or indirect or pointer, m or many)
        if found:
            if len(found) > 1 or not found[0][0]:
                return None
            _, signature, receiver, holder, indirect = found[0]
            return signature, holder, not receiver or indirect
        seen |= {at for at, *_ in level}
        level = [(t, ind, m or n > 1) for t, (n, ind, m) in after.items()]
    return None


@pytest.mark.parametrize("seed", range(3))
def test_as_looked_up(spark, seed):
    r = random.Random(seed)
    types, interfaces, names = [f"T{i}" for i in range(25)], [f"I{i}" for i in range(8)], [f"M{i}" for i in range(6)]
    extends = [(i, r.choice(interfaces)) for i in interfaces for _ in range(r.randrange(2))]  # cycles, and of themselves
    abstract = sorted({(i, r.choice(names), "s" if i != "I7" else "t") for i in interfaces for _ in range(r.randrange(4))})
    fields, methods, used = [], [], set()
    for t in types:
        for _ in range(r.randrange(4)):
            target = r.choice(types + interfaces)
            fields.append((t, target, target, r.random() < 0.5 and target[0] == "T"))
        for n in names:
            x = r.random()
            if x < 0.2:
                methods.append((t, n, r.choice("st"), r.random() < 0.5, "f.go"))
            elif x < 0.27:
                fields.append((t, n, None, False))
    fields = [f for f in fields if not ((f[0], f[1]) in used or used.add((f[0], f[1])))]
    reach = {i: {i} for i in interfaces}
    for _ in interfaces:
        for a, b in extends:
            reach[a] |= reach[b]
    required = {i: {(n, s) for j, n, s in abstract if j in reach[i]} for i in interfaces}
    declared, embeds = {}, {}
    for t, n, s, p, _ in methods:
        declared.setdefault((t, n), []).append((True, s, p))
    for i in interfaces:
        for n, s in required[i]:
            declared.setdefault((i, n), []).append((True, s, False))
    for t, n, target, p in fields:
        declared.setdefault((t, n), []).append((False, None, False))
        if target:
            embeds.setdefault(t, []).append((target, p))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    need = hi.interface_methods(df(extends, "type string, target string"), df(abstract, "type string, method string, signature string"))
    assert {(x.interface, x.method, x.signature) for x in need.collect()} == {(i, n, s) for i in interfaces for n, s in required[i]}
    sets = hi.method_sets(df([(t,) for t in types], "type string"), df(fields, FIELDS), df(methods, METHODS), need)
    want = {(t, n, *found) for t in types for n in names if (found := lookup(t, n, embeds, declared))}
    got = sets.collect()
    assert {(x.type, x.method, x.signature, x.holder, x.of_value) for x in got} == want and len(got) == len(want)
    has = {(t, pointer): {(n, s) for u, n, s, _, v in want if u == t and (v or pointer)} for t in types for pointer in (False, True)}
    pairs = {(t, i, required[i] <= has[t, False]) for t in types for i in interfaces if required[i] and required[i] <= has[t, True]}
    assert {tuple(x) for x in hi.implements(sets, need).collect()} == pairs


def test_shallowest_wins_ambiguity_and_pointers(spark):
    fields = [("Outer", "Mid", "Mid", False), ("Outer", "Other", "Other", True), ("Mid", "Deep", "Deep", False), ("Hides", "Deep", "Deep", False), ("Hides", "Close", None, False), ("Both", "Deep", "Deep", False), ("Both", "Twin", "Twin", False)]
    methods = [("Deep", "Close", "func()", False, "d.go"), ("Other", "Close", "func()", True, "o.go"), ("Twin", "Close", "func()", False, "t.go")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    need = hi.interface_methods(df([], "type string, target string"), df([("Closer", "Close", "func()")], "type string, method string, signature string"))
    types = df([(t,) for t in ("Outer", "Mid", "Deep", "Other", "Hides", "Both", "Twin")], "type string")
    sets = hi.method_sets(types, df(fields, FIELDS), df(methods, METHODS), need)
    assert {(x.type, x.holder, x.of_value) for x in sets.collect()} == {("Outer", "Other", True), ("Mid", "Deep", True), ("Deep", "Deep", True), ("Other", "Other", False), ("Twin", "Twin", True)}
    edges = hi.dispatch(df([("main", "Closer", "Close")], "caller string, interface string, method string"), sets, hi.implements(sets, need))
    assert {x.callee for x in edges.collect()} == {"o.go:Outer.Close", "d.go:Mid.Close", "d.go:Deep.Close", "o.go:Other.Close", "t.go:Twin.Close"}


def test_method_ids(spark):
    rows = spark.createDataFrame([("Close", "p"), ("close", "p"), ("_x", "p"), ("Ärger", "p")], "name string, package string")
    assert [x[0] for x in rows.select(hi.method_id(F.col("name"), F.col("package"))).collect()] == ["Close", "p.close", "p._x", "Ärger"]


def test_stored_tables_are_deleted_with_their_scratch(spark):
    from tidemark.sources.store import scratch, stored

    with scratch(spark):
        kept = stored(spark.range(3), "x")
        assert kept.count() == 3
        path = kept.inputFiles()[0].removeprefix("file://")
    import os

    assert not os.path.exists(path)


def test_equal_interfaces_are_one(spark):
    """Interfaces of equal methods are held against types once; each is named, in blocks, where the result is made."""
    required = spark.range(2500).selectExpr("concat('I', id) AS interface", "explode(array('A', 'B')) AS method", "'f' AS signature")
    sets = spark.createDataFrame([("T", "A", "f", True), ("T", "B", "f", False), ("U", "A", "f", True), ("U", "B", "g", True)], "type string, method string, signature string, of_value boolean")
    got = hi.implements(sets, required)
    assert got.groupBy("type", "of_value").agg(F.count_distinct("interface").alias("n"), F.count("*").alias("m")).collect() == [("T", False, 2500, 2500)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(interfaces" in plan and plan.index("Generate") < plan.index("Join")


def test_what_meets_in_vain_is_not_written(spark, monkeypatch):
    """an interface's candidates were shuffled with each of its other methods, and types of equal methods were held against it one by one."""
    kept, write = {}, hi.stored
    monkeypatch.setattr(hi, "stored", lambda df, label: kept.setdefault(label, (df._jdf.queryExecution().optimizedPlan().toString(), write(df, label)))[1])
    names = [f"M{i}" for i in range(6)]
    pairs = [(a, b) for a in names for b in names if a < b]
    required = spark.createDataFrame([(f"I{a}{b}", m, "f") for a, b in pairs for m in (a, b)], "type string, method string, signature string").withColumnRenamed("type", "interface")
    of = {f"T{i}": {names[i % 6], names[(i + 1) % 6]} for i in range(120)}
    sets = spark.createDataFrame([(t, m, "f", int(t[1:]) % 12 < 6 or m != "M0") for t, ms in of.items() for m in ms] + [("T0", "other", "f", False)], "type string, method string, signature string, of_value boolean")
    got = {tuple(x) for x in hi.implements(sets, required).collect()}
    assert got == {(t, "I" + "".join(sorted(ms)), int(t[1:]) % 12 < 6 or "M0" not in ms) for t, ms in of.items()}
    plan, found = kept["implemented"]
    assert found.count() == 8, "six pairs of methods, two of them once more where only a pointer has M0"
    assert "Aggregate" not in plan[: plan.index("Join")]
