"""Documents written in parallel and put in place at once."""

import json
import os
import stat

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.plans.registry import importable
from tidemark.sources import documents as dc


def elements(spark, n, parts):
    importable(spark)
    made = F.to_json(F.struct("id", F.lit("é\n").alias("t"), F.expr("array(named_struct('x', id))").alias("l"), F.expr("cast(array() as array<int>)").alias("none")))
    return spark.range(n, numPartitions=parts).select(F.when(F.col("id") % 3 == 0, "a.json").otherwise("b-1.json").alias("name"), made.alias("value"), F.col("id").alias("ord"))


def held(path):
    return sorted(os.listdir(path))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_lists(spark, tmp_path, parts):
    path = f"{tmp_path}/new/out"
    dc.write_documents(elements(spark, 50, parts), path)
    assert held(path) == ["a.json", "b-1.json"]
    for name, mine in (("a.json", lambda i: i % 3 == 0), ("b-1.json", lambda i: i % 3 > 0)):
        want = [{"id": i, "t": "é\n", "l": [{"x": i}], "none": []} for i in range(50) if mine(i)]
        with open(f"{path}/{name}", encoding="utf-8") as f:
            assert f.read() == json.dumps(want, indent=2, ensure_ascii=False) + "\n"
        assert stat.S_IMODE(os.stat(f"{path}/{name}").st_mode) == 0o600


def test_interleaved_names_and_no_rows(spark, tmp_path):
    importable(spark)
    dc.register(spark)
    elements(spark, 20, 2).select("name", "value").write.format("json_documents").mode("append").save(f"{tmp_path}/o")
    assert [x["id"] for x in json.load(open(f"{tmp_path}/o/a.json"))] == list(range(0, 20, 3))
    elements(spark, 0, 1).select("name", "value").write.format("json_documents").mode("append").save(f"{tmp_path}/o")
    assert held(f"{tmp_path}/o") == ["a.json", "b-1.json"]


def test_members(spark, tmp_path):
    importable(spark)
    rows = [("d.json", "sum", '{"n": 2, "of": {"k": [1]}}', 0), ("d.json", "items", "2", 1), ("d.json", "items", '"x"', 0), ("d.json", "other", "null", 0)]
    dc.write_documents(spark.createDataFrame(rows, "name string, member string, value string, ord long"), str(tmp_path), members="items,sum", single="sum")
    with open(f"{tmp_path}/d.json") as f:
        assert f.read() == json.dumps({"items": ["x", 2], "sum": {"n": 2, "of": {"k": [1]}}, "other": [None]}, indent=2) + "\n"


@pytest.mark.parametrize("bad", ["{broken", None])
def test_nothing_is_left_if_a_task_fails(spark, tmp_path, bad):
    path = f"{tmp_path}/o"
    dc.write_documents(elements(spark, 9, 1), path)
    before = open(f"{path}/a.json").read()
    broken = elements(spark, 60, 4).withColumn("value", F.when(F.col("ord") == 59, F.lit(bad)).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        dc.write_documents(broken, path, overwrite=True)
    assert held(path) == ["a.json", "b-1.json"] and open(f"{path}/a.json").read() == before


def test_refusals(spark, tmp_path):
    path = f"{tmp_path}/o"
    dc.write_documents(elements(spark, 9, 2), path)
    before = open(f"{path}/a.json").read()
    with pytest.raises(PySparkException, match="a.json"):
        dc.write_documents(elements(spark, 12, 2), path)
    with pytest.raises(PySparkException, match="more than 100"):
        dc.write_documents(elements(spark, 12, 2), path, overwrite=True, most="100")
    assert open(f"{path}/a.json").read() == before
    dc.write_documents(elements(spark, 12, 2), path, overwrite=True)
    assert len(json.load(open(f"{path}/a.json"))) == 4
    os.rename(f"{path}/a.json", f"{tmp_path}/kept.json")
    os.symlink(f"{tmp_path}/kept.json", f"{path}/a.json")
    with pytest.raises(PySparkException, match="symlink"):
        dc.write_documents(elements(spark, 3, 1), path, overwrite=True)
    assert len(json.load(open(f"{tmp_path}/kept.json"))) == 4 and held(path) == ["a.json", "b-1.json"]
    for name in ("../x.json", "", ".hidden", None):
        with pytest.raises(PySparkException, match="invalid document name"):
            dc.write_documents(elements(spark, 1, 1).withColumn("name", F.lit(name).cast("string")), path, overwrite=True)


def test_symbol_and_finding_documents(spark, tmp_path):
    importable(spark)
    dc.write_symbol_documents(spark.createDataFrame([("go", '{"f": 1}', 0), ("python", '{"f": 2}', 1), ("go", '{"f": 3}', 2)], "language string, document string, ord long"), f"{tmp_path}/ast")
    assert {n: [x["f"] for x in json.load(open(f"{tmp_path}/ast/{n}"))] for n in held(f"{tmp_path}/ast")} == {"mixed-ast.json": [1, 2, 3], "go-ast.json": [1, 3], "python-ast.json": [2]}
    findings = spark.createDataFrame([("go", 0, "high", "f"), ("go", 1, "odd", "g"), ("python", 2, "info", "h")], "language string, ord long, severity string, file string")
    errors = spark.createDataFrame([("typescript", 0, 'a "b"')], "language string, ord long, error string")
    versions = spark.createDataFrame([("go", "gosec", "2.1"), ("python", "ruff", "3"), ("rust", "clippy", "1")], "language string, tool string, version string")
    dc.write_finding_documents(findings, errors, versions, f"{tmp_path}/lint")
    got = {n: json.load(open(f"{tmp_path}/lint/{n}")) for n in held(f"{tmp_path}/lint")}
    none = {"critical": 0, "high": 0, "warning": 0, "info": 0, "unknown": 0}
    assert got["go-lint.json"] == {"tool_versions": {"gosec": "2.1"}, "findings": [{"severity": "high", "file": "f"}, {"severity": "odd", "file": "g"}], "summary": none | {"high": 1, "unknown": 1}}
    assert got["typescript-lint.json"] == {"tool_versions": {}, "findings": [], "summary": none, "errors": ['a "b"']}
    assert got["rust-lint.json"] == {"tool_versions": {"clippy": "1"}, "findings": [], "summary": none}
    every = [{"severity": s, "file": f} for s, f in (("high", "f"), ("odd", "g"), ("info", "h"))]
    assert got["static-analysis.json"] == {"tool_versions": {"clippy": "1", "gosec": "2.1", "ruff": "3"}, "findings": every, "summary": none | {"high": 1, "unknown": 1, "info": 1}, "errors": ['a "b"']}
    dc.write_finding_documents(findings.limit(0), errors.limit(0), versions.limit(0), f"{tmp_path}/nothing")
    assert json.load(open(f"{tmp_path}/nothing/static-analysis.json")) == {"tool_versions": {}, "findings": [], "summary": none}


def test_a_large_document_is_parts(spark, tmp_path):
    """One over the limit is written as documents of the same shape that hold all its elements in order."""
    from tidemark.sources import documents as dc

    rows = spark.range(400).selectExpr("'a.json' AS name", "'xs' AS member", "cast(id AS string) AS value", "id AS ord").unionByName(spark.createDataFrame([("a.json", "one", "{}", 0)], "name string, member string, value string, ord long"))
    dc.write_documents(rows, str(tmp_path), most="1000", parts="true", single="one", members="one,xs")
    names = sorted(f.name for f in tmp_path.iterdir())
    held = [json.loads((tmp_path / n).read_text()) for n in names]
    assert len(names) > 2 and names[0] == "a.part-00000.json" and [i for i, h in enumerate(held) if "one" in h] == [0]
    assert [x for h in held for x in h.get("xs", [])] == list(range(400))
    dc.write_documents(rows, str(tmp_path), overwrite=True, single="one", members="one,xs")
    assert [f.name for f in tmp_path.iterdir()] == ["a.json"]
