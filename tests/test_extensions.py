"""Analyzers called from SQL."""

import pytest
from pyspark.errors import PySparkException

from tidemark.plans.registry import importable
from tidemark.sources import extensions


def todo(file, lines, texts):
    for n, t in zip(lines, texts, strict=True):
        if "TODO" in t:
            yield file, n, len(texts)


def test_third_party_analyzer(spark, monkeypatch):
    monkeypatch.setattr(extensions, "ANALYZERS", dict(extensions.ANALYZERS))
    extensions.register("todo", "file string, line int, of int", todo)
    extensions.install(importable(spark))
    spark.createDataFrame([("a", 2, "x // TODO", 0), ("a", 1, "y", 0), ("b", 1, None, 0), ("b", 2, "TODO", 0)], "file string, line int, text string, other int").createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT * FROM analyze_lines(TABLE(some_lines) PARTITION BY file ORDER BY (line), 'todo')")
    assert got.columns == ["file", "line", "of"] and sorted(map(tuple, got.collect())) == [("a", 2, 2), ("b", 2, 2)]
    none = spark.sql("SELECT * FROM analyze_lines(TABLE(SELECT * FROM some_lines WHERE line > 9) PARTITION BY file ORDER BY (line), 'todo')")
    assert none.collect() == []


def test_wrong_calls(spark):
    extensions.install(importable(spark))
    spark.createDataFrame([("a", 1)], "file string, line int").createOrReplaceTempView("no_text")
    for text in ("analyze_lines(TABLE(no_text) PARTITION BY file ORDER BY (line), 'go-nil-sources')", "analyze_lines(TABLE(SELECT 'a' AS file, 1 AS line, 'x' AS text) PARTITION BY file ORDER BY (line), 'nope')"):
        with pytest.raises(PySparkException, match="needs the columns|unknown analyzer"):
            spark.sql(f"SELECT * FROM {text}").collect()


def test_parsers_from_sql(spark):
    extensions.install(importable(spark))
    rows = spark.sql("SELECT s.name FROM VALUES ('python', 'def f(x):\\n    return x\\n') AS t(l, c), LATERAL symbols_of(t.l, t.c) AS s").collect()
    assert [r.name for r in rows] == ["f"]
    rows = spark.sql("SELECT s.* FROM VALUES (concat('M', chr(0), 'a', chr(0))) AS t(c), LATERAL name_status(t.c) AS s").collect()
    assert [(r.path, r.status) for r in rows] == [("a", "M")]
