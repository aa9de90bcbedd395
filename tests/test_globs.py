"""Tables of patterns against one expression for each pattern."""

import random
import re

import pytest
from pyspark.errors import PySparkException

from tidemark.operators import globs
from tidemark.operators.paths import glob_regex

SEGMENTS = ["a", "b.go", "src", "m1.py", "x-y", "vendor", ".git", "[z]", "éa"]
GLOBS = ["*", "**", "a", "src", "*.go", "m?.py", "[a-c]*", "b.*", "x\\-y", "[^a]", "*-*", "m[0-9].py", "\\[z\\]", "é?", "***"]


@pytest.mark.parametrize("seed", range(2))
def test_as_expressions(spark, seed):
    r = random.Random(seed)
    paths = sorted({"/".join(r.choice(SEGMENTS) for _ in range(r.randrange(1, 5))) for _ in range(250)})
    patterns = sorted({"/".join(r.choice(GLOBS) for _ in range(r.randrange(1, 5))) for _ in range(25)} - {"**", "**/**", "**/*", "*/**", "**/**/*", "**/**/**"})[:14]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = spark.createDataFrame([(p, i) for i, p in enumerate([*paths, paths[0]])], "path string, node int")
    got = globs.matching(files, spark.createDataFrame([(p,) for p in ["./" + patterns[0], *patterns]], "pattern string"))
    skipped = re.compile(r"(^|/)(\.git|node_modules|vendor)/")
    want = sorted(p for p in [*paths, paths[0]] if not skipped.search(p) and any(re.search(glob_regex(q).replace("\\x{", "\\x{"), p) if "\\x{" not in glob_regex(q) else spark_like(spark, glob_regex(q), p) for q in patterns))
    assert sorted(x.path for x in got.collect()) == want and got.columns == ["path", "node"]


def spark_like(spark, expression, path):
    return bool(spark._jvm.java.util.regex.Pattern.compile(expression).matcher(path).find())


def test_bad_patterns_and_nothing(spark):
    files = spark.createDataFrame([("a/b.go",)], "path string")
    table = lambda *p: spark.createDataFrame([(x,) for x in p], "pattern string")
    for bad in ("", "/a", "a/../..", ".", "a/[", None):
        with pytest.raises(PySparkException):
            globs.matching(files, table("a/*", bad)).collect()
    assert globs.matching(files, table()).count() == 0 and globs.matching(files.limit(0), table("*")).count() == 0
    assert [x.path for x in globs.matching(files, table("**")).collect()] == ["a/b.go"]
