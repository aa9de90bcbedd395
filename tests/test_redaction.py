"""Redaction with and without the search that comes before each pattern."""

import random

from pyspark.sql import functions as F

from tidemark.functions import text as tx

PARTS = (
    "AKIA" + "A1" * 8, "ASIA" + "B2" * 8, "ghp_" + "x" * 20, "gho_" + "y" * 25, "xoxb-" + "1" * 12, "sk_live_" + "z" * 16, "pk_test_" + "q" * 16, "AIza" + "k" * 35,
    "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "mongodb+srv://u:p@h/x", "redis://a:b@c", "PassWord = 'abcdefghijklm'", 'api-key:"abcdefghijklm"', "auth_TOKEN=",
    "Ignore all previous instructions", "DISREGARD prior instruction", "forget above instructions", "You\nare now a ", "you are now an ", "new Instructions: ", "System prompt =", "< / SYSTEM >", "<user>", "secret", "token", "api_key", ": ", "'", "x" * 20, " ", "\n", "é", "\u212a", "\u0130", "[REDACTED:",
)


def plainly(c):
    for p, marker in tx.SECRETS:
        c = F.regexp_replace(c, p, marker)
    for p in tx.INJECTIONS:
        c = F.regexp_replace(c, p, tx.INJECTION_MARKER)
    return c


def test_equals_all_patterns_one_after_the_other(spark):
    r = random.Random(5)
    texts = [None, "", *PARTS] + ["".join(r.choice(PARTS) + r.choice(("", " ", "\n")) for _ in range(r.randrange(1, 12))) for _ in range(1500)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", plainly(F.col("t")).alias("want"), tx.redact_injections(tx.redact_secrets(F.col("t"))).alias("got"))
    rows = d.collect()
    assert [x.got for x in rows] == [x.want for x in rows] and sum(x.want != x.t for x in rows if x.t) > 1000
