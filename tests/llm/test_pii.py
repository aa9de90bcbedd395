import hashlib
import random
import re
import time

from tidemark.llm import pii

SLOW = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def slow(text):
    out = [(k, m.start(), m.end()) for k, (p, ok) in SLOW.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(out, key=lambda x: (x[1], pii.BASE.index(x[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(11)
    cases = ["", "a@b.c@d.e", "a@b@c.d", "x@y..z.w", "1.2.3.4.5.6.7.8.9", "256.1.1.1.2.3.4.5", "001.02.3.4", "4041894974608795", "+1 (988) 555-2485 (", "é+123456789012", "a@-.-", "@@a@b.c"]
    for _ in range(20000):
        abc = r.choice(["a@.-b", "0123.", "0 1-2", "+1()- .2", "a@.1+ -é%_"])
        cases.append("".join(r.choice(abc) for _ in range(r.randrange(1, 40))))
    for _ in range(300):
        cases.append(f"x {r.randrange(10**13, 10**19)} y")
    for t in cases:
        assert [s[:3] for s in pii.spans(t) if s[4]] == slow(t), t


def test_method_adds_spans():
    kinds = lambda t: [s[0] for s in pii.spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33 ok") == []
    assert kinds("his social security number 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    assert kinds("call 555-123-4567 now") == ["local_phone"]
    assert kinds("lot 555-123-4567 now") == []


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "@" * 300_000, "AB12" * 70_000):
        pii.spans(t)


def test_nulls_and_columns(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "é m.1@x.y ü", 0), (3, "é m.1@x.y ü", 0)], "doc_id long, text string, spans int")
    rows = pii.find_pii(d).orderBy("doc_id").collect()
    assert [len(r.spans) for r in rows] == [0, 0, 1, 1]
    assert rows[2].spans[0][:3] == ("email", 2, 9)
    assert pii.find_pii(d.limit(0)).count() == 0


def test_query_digests_the_base_spans(spark, tmp_path):
    texts = [None, "call +1 (988) 555-2485 or x.1@mail8.example.com", "IBAN GB82 WEST 1234 5698 7654 32 at 10.0.0.1", "4041894974608795"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.query(spark, str(tmp_path)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = slow(t or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert got[2].spans == "iban:5:32,ip:36:44"


def test_many_spans_of_both_kinds_take_linear_time():
    """An added span goes where a base span overlaps it, however many there are."""
    t = "call 555-123-4567 or a@b.com now; " * 40_000
    began = time.perf_counter()
    got = pii.spans(t)
    assert len(got) == 80_000 and time.perf_counter() - began < 60
    r = random.Random(2)
    for _ in range(200):
        x = [(lo, lo + r.randrange(1, 9)) for lo in (r.randrange(60) for _ in range(r.randrange(8)))]
        m = pii._merged(sorted(x))
        assert {i for lo, hi in m for i in range(lo, hi)} == {i for lo, hi in x for i in range(lo, hi)}
        assert all(a[1] <= b[0] for a, b in zip(m, m[1:]))  # noqa: B905
    assert [s[0] for s in pii.spans("tel +1 555-123-4567 and call 555-123-4567")] == ["phone", "local_phone"]
