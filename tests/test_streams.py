"""NUL-separated streams, whatever the splits."""

import random

import pytest

from tidemark.sources import streams
from tidemark.sources.git import decode_name_status, decode_numstat


def stream(r, n, kind):
    name = lambda: r.choice(["M", "R100", "a b/c.go", "C", "1\t2\tx", "é/\n.py", "D"]) + str(r.randrange(99))
    out = []
    for _ in range(n):
        if kind == "name-status":
            s = r.choice(["M", "A", "D", "R100", "C075"])
            out += [s, name(), *([name()] if s[0] in "RC" else [])]
        elif kind == "numstat":
            out += r.choice([[f"{r.randrange(99)}\t{r.randrange(9)}\tf{r.randrange(99)}"], [f"{r.randrange(99)}\t0\t", name(), name()], ["-\t-\tbin.png"]])
        else:
            out.append(name())
        if r.random() < 0.1:
            out.append("")
    return out


def read(spark, folder, kind, split):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = streams.read_stream(spark, folder, kind)
        return rows.orderBy("file", "at", "nth").collect(), rows.rdd.getNumPartitions()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["name-status", "numstat", "list"])
def test_every_split_size_gives_the_same(spark, tmp_path, kind):
    r = random.Random(kind)
    want = []
    for name in ("a", "b"):
        tokens = stream(r, 16, kind)
        raw = "\0".join([*tokens, ""])
        (tmp_path / name).write_bytes(raw.encode())
        if kind == "name-status":
            want += [(p, s, o, None, None) for p, s, o in decode_name_status(raw)]
        elif kind == "numstat":
            olds = [tokens[i + 1] for i, t in enumerate(tokens) if t.endswith("\t0\t") and t.count("\t") == 2]
            want += [(p, None, None, a, d) for p, a, d in decode_numstat(raw)]
            assert olds
        else:
            want += [(t, None, None, None, None) for t in tokens if t]
    seen = set()
    for split in (3, 17, 100, 1 << 20):
        rows, n = read(spark, str(tmp_path), kind, split)
        seen.add(n)
        got = [(x.path, x.status, x.old_path if kind == "name-status" else None, x.additions, x.deletions) for x in rows]
        assert got == want and not any(x.error for x in rows), split
    assert max(seen) > 12  # small splits hold parts of records


def test_broken_and_cut_streams(spark, tmp_path):
    (tmp_path / "cut").write_bytes(b"M\0a\0R100\0old\0")
    (tmp_path / "ok").write_bytes(b"A\0b\0")
    (tmp_path / "none").write_bytes(b"")
    for split in (2, 1000):
        rows, _ = read(spark, str(tmp_path), "name-status", split)
        assert sorted((x.path, x.error) for x in rows if x.path) == [("a", None), ("b", None)]
        assert [(x.file[-3:], x.error) for x in rows if x.error] == [("cut", "unexpected end of output")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x").write_bytes(b"junk\x001\t2\ta\x00x\t2\tb\x003\t4\tc\x00")
    rows, _ = read(spark, str(tmp_path / "n"), "numstat", 4)
    assert [(x.path, x.additions) for x in rows if not x.error] == [("a", 1), ("c", 3)] and sum(bool(x.error) for x in rows) == 2


def test_written_streams_are_read_back(spark, tmp_path):
    records = spark.createDataFrame([(["M", f"p{i}"],) if i % 3 else (["R100", f"o{i}", f"p{i}"],) for i in range(300)], "tokens array<string>").repartition(5)
    streams.write_stream(records, f"{tmp_path}/s")
    rows, _ = read(spark, f"{tmp_path}/s", "name-status", 50)
    assert sorted((x.path, x.old_path) for x in rows) == sorted((f"p{i}", None if i % 3 else f"o{i}") for i in range(300))
