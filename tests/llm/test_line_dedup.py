import random
import time

from tidemark.llm import line_dedup as ld


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_ratio_within_host(spark):
    rows = [(i, "http://A.example/x?q", f"<p>menu</p><div>own {i}</div><!-- <p>no</p> --><script>var a='</p>';</script>menu", "x") for i in range(4)]
    rows += [(9, "http://b.example", "<p>menu</p>  two\t words <br/>", "x"), (10, None, None, None), (10, None, None, None), (11, "http://c.example/", "", None)]
    got = {r.page_id: r for r in ld.line_dedup(pages(spark, rows)).collect()}
    assert got[0]["__host"] == "a.example" and got[0]["__lines"] == ["menu", "own 0", "menu"] and got[0]["__kept"] == ["own 0"]
    assert got[9]["__lines"] == ["menu", "two words"] and got[9]["__kept"] == []  # a host of one page
    some = {r.page_id: r["__kept"] for r in ld.line_dedup(pages(spark, rows), min_pages=2).collect()}
    assert some[9] == ["menu", "two words"] and some[0] == ["own 0"]
    assert got[10]["__kept"] == [] and got[10]["__host"] == "" and got[11]["__kept"] == []
    assert ld.line_dedup(pages(spark, rows)).count() == len(rows)
    assert ld.line_dedup(pages(spark, [])).count() == 0


def test_ratio_is_exceeded_not_met(spark):
    rows = [(i, "http://h/", "<p>x</p>" if i < 3 else "<p>y</p>" if i < 7 else "", None) for i in range(10)]
    got = {r.page_id: r["__kept"] for r in ld.line_dedup(pages(spark, rows)).collect()}
    assert got[0] == ["x"] and got[3] == []


def brute(rows, percent=30):
    """Kept lines by page, from lines already cut."""
    total, held = {}, {}
    for host, lines in rows:
        total[host] = total.get(host, 0) + 1
        for x in set(lines):
            held[host, x] = held.get((host, x), 0) + 1
    return [[x for x in lines if held[host, x] * 100 <= total[host] * percent] for host, lines in rows]


def test_equals_brute_force(spark):
    r = random.Random(6)
    rows = [(f"h{int(r.random() ** 3 * 8)}", [f"line {int(r.random() ** 2 * 30)}" for _ in range(r.randrange(6))]) for _ in range(120)]
    given = [(i, f"http://{h}/{i}", "".join(f"<p>{x}</p>" for x in lines), "") for i, (h, lines) in enumerate(rows)]
    got = {x.page_id: x["__kept"] for x in ld.line_dedup(pages(spark, given)).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)


def test_unclosed_markup_takes_linear_time(spark):
    n = 200_000
    rows = [(i, "http://h/", t * n, None) for i, t in enumerate(("<script", "<script>", "<!--", "<!-- x -", "<", "<p ", "<style>a", "</p", "x<p>"))]
    rows += [(20 + i, "http://h/", t, None) for i, t in enumerate(("a<script>b", "a<!-- b", "a<p", "1 < 2 <p>b"))]
    began = time.perf_counter()
    got = {x.page_id: x["__lines"] for x in ld.line_dedup(pages(spark, rows)).collect()}
    assert time.perf_counter() - began < 60
    assert got[1] == got[2] == [] and got[20] == ["a"] and got[21] == ["a"] and got[22] == ["a<p"] and got[23] == ["1 < 2", "b"]


def test_lines_are_cut_once_before_the_count(spark):
    rows = pages(spark, [(1, "http://h/", "<p>x</p>", None)])
    cut = rows.withColumn("__host", ld.host(rows.url)).withColumn("__lines", ld.visible_lines(rows.html))
    plan = ld.boilerplate(cut, "__host", "__lines")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<script") == 1
