"""Boilerplate lines by their frequency within a site.

The visible lines of a page are its text between block-level tags, without scripts, styles and
comments, white space collapsed. By host, the pages that hold a line are divided by all pages of
the host; a line above the ratio is dropped wherever it stands on that host. So all lines of a
host's only page go, as each is on all of its pages; min_pages asks for more pages with a line.

Native DataFrame operations throughout. A page counts a line once, counts are combined before
the shuffle, and a host's dropped lines are few by construction: each stands on more than ratio
of its pages, so they number at most the mean of lines per page divided by the ratio.

The join of pages with their host's lines is by host; adaptive execution splits a host that holds
a large share of all pages. A tag, script or comment that is never closed hides the rest of the
page or, without ">", stands as text, so very long pages take time in proportion to their length.
Null html has no lines, null or odd URLs belong to the host "". Rows that repeat a page count as
pages of their own. Extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._runtime import ready, stored, table

NAME = "op8_line_dedup"
RATIO_PERCENT = 30
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
HIDDEN = r"(?is)<script[^<>]*>.*?(?:</script[^<>]*>|\z)|<style[^<>]*>.*?(?:</style[^<>]*>|\z)|<!--.*?(?:-->|\z)"
BLOCKS = r"(?i)</?(p|div|li|ul|ol|nav|h[1-6]|br|tr|td|th|table|title|article|section|header|footer|head|body|html|blockquote|pre|main|aside)([ \t\r\n/][^<>]*)?>"
TAGS = r"<[^<>]*>"
SPACES = r"[ \t\r\f]+"


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def visible_lines(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), TAGS, "")
    lines = F.transform(F.split(F.regexp_replace(text, SPACES, " "), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def boilerplate(pages: DataFrame, host_col: str, lines_col: str, ratio_percent: int = RATIO_PERCENT, min_pages: int = 1) -> DataFrame:
    """Per host with any: __host, __drop, the 128-bit hashes of its boilerplate lines."""
    per_page = pages.select(F.col(host_col).alias("__host"), F.array_distinct(F.transform(lines_col, lambda x: F.unhex(F.md5(x)))).alias("__keys"))
    # explode would be filtered by a size that Spark takes from the lines cut a second time
    keys = per_page.select("__host", F.explode_outer("__keys").alias("__key")).where(F.col("__key").isNotNull())
    held = keys.groupBy("__host", "__key").agg(F.count(F.lit(1)).alias("__with")).where(F.col("__with") >= min_pages)
    totals = per_page.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    common = held.join(totals, "__host").where(F.col("__with") * 100 > F.col("__pages") * ratio_percent)
    return common.groupBy("__host").agg(F.collect_set("__key").alias("__drop"))


def line_dedup(pages: DataFrame, ratio_percent: int = RATIO_PERCENT, min_pages: int = 1, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages with __host, __lines (array of visible lines) and __kept (those that stay)."""
    ready(pages.sparkSession)
    cut = pages.withColumn("__host", host(F.col(url_col))).withColumn("__lines", visible_lines(F.col(html_col)))
    drop = stored(boilerplate(cut, "__host", "__lines", ratio_percent, min_pages), "boilerplate")
    joined = cut.join(drop, "__host", "left")
    kept = F.filter("__lines", lambda x: ~F.coalesce(F.array_contains("__drop", F.unhex(F.md5(x))), F.lit(False)))
    return joined.withColumn("__kept", kept).drop("__drop")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "pages"))
    return rows.select(
        "page_id",
        F.col("__host").alias("host"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256"),
    )


SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '{BLOCKS}', chr(10), 'g'), '{TAGS}', '', 'g'), '{SPACES}', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages
), l AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM t) GROUP BY ALL
), h AS (
  SELECT host, count(*) AS pages FROM t GROUP BY host
), b AS (
  SELECT l.host, list(line) AS gone FROM l JOIN h USING (host) WHERE n * 100 > pages * {RATIO_PERCENT} GROUP BY l.host
), k AS (
  SELECT t.*, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept FROM t LEFT JOIN b USING (host)
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
