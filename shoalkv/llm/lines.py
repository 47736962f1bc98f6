"""Operator 7: line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency is the number of the host's pages that contain it over the
number of the host's pages; lines above ``RATIO`` (on ``LEAST`` pages or more) are boilerplate of that site and go.
The same line stays on other sites.

Lines are counted by a 128-bit digest, once a page, with partial sums before the shuffle; a line
on more than RATIO of a host's pages leaves fewer than 1 / RATIO mean pages' worth of such lines, so a host's list is
short. Lists are joined to pages by host: broadcast if their number is small (it is counted), else by a join
that AQE splits where one host has a large share of all pages.

For HTML, comments, scripts and styles go, block elements begin and end lines, and other tags go; entities stay as
written. Runs of white space are one space, and lines without text are none.

Defined cases: null text has no lines; a page whose URL is null or has no host keeps all its lines; each
row is a page, repeated ones too; a line repeated within a page counts once and goes or stays with
all its places; an empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A line on more than this share of a host's pages, in percent, and on so many pages at least, is boilerplate.
RATIO, LEAST = 30, 3
#: So many hosts and lines of theirs (some 100 bytes each) at most are broadcast.
BROADCAST = 200_000

UNSEEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1)), F.lit(""))


def lines_of(text: Column, html: bool) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    if html:
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, UNSEEN, " "), BLOCK, "\n"), TAG, "")
    # A single blank stays as it is and so doesn't match, which saves most of the work.
    text = F.btrim(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " "), F.lit(" \n"))
    return F.filter(F.split(text, r"\x20?\n[\x20\n]*", -1), lambda line: line != "")  # the text is made once


def _digests(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.unhex(F.md5(x.cast("binary"))))


def boilerplate(pages: DataFrame, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """``pages`` has ``host`` and ``lines``: by host the digests of its boilerplate lines, and its number of pages."""
    sized = pages.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    each = pages.where("host is not null").select("host", F.explode(F.array_distinct(_digests(F.col("lines")))).alias("digest"))
    counted = each.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    common = counted.join(sized, "host").where(F.col("n") * 100 > F.col("n_pages") * ratio)
    listed = common.groupBy("host").agg(F.collect_list("digest").alias("common"))
    return sized.join(listed, "host", "left").select("host", "n_pages", F.coalesce("common", F.array().cast("array<binary>")).alias("common"))


def dedup(df: DataFrame, url: str = "url", text: str = "html", key: str = "page_id", html: bool = True, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """One row per row of ``df``: page_id, host, n_pages, n_lines, n_dropped, ``kept`` (the lines that stay, joined by line feeds)."""
    pages = df.select(df[f"`{key}`"].cast("long").alias("page_id"), host_of(df[f"`{url}`"]).alias("host"), lines_of(df[f"`{text}`"], html).alias("lines"))
    pages = written(pages, "lines")
    lists = written(boilerplate(pages, ratio, least), "boilerplate")
    hosts, listed = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("common")), F.lit(0))).first()
    lists = F.broadcast(lists) if hosts + listed <= BROADCAST else lists
    stay = F.when(F.size("common") > 0, F.filter("lines", lambda x: ~F.array_contains("common", F.unhex(F.md5(x.cast("binary")))))).otherwise(F.col("lines"))
    joined = pages.join(lists, "host", "left").withColumn("stay", F.coalesce(stay, F.col("lines")))
    return joined.select(
        "page_id",
        "host",
        F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
        F.array_join("stay", "\n").alias("kept"),
    )


#: The query's result in SQL.
DEDUP_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, page_id, nullif(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', ' ', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g') AS t3
  FROM pages
), u AS (
  SELECT rid, page_id, host, regexp_replace(regexp_replace(regexp_replace(t3, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ?\n[\x20\n]*', chr(10), 'g'), '^[\x20\n]+|[\x20\n]+$', '', 'g') AS body FROM t
), p AS (
  SELECT rid, page_id, host, CASE WHEN body = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(body, chr(10)) END AS lines FROM u
), n AS (SELECT host, count(*) AS n_pages FROM p WHERE host IS NOT NULL GROUP BY host),
c AS (SELECT host, line, count(*) AS k FROM (SELECT DISTINCT rid, host, unnest(lines) AS line FROM p WHERE host IS NOT NULL) GROUP BY ALL),
b AS (SELECT host, line FROM c JOIN n USING (host) WHERE k >= {LEAST} AND k * 100 > n_pages * {RATIO}),
e AS (SELECT rid, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM p),
s AS (
  SELECT e.rid, count(*) FILTER (b.line IS NOT NULL) AS n_dropped, coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (b.line IS NULL), '') AS kept
  FROM e LEFT JOIN b ON e.host = b.host AND e.line = b.line GROUP BY e.rid
)
SELECT page_id, host, CAST(coalesce(n_pages, 0) AS BIGINT) AS n_pages, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM p LEFT JOIN n USING (host) LEFT JOIN s USING (rid)
"""
