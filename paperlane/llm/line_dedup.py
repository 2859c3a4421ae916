"""Line dedup by site-relative frequency, in DataFrame expressions only.

For every host, the pages containing a line are divided by the host's pages; lines over `ratio` that stand on at least
`min_pages` pages are boilerplate and are cut from all pages of that host. A line is compared after trimming, folding white
space and lower-casing; it counts once a page. Blank lines are never boilerplate and stay.

Null text stays null and its page counts in the host's total. A null host is a host of its own. Repeated rows are pages of
their own. An empty table gives an empty result. Other columns are passed on unchanged.

What is gathered: one row for each distinct (host, line), counted on the map side first. A host has at most
(lines a page) / ratio boilerplate lines, but hosts are unbounded, so the list is broadcast only if it has at most
`broadcast_lines` rows and BROADCAST_BYTES bytes; otherwise hosts meet their lists in a shuffled join, with hot hosts dealt over `SALTS` parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlane.llm.common import cut

RATIO, MIN_PAGES, BROADCAST_LINES, BROADCAST_BYTES, SALTS = 0.1, 5, 100_000, 32 << 20, 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def line_code(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """host, code, line, pages, host_pages of every line over the ratio."""
    host = F.col(host_col).cast("string").alias("host")
    totals = docs.groupBy(host).agg(F.count("*").alias("host_pages"))
    own = F.array_distinct(F.transform(lines_of(F.col(text_col)), normal_line))
    lines = docs.where(F.col(text_col).isNotNull()).select(host, F.explode(own).alias("line")).where(F.col("line") != "")
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = totals.select(F.col("host").alias("t_host"), "host_pages")
    return counted.join(totals, F.col("host").eqNullSafe(F.col("t_host"))).where(F.col("pages") > F.col("host_pages") * F.lit(ratio)).select("host", F.xxhash64("line").alias("code"), "line", "pages", "host_pages")


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with boilerplate lines cut from the text; all rows and columns stay. Adds nothing."""
    return marked(docs, ratio, min_pages, text_col, host_col, broadcast_lines).withColumn(text_col, F.coalesce("__kept", text_col)).select(*docs.columns)


def marked(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs and __kept: the text without boilerplate, null where the text is null or nothing is cut."""
    found = cut(boilerplate(docs, ratio, min_pages, text_col, host_col).select("host", "line"), "boilerplate")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("line") + 32), F.lit(0))).first()
    small = n <= broadcast_lines and size <= BROADCAST_BYTES
    lists = found.groupBy("host").agg(F.collect_set("line").alias("__bad")).withColumnRenamed("host", "__host")
    host = docs[host_col].cast("string")
    if small:
        joined = docs.join(F.broadcast(lists), host.eqNullSafe(F.col("__host")), "left")
    else:
        dealt = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn("__own", F.pmod(F.xxhash64(F.col(text_col)), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, host.eqNullSafe(F.col("__host")) & (F.col("__own") == F.col("__salt")), "left")
    text = F.col(text_col)
    kept = F.array_join(F.filter(lines_of(text), lambda x: ~F.array_contains(F.col("__bad"), normal_line(x))), "\n")
    return joined.withColumn("__kept", F.when(text.isNotNull() & F.col("__bad").isNotNull(), kept))
