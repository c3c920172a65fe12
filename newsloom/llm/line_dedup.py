"""Line dedup by site-relative frequency, with DataFrame operations only.

A line is boilerplate of a site when the share of the site's pages that contain it exceeds a ratio. Counts are
kept per (host, digest of the line) over all pages, so only digests are shuffled, once and pre-aggregated. As every
boilerplate line takes up more than its ratio of a site's pages, a site has fewer than (mean lines per page) / ratio of them, which bounds
the array of digests that is joined to the site's pages. Spark broadcasts those arrays if they are small and splits a hot
host's pages otherwise; a page is never taken apart into rows and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import query, table, unused_name

#: Share of a site's pages that a line may be on.
RATIO = 0.02
#: Pages that a line has to be on at least; on a site of a few pages every line is on a large share.
LEAST_PAGES = 3


def boilerplate(pages: DataFrame, host: Column, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, digests: the boilerplate lines of every site that has any. Blank lines are never counted."""
    sites = pages.select(host.alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    totals = sites.groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.filter(F.split("text", "\n"), lambda line: F.trim(line) != ""))
    counts = sites.select("host", F.explode(F.transform(lines, F.md5)).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("on"))
    common = counts.filter(F.col("on") >= least_pages).alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return common.filter(F.col("on") > ratio * F.col("pages")).groupBy("c.host").agg(F.collect_list("digest").alias("digests"))


def drop_lines(pages: DataFrame, host: Column, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with ``text`` less its site's boilerplate lines, and n_lines and n_dropped.

    The other columns stay as they are (of those two names they are replaced). Lines end at ``\\n``; those that stay keep
    their order. A null text stays null and has no lines. Pages without a host form one site. Repeated rows are pages of their
    own. An empty table gives no rows.
    """
    columns = [c for c in pages.columns if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    site, bad, lines, left, key = (unused_name(pages, n) for n in ("site", "digests", "lines", "left", "host_"))
    found = boilerplate(pages, host, text, ratio, least_pages).select(F.col("host").alias(key), F.col("digests").alias(bad))
    joined = pages.withColumn(site, host).join(found, F.col(site).eqNullSafe(F.col(key)), "left").drop(key)
    split = joined.withColumn(lines, F.split(text, "\n"))
    kept = F.when(F.col(bad).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda line: ~F.array_contains(bad, F.md5(line))))
    size = lambda c: F.coalesce(F.when(F.col(text).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return split.withColumn(left, kept).select(
        *[F.col(f"`{c}`") for c in columns], F.array_join(left, "\n").alias(text), size(lines).alias("n_lines"), (size(lines) - size(left)).alias("n_dropped")
    )


@query(
    "op4_line_dedup",
    """
    WITH d AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
    t AS (SELECT source, count(*) AS pages FROM d GROUP BY 1),
    c AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_filter(lines, lambda x: trim(x) <> ''))) AS line FROM d) GROUP BY ALL),
    b AS (SELECT c.source, list(line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > 0.02 * pages GROUP BY 1),
    k AS (SELECT d.*, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS rest FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN array_to_string(rest, chr(10)) END AS text, len(lines) AS n_lines, len(lines) - len(rest) AS n_dropped FROM k""",
)
def op4_line_dedup(spark, folder):
    return drop_lines(table(spark, folder, "documents", "doc_id", "text", "source"), F.col("source"), "text")
