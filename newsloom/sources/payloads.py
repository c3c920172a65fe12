"""Landed JSON payloads of news and search APIs.

Each reader takes a DataFrame with one payload per row (``payload`` text plus any run columns), so
it serves files, tables and streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import settings
from newsloom.functions import dates, queries
from newsloom.operators.once import once

NEWS_PAYLOAD = "articles array<struct<title:string,url:string,description:string,publishedAt:string>>"
_RESULT = (
    "struct<title:string,link:string,url:string,snippet:string,iso_date:string,"
    "published_at:string,date:string,source:string>"
)
SEARCH_PAYLOAD = f"news_results array<{_RESULT}>, organic_results array<{_RESULT}>, error string"


def news_articles(payloads: DataFrame, since: Column, as_of) -> DataFrame:
    """News-API articles with a URL; ``skip_reason`` is null for those inside the window."""
    parsed = payloads.withColumn("_p", F.from_json("payload", NEWS_PAYLOAD))
    rows = parsed.select(*payloads.columns, F.posexplode("_p.articles").alias("position", "_a")).drop("payload")
    rows = rows.filter(F.col("_a.url").isNotNull())
    out = rows.select(
        *[c for c in rows.columns if c != "_a"],
        F.coalesce("_a.title", F.lit("Uden titel")).alias("title"),
        F.col("_a.url").alias("link"),
        F.coalesce("_a.description", F.lit("")).alias("content_teaser"),
        F.lit("GNews").alias("platform"),
        F.col("_a.publishedAt").alias("published_raw"),
    )
    dated = once(out, published_at=dates.parse_date("published_raw", as_of))
    return dated.withColumn("skip_reason", _window_reason(since))


def _window_reason(since: Column) -> Column:
    return (
        F.when(F.coalesce("published_raw", F.lit("")) == "", F.lit("missing_date"))
        .when(F.col("published_at").isNull(), F.lit("unparseable_date"))
        .when(F.col("published_at") < since, F.lit("before_cutoff"))
    )


def platform_of(source: Column) -> Column:
    """Title or name of a source object, or the source text itself."""
    as_object = F.from_json(source, "title string, name string")
    from_object = F.coalesce(F.nullif(as_object["title"], F.lit("")), F.nullif(as_object["name"], F.lit("")))
    plain = F.when(~source.startswith("{"), F.nullif(source, F.lit("")))
    return F.coalesce(from_object, plain)


def search_results(payloads: DataFrame, cutoff: Column | None, as_of) -> DataFrame:
    """Search results in one shape, first 20 per payload; error payloads yield none.

    Without a cutoff undated rows get ``as_of`` as their date and are flagged.
    """
    parsed = once(payloads, _p=F.from_json("payload", SEARCH_PAYLOAD))
    parsed = parsed.withColumn("error_type", queries.api_outcome("_p.error")).filter(F.col("error_type").isNull())
    is_news = F.col("_p.news_results").isNotNull()
    results = F.slice(F.coalesce("_p.news_results", "_p.organic_results"), 1, settings.MAX_SEARCH_RESULTS)
    rows = parsed.select(
        *[c for c in payloads.columns if c != "payload"], is_news.alias("_news"),
        F.posexplode(results).alias("position", "_r"),
    )
    raw = F.when(F.col("_news"), dates.first_date("_r.iso_date", "_r.published_at", "_r.date")).otherwise(F.col("_r.date"))
    link = F.when(F.col("_news"), F.col("_r.link")).otherwise(
        F.coalesce(F.nullif("_r.link", F.lit("")), F.col("_r.url"))
    )
    default_source = F.when(F.col("_news"), F.lit("Google News")).otherwise(F.lit("Google"))
    out = rows.select(
        *[c for c in rows.columns if c not in ("_r", "_news")],
        F.coalesce("_r.title", F.lit("No title")).alias("title"),
        F.coalesce(link, F.lit("")).alias("link"),
        F.coalesce("_r.snippet", F.lit("")).alias("content_teaser"),
        F.coalesce(platform_of(F.col("_r.source")), default_source).alias("platform"),
        raw.alias("published_raw"),
    )
    out = once(out, published_at=dates.parse_date("published_raw", as_of))
    if cutoff is not None:
        return out.withColumn("skip_reason", _window_reason(cutoff)).withColumn("date_imputed", F.lit(False))
    imputed = F.col("published_at").isNull()
    return (
        out.withColumn("skip_reason", F.lit(None).cast("string"))
        .withColumn("date_imputed", imputed)
        .withColumn("published_at", F.coalesce("published_at", F.lit(as_of).cast("timestamp")))
    )


def payload_errors(payloads: DataFrame) -> DataFrame:
    """Payloads that report an error, with its metric type."""
    parsed = payloads.withColumn("_error", F.from_json("payload", "error string")["error"])
    typed = parsed.withColumn("error_type", queries.api_outcome("_error"))
    return typed.filter(F.col("error_type").isNotNull()).drop("_error", "payload")


def reason_counts(df: DataFrame, keys: list[str], reason: str = "skip_reason") -> DataFrame:
    """Skip counters per key and in total (null key), in one pass."""
    return df.rollup(*keys).agg(
        F.count("*").alias("seen"),
        F.count_if(F.col(reason).isNull()).alias("kept"),
        F.count_if(F.col(reason) == "missing_date").alias("missing_date"),
        F.count_if(F.col(reason) == "unparseable_date").alias("unparseable_date"),
        F.count_if(F.col(reason) == "before_cutoff").alias("before_cutoff"),
        F.count_if(F.col(reason) == "phrase_miss").alias("phrase_miss"),
        F.count_if(F.col(reason) == "no_link").alias("no_link"),
        F.count_if(F.col(reason) == "duplicate_link").alias("duplicate_links"),
    )
