"""Row filters of the ingestion flow and of mention queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import settings
from newsloom.functions import dates, text, url


def where_given(df: DataFrame, **conditions) -> DataFrame:
    """Equality or membership filters; a ``None`` condition does not filter."""
    for column, wanted in conditions.items():
        if wanted is None:
            continue
        if isinstance(wanted, (list, tuple, set)):
            df = df.filter(F.col(column).isin(*wanted))
        else:
            df = df.filter(F.col(column) == F.lit(wanted))
    return df


def published_between(df: DataFrame, start=None, end=None, column: str = "published_at") -> DataFrame:
    """Closed range; either end may be open. Literals keep the filter in the Parquet scan."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast("timestamp"))
    return df


def recent(df: DataFrame, as_of, days: int, column: str = "created_at") -> DataFrame:
    return df.filter(F.col(column) >= dates.days_before(as_of, days))


def strict_date_reason(raw: str, parsed: str, cutoff: Column) -> Column:
    """Why the strict date filter drops a row; null when it stays."""
    return (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.lit("missing_date"))
        .when(F.col(parsed).isNull(), F.lit("unparseable_date"))
        .when(F.col(parsed) < cutoff, F.lit("before_cutoff"))
    )


def lenient_since(df: DataFrame, cutoff: Column | None, column: str = "published_at") -> DataFrame:
    """Feed and sitemap filter: undated rows pass, and without a cutoff every row."""
    if cutoff is None:
        return df
    return df.filter(F.col(column).isNull() | cutoff.isNull() | (F.col(column) >= cutoff))


def active(df: DataFrame, column: str = "is_active") -> DataFrame:
    return df.filter(F.coalesce(F.col(column), F.lit(True)))


def due_for_scrape(df: DataFrame, as_of) -> DataFrame:
    """Brands never scraped, or not within their own frequency (24 h when unset)."""
    hours = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("last_scraped_at")) / 3600
    frequency = F.coalesce(F.nullif("scrape_frequency_hours", F.lit(0)), F.lit(24))
    return df.filter(F.col("last_scraped_at").isNull() | (hours >= frequency))


def no_keywords(keywords) -> Column:
    """Whether a keyword list is null or has nothing but blanks."""
    keywords = keywords if isinstance(keywords, Column) else F.col(keywords)
    return F.coalesce(F.size(text.clean_keywords(keywords)), F.lit(0)) <= 0


def feed_item_matches(title: str, summary: str, keywords, most: int | None = None) -> Column:
    """Any keyword in title or summary, or in the first ``most`` characters of each; items without text pass, and without keywords all."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = lambda c: whole(c) if most is None else F.left(whole(c), F.lit(most))
    joined = F.trim(F.concat_ws(" ", head(title), head(summary)))
    return (joined == "") | no_keywords(keywords) | text.contains_any(joined, keywords)


def sitemap_item_matches(title: str, link: str, keywords) -> Column:
    """Title test where a title exists, else a keyword token in the URL path; without keywords all pass."""
    head = F.trim(F.coalesce(F.col(title), F.lit("")))
    return no_keywords(keywords) | F.when(head != "", text.contains_any(head, keywords)).otherwise(
        text.path_has_keyword_token(url.path(link), keywords)
    )


def keep_relevant(df: DataFrame, verdicts: DataFrame, key: str, flag: str) -> DataFrame:
    """Fail-open: only rows with a negative verdict go. ``verdicts`` has one row per key."""
    rejected = verdicts.filter(~F.col(flag)).select(key)
    return df.join(rejected, key, "left_anti")


def meaningful_content(column: str) -> Column:
    return F.length(text.squeeze(column)) >= settings.MIN_CONTENT_CHARS


def selector_quality(title: str, content: str, date: str) -> list[Column]:
    """Gates a selector must pass on sample pages."""
    size = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return [
        (size(title) >= settings.MIN_SELECTOR_TITLE_CHARS).alias("title_ok"),
        (size(content) >= settings.MIN_SELECTOR_CONTENT_CHARS).alias("content_ok"),
        F.coalesce(F.col(date).rlike("202[0-9]"), F.lit(False)).alias("date_ok"),
    ]


def confidence(found: Column, assisted: bool = True) -> Column:
    """Label for a number of found selectors; the unassisted path never claims ``high``."""
    if not assisted:
        return F.when(found == 3, F.lit("medium")).otherwise(F.lit("low"))
    return F.when(found >= 3, F.lit("high")).when(found >= 2, F.lit("medium")).otherwise(F.lit("low"))


def discovery_strategy() -> Column:
    """Usable strategy of a source configuration, null when its own field is missing."""
    kind = F.coalesce("discovery_type", F.lit("site_search"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (
        F.when((kind == "site_search") & F.coalesce(F.col("search_url_pattern"), F.lit("")).contains("{keyword}"), kind)
        .when((kind == "rss") & (F.coalesce(F.size("rss_urls"), F.lit(0)) > 0), kind)
        .when((kind == "sitemap") & filled("sitemap_url"), kind)
    )


def best_discovery(news_sitemap: str, sitemap: str, rss_urls: str) -> Column:
    """News sitemap, then feeds, then any sitemap, then site search."""
    return (
        F.when(F.col(news_sitemap).isNotNull(), F.lit("sitemap"))
        .when(F.coalesce(F.size(rss_urls), F.lit(0)) > 0, F.lit("rss"))
        .when(F.col(sitemap).isNotNull(), F.lit("sitemap"))
        .otherwise(F.lit("site_search"))
    )


def extraction_date_reason(raw: str, confident: str, parsed: str, cutoff: Column) -> Column:
    """Ordered skip reasons of extracted articles under a cutoff."""
    return (
        F.when(F.coalesce(F.col(raw), F.lit("")) == "", F.lit("date_missing_cutoff_skip"))
        .when(~F.col(confident), F.lit("date_low_confidence_cutoff_skip"))
        .when(F.col(parsed).isNull(), F.lit("date_unparseable_cutoff_skip"))
        .when(F.col(parsed) < cutoff, F.lit("date_before_cutoff_skip"))
    )


def strong_or_fallback(
    df: DataFrame, run: str, score: str,
    primary: int = settings.PRIMARY_KEYWORD_MATCHES,
    fallback: int = settings.FALLBACK_KEYWORD_MATCHES,
) -> DataFrame:
    """Per run: strong matches if there are any, otherwise the fallback matches."""
    best = df.groupBy(run).agg(F.max(score).alias("_best"))
    needed = F.when(F.col("_best") >= primary, F.lit(primary)).otherwise(F.lit(fallback))
    return df.join(best, run).filter(F.col(score) >= needed).drop("_best")


def thin_page(html: str, min_chars: int = settings.MIN_VISIBLE_CHARS) -> Column:
    return F.length(text.visible_text(html)) < min_chars


def html_title(html: str) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def soft_404_reason(status: str, final_url: str, domain: str, page_title: Column, home_title: Column) -> Column:
    """Why a landed search result page does not count as a working search."""
    landed = F.regexp_replace(F.col(final_url), r"/+$", "")
    home = landed.isin(F.concat(F.lit("https://"), F.col(domain)), F.concat(F.lit("http://"), F.col(domain)))
    return (
        F.when(F.col(status) != 200, F.lit("status"))
        .when(home, F.lit("redirected_home"))
        .when((page_title != "") & (page_title == home_title), F.lit("same_title"))
    )


def config_reject_reason() -> Column:
    """First validation error of a source configuration, null when valid."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    pattern = F.trim(F.coalesce(F.col("search_url_pattern"), F.lit("")))
    probe = F.replace(pattern, F.lit("{keyword}"), F.lit("test"))
    feeds = F.filter(F.coalesce(F.col("rss_urls"), F.array().cast("array<string>")), lambda u: F.trim(u) != "")
    too_long = lambda c: F.coalesce(F.length(c), F.lit(0)) > 500
    return (
        F.when(blank("domain"), F.lit("empty_domain"))
        .when(F.length("domain") > 255, F.lit("domain_too_long"))
        .when(too_long("title_selector") | too_long("content_selector") | too_long("date_selector")
              | too_long("search_url_pattern") | too_long("sitemap_url"), F.lit("field_too_long"))
        .when((pattern != "") & ~pattern.contains("{keyword}"), F.lit("pattern_without_keyword"))
        .when((pattern != "") & ~url.is_http(probe), F.lit("pattern_not_absolute"))
        .when(F.exists(feeds, lambda u: ~url.is_http(F.trim(u))), F.lit("feed_not_absolute"))
        .when(~blank("sitemap_url") & ~url.is_http(F.trim("sitemap_url")), F.lit("sitemap_not_absolute"))
        .when(~F.coalesce(F.col("discovery_type"), F.lit("rss")).isin("rss", "sitemap", "site_search"), F.lit("unknown_strategy"))
        .when((F.col("discovery_type") == "rss") & (F.size(feeds) == 0), F.lit("rss_without_feeds"))
        .when((F.col("discovery_type") == "sitemap") & blank("sitemap_url"), F.lit("sitemap_without_url"))
        .when((F.col("discovery_type") == "site_search") & (pattern == ""), F.lit("search_without_pattern"))
    )


def lock_state(as_of, stale_minutes: int = settings.LOCK_STALE_MINUTES) -> Column:
    """``free``, ``active`` or ``stale`` for a brand's scrape lock."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(stale_minutes))
    held = F.coalesce(F.col("scrape_in_progress"), F.lit(False))
    return (
        F.when(~held, F.lit("free"))
        .when(F.col("scrape_started_at") < limit, F.lit("stale"))
        .otherwise(F.lit("active"))
    )
