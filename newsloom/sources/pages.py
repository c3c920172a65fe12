"""Landed HTML pages: links, feeds, article fields and selector suggestions."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsloom import settings
from newsloom.functions import markup, url
from newsloom.operators.once import once

_HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_NO_MARKUP = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#38;": "&", "&amp;": "&"}
_FEED_LINK = r"""(?i)<link\b[^>]*>"""


def _attribute_value(raw):
    """An attribute as written, without its quotes and with the common character references decoded."""
    value = F.regexp_replace(raw, r"""^["']|["']$""", "")
    for name, character in _ENTITIES.items():
        value = F.replace(value, F.lit(name), F.lit(character))
    return value


def page_links(pages: DataFrame, domain: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Every anchor of a page as an absolute URL with its position."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), _NO_MARKUP, " ")
    hrefs = F.transform(F.regexp_extract_all(shown, F.lit(_HREF), F.lit(1)), _attribute_value)
    rows = pages.select(*keep, F.col(domain).alias("domain"), F.posexplode(hrefs).alias("position", "href"))
    rows = rows.filter(F.trim("href") != "")
    return rows.withColumn("url", url.resolve_href("domain", "href"))


def candidate_links(links: DataFrame) -> DataFrame:
    """Distinct normalised article URLs per domain."""
    fit = article_urls(links)
    return fit.select("domain", url.normalize_url("url").alias("url")).distinct()


def article_urls(links: DataFrame) -> DataFrame:
    """Rows whose ``url`` may be an article of ``domain``; the URL is taken apart once."""
    parts = once(links, _path=F.trim(url.path("url")), _host=url.normalize_domain(url.netloc("url")), _site=url.normalize_domain("domain"))
    same = (F.col("_host") == F.col("_site")) | F.col("_host").endswith(F.concat(F.lit("."), F.col("_site")))
    fit = parts.filter(url.scheme("url").isin("http", "https") & same & url.is_article_path(F.col("_path")))
    return fit.drop("_path", "_host", "_site")


def feed_links(pages: DataFrame, domain: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """RSS and Atom feeds announced by ``link rel=alternate``."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_FEED_LINK), F.lit(0))
    rows = pages.select(*keep, F.col(domain).alias("domain"), F.posexplode(tags).alias("position", "tag"))
    attribute = lambda name: F.regexp_extract("tag", rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    feed = F.trim(attribute("type")).isin("application/rss+xml", "application/atom+xml")
    announced = F.array_contains(F.split(F.lower(attribute("rel")), r"\s+"), "alternate")
    rows = rows.filter(announced & feed & (F.trim(attribute("href")) != ""))
    return rows.select(*keep, "domain", "position", url.resolve_href("domain", attribute("href")).alias("feed_url"))


def robots_sitemaps(robots: DataFrame, keep: tuple[str, ...] = ("domain",)) -> DataFrame:
    """First news sitemap and first other sitemap per robots.txt (column ``body``)."""
    lines = robots.select(*keep, F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line"))
    lines = lines.filter(F.lower("line").startswith("sitemap:"))
    lines = lines.withColumn("sitemap", F.trim(F.regexp_replace("line", r"^[^:]*:", "")))
    is_news = F.lower("sitemap").contains("news")
    numbered = lines.withColumn("_news", is_news)
    first_news = F.min_by(F.when(F.col("_news"), F.col("sitemap")), F.when(F.col("_news"), F.col("line_no")))
    # A second news sitemap is an ordinary one for the "other" slot.
    news_rank = F.min(F.when(F.col("_news"), F.col("line_no")))
    firsts = numbered.groupBy(*keep).agg(first_news.alias("news_sitemap"), news_rank.alias("_news_line"))
    other = (
        numbered.join(firsts.select(*keep, "_news_line"), list(keep))
        .filter(F.col("_news_line").isNull() | (F.col("line_no") != F.col("_news_line")))
        .groupBy(*keep)
        .agg(F.min_by("sitemap", "line_no").alias("other_sitemap"))
    )
    return firsts.drop("_news_line").join(other, list(keep), "left")


ARTICLE_FIELDS = (
    "page_id bigint, url string, config_domain string, title string, content string, "
    "date_raw string, date_from_attribute boolean, extracted_via string"
)


def extract_articles(pages: DataFrame) -> DataFrame:
    """Title, content and date per page, in Arrow batches.

    Expects page_id, url, html and the joined configuration: config_domain, title_selector,
    content_selector, date_selector (null without one). Order of trust: configured selectors, the
    generic lists, then the text of the whole page; the longer content wins.
    """
    columns = ["page_id", "url", "html", "config_domain", "title_selector", "content_selector", "date_selector"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_article(row) for row in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in ARTICLE_FIELDS.split(", ")])

    return pages.select(*columns).mapInPandas(run, ARTICLE_FIELDS)


def _first_text(page: markup.Page, selectors) -> str:
    return next((t for s in selectors if (t := markup.select_text(page, s))), "")


def _article(row) -> tuple:
    html = row.html or ""
    page = markup.Page(html)
    enough = lambda body: len(body) >= settings.MIN_CONTENT_CHARS
    title = markup.select_text(page, row.title_selector)
    content = markup.select_text(page, row.content_selector)
    date, from_attribute = markup.select_date(page, row.date_selector)
    via = "config" if enough(content) else "none"
    if not enough(content):
        title = title or _first_text(page, settings.TITLE_SELECTORS)
        content = max(content, _first_text(page, settings.CONTENT_SELECTORS), key=len)
        if not date:
            found = (markup.select_date(page, s) for s in settings.DATE_SELECTORS)
            date, from_attribute = next((d for d in found if d[0]), ("", False))
        via = "generic" if enough(content) else "none"
    if not enough(content) and len(html) >= settings.MIN_WHOLE_PAGE_CHARS:
        title = title or markup.select_text(page, "title")
        content = max(content, page.all_text(), key=len)
        via = "page" if enough(content) else "none"
    return row.page_id, row.url, row.config_domain, title, content, date, from_attribute, via


SELECTOR_HITS = "page_id bigint, field string, rank int, selector string, text string"


def selector_hits(pages: DataFrame) -> DataFrame:
    """Every generic selector that finds something on a page, with its text."""
    lists = {
        "title": settings.TITLE_SELECTORS,
        "content": settings.CONTENT_SELECTORS,
        "date": settings.DATE_SELECTORS,
    }
    return _hits(pages, lists)


def suggested_selector_hits(pages: DataFrame) -> DataFrame:
    """The same for the short candidate lists of the unassisted analysis."""
    lists = {
        "title": settings.SUGGEST_TITLE_SELECTORS,
        "content": settings.SUGGEST_CONTENT_SELECTORS,
        "date": settings.SUGGEST_DATE_SELECTORS,
    }
    return _hits(pages, lists)


def _hits(pages: DataFrame, lists: dict) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                page = markup.Page(row.html or "")
                for field, selectors in lists.items():
                    for rank, selector in enumerate(selectors):
                        i = page.select_first(selector)
                        if i >= 0:
                            attrs = page.attrs[i]
                            stamp = attrs.get("content", "") if page.tags[i] == "meta" else ""
                            if field == "date" and "datetime" in attrs:
                                stamp = attrs["datetime"]
                            rows.append((row.page_id, field, rank, selector, stamp or page.text(i)))
            yield pd.DataFrame(rows, columns=["page_id", "field", "rank", "selector", "text"])

    return pages.select("page_id", "html").mapInPandas(run, SELECTOR_HITS)


def suggest_selectors(hits: DataFrame, page_domains: DataFrame) -> DataFrame:
    """Per domain and field: the best-ranked selector whose text passes its quality gate."""
    size = F.length(F.trim("text"))
    good = (
        F.when(F.col("field") == "title", size >= settings.MIN_SELECTOR_TITLE_CHARS)
        .when(F.col("field") == "content", size >= settings.MIN_SELECTOR_CONTENT_CHARS)
        .otherwise(F.col("text").rlike("202[0-9]"))
    )
    passed = hits.filter(good).join(page_domains, "page_id")
    best = passed.groupBy("domain", "field").agg(F.min_by("selector", "rank").alias("selector"))
    wide = best.groupBy("domain").pivot("field", ["title", "content", "date"]).agg(F.first("selector"))
    return wide.withColumnsRenamed({"title": "title_selector", "content": "content_selector", "date": "date_selector"})
