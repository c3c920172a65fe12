"""RSS, Atom and sitemap scans.

``read_*`` use Spark's XML source on landed files; the ``*_items`` functions take one XML fragment
per row (column ``xml``). Elements of other namespaces (``atom:link``, ``media:title``) stay apart from those of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom import settings
from newsloom.functions import dates, text, url
from newsloom.operators import filters
from newsloom.operators.once import once
from newsloom.operators.ordered import top_per_key
from newsloom.session import cut_lineage
from newsloom.sources.pages import article_urls

RSS_ITEM = "link string, pubDate string, title string, description string, guid string"
ATOM_ENTRY = (
    "link array<struct<_href:string,_rel:string>>, published string, updated string, "
    "title string, summary string, id string"
)
SITEMAP_URL = "loc string, lastmod string, news struct<publication_date:string,title:string>"
SITEMAP_CHILD = "loc string"


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Landed XML files, split by row tag so that one large feed is still many tasks. Only the fields of sitemaps,
    which nest, are read whatever their prefix."""
    nested = str(row_tag in ("url", "sitemap")).lower()
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", nested).schema(schema).load(path)


def plain_names(xml: str) -> Column:
    """Fragment without namespace prefixes on element names."""
    return F.regexp_replace(F.col(xml), r"(</?)[A-Za-z0-9]+:", "$1")


def own_names(xml: str) -> Column:
    """Fragment whose root has a prefix (``<a:entry>``), without that prefix; others, and the text, stay as they are."""
    prefix = F.regexp_extract(xml, r"^\s*<([A-Za-z0-9]+):", 1)
    bare = F.regexp_replace(F.col(xml), F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1"))
    return F.when(prefix == "", F.col(xml)).otherwise(bare)


def rss_items(df: DataFrame, as_of) -> DataFrame:
    parsed = once(df, _i=F.from_xml(own_names("xml"), RSS_ITEM))
    return _dated(parsed, "_i.link", "_i.pubDate", "_i.title", "_i.description", as_of)


def atom_entries(df: DataFrame, as_of) -> DataFrame:
    parsed = once(df, _i=F.from_xml(own_names("xml"), ATOM_ENTRY))
    alternate = F.filter("_i.link", lambda k: k["_rel"] == "alternate")
    link = F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get("_i.link", F.lit(0))["_href"])
    raw = F.coalesce("_i.published", "_i.updated")
    return _dated(parsed, link, raw, "_i.title", "_i.summary", as_of)


def sitemap_urls(df: DataFrame, as_of) -> DataFrame:
    parsed = once(df, _i=F.from_xml(plain_names("xml"), SITEMAP_URL))
    raw = F.coalesce(F.nullif("_i.news.publication_date", F.lit("")), F.col("_i.lastmod"))
    return _dated(parsed, "_i.loc", raw, "_i.news.title", F.lit(""), as_of)


def _dated(df: DataFrame, link, raw, title, summary, as_of) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select(
        *[c for c in df.columns if c not in ("_i", "xml")],
        F.trim(as_col(link)).alias("link"),
        as_col(raw).alias("published_raw"),
        as_col(title).alias("title"),
        as_col(summary).alias("summary"),
    )
    return once(out.filter(F.coalesce("link", F.lit("")) != ""), published_at=dates.parse_date("published_raw", as_of))


def discovered_urls(items: DataFrame, cutoff: Column, keywords: Column, sitemap: bool = False) -> DataFrame:
    """Distinct article URLs per domain from feed items: lenient date, keyword and URL filters."""
    recent = filters.lenient_since(items, cutoff)
    if sitemap:
        wanted = filters.sitemap_item_matches("title", "link", keywords)
    else:
        wanted = filters.feed_item_matches("title", "summary", keywords)
    urls = once(recent.filter(wanted), url=url.normalize_url("link"))
    return article_urls(urls).select("domain", "url").distinct()


def sitemap_children(df: DataFrame, index: str = "index_id") -> DataFrame:
    """Child sitemaps to follow: those named "news" first, three per index, in document order."""
    parsed = once(df, loc=F.trim(F.from_xml(plain_names("xml"), SITEMAP_CHILD)["loc"]))
    named = parsed.filter(F.coalesce("loc", F.lit("")) != "").withColumn("is_news", F.lower("loc").contains("news"))
    order = [F.desc("is_news"), "seq"]
    return top_per_key(named, [index], order, settings.MAX_CHILD_SITEMAPS).drop("xml")


def keyword_feed(items: DataFrame, since: Column) -> DataFrame:
    """Entries of per-keyword news feeds with the reason each is skipped (null when kept).

    Needs keyword, seq, link, guid, title, summary, published_raw, published_at. The first entry
    of a canonical link per keyword stays, whatever locale it came from.
    """
    body = F.concat_ws("\n", F.coalesce("title", F.lit("Ingen titel")), F.coalesce("summary", F.lit("")))
    no_text = F.lit(None).cast("string")
    canonical = url.canonical_link(url.entry_candidates("link", no_text, "guid", "summary"))
    early = (
        F.when(F.coalesce("published_raw", F.lit("")) == "", F.lit("missing_date"))
        .when(F.col("published_at").isNull(), F.lit("unparseable_date"))
        .when(F.col("published_at") < since, F.lit("before_cutoff"))
        .when(~text.matches_phrase(body, "keyword"), F.lit("phrase_miss"))
    )
    # Links are only resolved for entries that pass the cheaper tests.
    linked = once(once(items, _early=early), canonical_link=F.when(F.col("_early").isNull(), canonical))
    missing = F.when(F.col("canonical_link") == "", F.lit("no_link"))
    # Read twice below (first links, then all entries), so it is computed and stored once.
    judged = cut_lineage(linked.withColumn("skip_reason", F.coalesce("_early", missing)).drop("_early"))
    ok = F.col("skip_reason").isNull()
    firsts = judged.filter(ok).groupBy("keyword", "canonical_link").agg(F.min("seq").alias("_first"))
    repeated = (F.col("skip_reason").isNull()) & (F.col("seq") > F.col("_first"))
    return judged.join(firsts, ["keyword", "canonical_link"], "left").withColumn(
        "skip_reason", F.when(repeated, F.lit("duplicate_link")).otherwise(F.col("skip_reason"))
    ).drop("_first")
