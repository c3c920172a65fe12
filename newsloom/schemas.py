"""Explicit schemas of the stored tables and of an in-flight mention."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "date": T.DateType(), "double": T.DoubleType(),
    "decimal(5.2)": T.DecimalType(5, 2), "array<string>": T.ArrayType(T.StringType()),
    "map<string:string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(fields: str) -> T.StructType:
    """``name type, name type`` to a schema; unlike DDL parsing it needs no running session."""
    pairs = (f.split() for f in fields.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_MENTION = _schema(
    "run_id string, source_provider string, source_label string, seq bigint, brand_id bigint, title string, "
    "content_teaser string, link string, platform string, published_raw string, published_at timestamp, "
    "extra map<string:string>"
)
PROFILE = _schema("id string, name string, email string, phone_number string, company_name string, contact_email string, role string, created_at timestamp")
PLATFORM = _schema("id bigint, name string")
BRAND = _schema(
    "id bigint, profile_id string, name string, description string, is_active boolean, scrape_frequency_hours int, "
    "initial_lookback_days int, last_scraped_at timestamp, scrape_in_progress boolean, scrape_started_at timestamp, "
    "allowed_languages array<string>"
)
TOPIC = _schema("id bigint, brand_id bigint, name string, query_template string, is_active boolean")
KEYWORD = _schema("id bigint, text string")
TOPIC_KEYWORD = _schema("topic_id bigint, keyword_id bigint")
MENTION = _schema(
    "id bigint, caption string, post_link string, published_at timestamp, content_teaser string, platform_id bigint, "
    "brand_id bigint, topic_id bigint, primary_keyword_id bigint, read_status boolean, notified_status boolean, "
    "created_at timestamp, created_date date"
)
MENTION_KEYWORD = _schema("mention_id bigint, keyword_id bigint, matched_in string, score int, created_at timestamp")
INTEGRATION = _schema("id bigint, profile_id string, integration_name string, webhook_url string, is_active boolean")
CHAT = _schema("id string, user_id string, title string, created_at timestamp, updated_at timestamp")
MESSAGE = _schema("id string, chat_id string, role string, content string, created_at timestamp")
REPORT = _schema("id string, user_id string, brand_id bigint, title string, content string, report_type string, created_at timestamp")
SOURCE_CONFIG = _schema(
    "domain string, title_selector string, content_selector string, date_selector string, search_url_pattern string, "
    "rss_urls array<string>, sitemap_url string, discovery_type string"
)
SCRAPING_JOB = _schema(
    "id bigint, topic_id bigint, name string, is_active boolean, enabled_sources array<string>, max_articles_per_source int, "
    "hours_lookback int, total_mentions_found int"
)
SCRAPABLE_SITE = _schema(
    "id bigint, name string, description string, base_url string, urls_to_scrape array<string>, article_selector string, "
    "exclude_patterns array<string>, include_patterns array<string>, category string, avg_articles_per_day int, "
    "success_rate decimal(5.2), is_active boolean"
)
JOB_SITE = _schema("scraping_job_id bigint, scrapable_site_id bigint, is_active boolean")
METRIC_SAMPLE = _schema("ts timestamp, name string, labels map<string:string>, value double")
