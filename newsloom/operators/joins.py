"""Joins over the mention schema: embedding, ownership, taxonomy, configuration lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom import settings
from newsloom.functions import queries, text, url
from newsloom.operators.ordered import row_numbers, top_per_key


def embed(df: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Left outer N:1 embedding: the dimension row becomes a struct column, null if absent.

    No broadcast hint: Spark picks it when the dimension's size allows.
    """
    packed = dim.select(F.col("id").alias(key), F.struct(*dim.columns).alias(name))
    return df.drop(name).join(packed, key, "left")


def embed_mention(mentions: DataFrame, brands: DataFrame, topics: DataFrame, platforms: DataFrame) -> DataFrame:
    out = embed(mentions, brands, "brand_id", "brand")
    out = embed(out, topics, "topic_id", "topic")
    return embed(out, platforms, "platform_id", "platform")


def with_keyword_matches(mentions: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Nested keyword matches; links without a keyword row are left out.

    The array is small by nature: every entry is a phrase found in one title and teaser.
    """
    wanted = links.join(mentions.select(F.col("id").alias("mention_id")), "mention_id", "left_semi")
    detail = wanted.join(keywords.select(F.col("id").alias("keyword_id"), F.col("text")), "keyword_id")
    match = F.struct("keyword_id", "text", "matched_in", "score")
    nested = detail.groupBy("mention_id").agg(F.sort_array(F.collect_list(match)).alias("keyword_matches"))
    return mentions.join(nested.withColumnRenamed("mention_id", "id"), "id", "left").withColumn(
        "keyword_matches", F.coalesce("keyword_matches", F.array().cast(nested.schema["keyword_matches"].dataType))
    )


def normalize_relations(df: DataFrame) -> DataFrame:
    """Plural relation names become singular; matches without a keyword disappear."""
    out = df.withColumnsRenamed({"brands": "brand", "topics": "topic", "platforms": "platform"})
    if "mention_keywords" in out.columns:
        present = F.filter("mention_keywords", lambda m: m["keyword"].isNotNull())
        out = out.withColumn("keyword_matches", present).drop("mention_keywords")
    return out


def topic_keywords(topics: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Flat taxonomy: brand, topic and keyword per row."""
    return (
        links.join(topics.select(F.col("id").alias("topic_id"), "brand_id", F.col("name").alias("topic")), "topic_id")
        .join(keywords.select(F.col("id").alias("keyword_id"), F.col("text").alias("keyword")), "keyword_id")
        .select("brand_id", "topic_id", "topic", "keyword_id", "keyword")
    )


def taxonomy_tree(brands: DataFrame, topics: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Brand -> topics -> keywords, nested. Meant for the brands of one user: taxonomies are
    typed in by people, so the arrays stay small."""
    flat = topic_keywords(topics, links, keywords)
    words = flat.groupBy("topic_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("keyword_id").alias("id"), F.col("keyword").alias("text")))).alias("keywords")
    )
    nested = topics.join(words.withColumnRenamed("topic_id", "id"), "id", "left").groupBy("brand_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "name", "keywords"))).alias("topics")
    )
    return brands.join(nested.withColumnRenamed("brand_id", "id"), "id", "left")


def taxonomy_counts(brands: DataFrame, topics: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Topics and keywords of every brand, zero included: sizes of the tree without building it."""
    words = topic_keywords(topics, links, keywords).groupBy("brand_id").agg(F.count("*").alias("keywords"))
    named = topics.groupBy("brand_id").agg(F.count_distinct("id").alias("topics"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = brands.select("id").join(named, brands["id"] == named["brand_id"], "left").drop("brand_id")
    return joined.join(words, joined["id"] == words["brand_id"], "left").select("id", zero("topics"), zero("keywords"))


def owned_by(df: DataFrame, brands: DataFrame, profile_id, admin: bool = False) -> DataFrame:
    """Rows of the user's own brands; an admin sees everything."""
    if admin:
        return df
    mine = brands.filter(F.col("profile_id") == F.lit(profile_id)).select(F.col("id").alias("brand_id"))
    return df.join(mine, "brand_id", "left_semi")


def owned_through_topic(df: DataFrame, topics: DataFrame, brands: DataFrame, profile_id, admin: bool = False) -> DataFrame:
    """Two-hop ownership: row -> topic -> brand -> user."""
    if admin:
        return df
    mine = owned_by(topics, brands, profile_id).select(F.col("id").alias("topic_id"))
    return df.join(mine, "topic_id", "left_semi")


def user_keywords(brands: DataFrame, topics: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct keyword texts of every user's active topics."""
    live = topics.filter(F.coalesce("is_active", F.lit(True)))
    flat = topic_keywords(live, links, keywords)
    owners = brands.select(F.col("id").alias("brand_id"), "profile_id")
    return flat.join(owners, "brand_id").select("profile_id", "keyword").distinct()


def by_keys(mentions: DataFrame, wanted: DataFrame, keys=("post_link", "topic_id")) -> DataFrame:
    """Stored rows whose composite key is requested."""
    return mentions.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def longest_suffix(df: DataFrame, host: str, configs: DataFrame) -> DataFrame:
    """Most specific configuration per host (left outer).

    Resolved once per distinct host, which shrinks the input before suffixes are exploded.
    """
    hosts = df.select(F.col(host).alias("_host")).distinct()
    ladder = hosts.select("_host", F.posexplode(url.domain_suffixes("_host")).alias("_depth", "_suffix"))
    keyed = configs.withColumn("_suffix", url.normalize_domain("domain"))
    found = ladder.join(keyed, "_suffix").drop("_suffix")
    best = top_per_key(found, ["_host"], ["_depth"], 1).drop("_depth")
    best = best.withColumnRenamed("domain", "config_domain")
    return df.join(best, df[host] == best["_host"], "left").drop("_host")


def job_site_rows(jobs: DataFrame, topics: DataFrame, brands: DataFrame, job_sites: DataFrame, sites: DataFrame) -> DataFrame:
    """Jobs with topic and brand, a row per active site (site_id, site_name, category), one row of nulls without any."""
    chosen = job_sites.filter("is_active").join(
        sites.select(F.col("id").alias("scrapable_site_id"), F.col("name").alias("site_name"), "category"), "scrapable_site_id"
    ).select("scraping_job_id", F.col("scrapable_site_id").alias("site_id"), "site_name", "category")
    owned = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"), "brand_id").join(
        brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name")), "brand_id"
    )
    return jobs.join(owned, "topic_id").join(chosen, jobs["id"] == chosen["scraping_job_id"], "left").drop("scraping_job_id")


def jobs_with_sites(jobs: DataFrame, topics: DataFrame, brands: DataFrame, job_sites: DataFrame, sites: DataFrame) -> DataFrame:
    """Jobs with their active sites as JSON, null without any. For the jobs of one user: a job's sites become one value."""
    rows = job_site_rows(jobs, topics, brands, job_sites, sites)
    site = F.when(F.col("site_id").isNotNull(), F.struct(F.col("site_id").alias("id"), F.col("site_name").alias("name"), "category"))
    kept = [c for c in rows.columns if c not in ("site_id", "site_name", "category")]
    packed = rows.groupBy(*kept).agg(F.sort_array(F.collect_list(site)).alias("_sites"))
    return packed.select(*kept, F.when(F.size("_sites") > 0, F.to_json("_sites")).alias("active_sites"))


def site_usage(sites: DataFrame, job_sites: DataFrame) -> DataFrame:
    """Active sites with their number of jobs, zero included."""
    uses = job_sites.groupBy(F.col("scrapable_site_id").alias("id")).agg(
        F.count("scraping_job_id").alias("job_usage_count"), F.count_if("is_active").alias("active_job_count")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return sites.filter("is_active").join(uses, "id", "left").select(
        *sites.columns, zero("job_usage_count"), zero("active_job_count")
    )


def resolve_names(requests: DataFrame, brands: DataFrame, column: str = "brand_name") -> DataFrame:
    """Brand id by trimmed, case-insensitive name; the lowest id wins, unknown names stay null."""
    named = brands.groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.min("id").alias("brand_id"))
    return requests.withColumn("_name", F.lower(F.trim(column))).join(named, "_name", "left").drop("_name")


def numbered_messages(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of every chat in order, with their position, as rows: a long chat is not nested
    into one value."""
    ordered = row_numbers(messages, ["chat_id"], ["turn"], F.floor(F.col("turn") / 1000), "position")
    return chats.join(ordered, "chat_id")


def digest_targets(brands: DataFrame, integrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Brands with an active webhook, and the brands without one."""
    hooks = integrations.filter((F.col("integration_name") == "webhook") & F.col("is_active"))
    hooks = hooks.filter(F.coalesce("webhook_url", F.lit("")) != "")
    one = hooks.groupBy("profile_id").agg(F.min_by("webhook_url", "id").alias("webhook_url"))
    return brands.join(one, "profile_id"), brands.join(one, "profile_id", "left_anti")


def profiles_by_email(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Profiles whose contact email or account email is requested; two equi-joins, not an OR."""
    clean = lambda c: F.lower(F.trim(F.col(c)))
    asked = wanted.select(clean("email").alias("_email")).distinct()
    hits = [
        profiles.withColumn("_email", clean(c)).join(asked, "_email").withColumnRenamed("_email", "requested")
        for c in ("contact_email", "email")
    ]
    return hits[0].unionByName(hits[1]).dropDuplicates(["requested", "id"])


def site_search_requests(run_sites: DataFrame, run_keywords: DataFrame) -> DataFrame:
    """Search URLs per run: its sites with ``{keyword}`` patterns times its first keywords."""
    capped = top_per_key(run_keywords, ["run_id"], ["seq"], settings.MAX_KEYWORDS_PER_SITE)
    usable = run_sites.filter(F.col("search_url_pattern").contains("{keyword}"))
    return usable.join(capped, "run_id").select(
        "run_id", "domain", "keyword", queries.site_search_url("search_url_pattern", "keyword").alias("search_url")
    )


def rss_requests(run_keywords: DataFrame, languages: str = "languages") -> DataFrame:
    """Feed URLs per run keyword and locale attempt."""
    planned = run_keywords.select(
        "run_id", "keyword", F.posexplode(queries.rss_locale_attempts(languages)).alias("attempt", "locale")
    )
    return planned.select(
        "run_id", "keyword", "attempt", F.col("locale.language").alias("language"),
        queries.rss_search_url("keyword", "locale.hl", "locale.gl", "locale.ceid").alias("feed_url"),
    )


def distinct_keywords(df: DataFrame, scope: list[str], order: str = "seq") -> DataFrame:
    """Case-insensitive ordered keyword dedup; the first spelling stays."""
    trimmed = df.withColumn("keyword", F.trim("keyword")).filter(F.col("keyword") != "")
    keyed = trimmed.withColumn("_token", F.lower("keyword"))
    return top_per_key(keyed, [*scope, "_token"], [order], 1).drop("_token")


def cap_keywords(df: DataFrame, scope: list[str], limit: int, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """First ``limit`` keywords per scope, and how many each scope loses."""
    kept = top_per_key(df, scope, [order], limit)
    dropped = df.groupBy(*scope).agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("dropped"))
    return kept, dropped


def sanitized_keywords(df: DataFrame) -> DataFrame:
    return df.withColumn("keyword", text.sanitize("keyword")).filter(F.col("keyword") != "")
