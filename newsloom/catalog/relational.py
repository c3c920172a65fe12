"""Mention queries, joins, reports and digests over the role views."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.common import AS_OF, AS_OF_ORDERS, Roles, query, sql_with
from newsloom.operators import filters, joins
from newsloom.operators.ordered import top_per_key
from newsloom.plans import digests, reports
from newsloom.sinks import tables

STAMP = "yyyy-MM-dd HH:mm:ss"


def _stamp(column, alias=None):
    return F.date_format(column, STAMP).alias(alias or column)


@query("unread_by_topic_newest_week", sql_with("brands", "em") + """
    SELECT e.brand_id, e.topic, count(*) AS mentions, count(*) FILTER (WHERE NOT e.read_status) AS unread
    FROM em e WHERE e.brand_id IN (SELECT id FROM brands WHERE profile_id = '2')
      AND e.created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND e.published_at <= TIMESTAMP '2024-01-31'
    GROUP BY ALL""")
def unread_by_topic_newest_week(spark, folder):
    r = Roles(spark, folder)
    mine = joins.owned_by(filters.recent(r.em, AS_OF, 7), r.brands, "2")
    return reports.topic_breakdown(filters.published_between(mine, end=AS_OF), ["brand_id", "topic"])


@query("mentions_scoped_page", sql_with("brands", "mentions", "topics", "platforms") + """
    SELECT m.id, b.name AS brand, t.name AS topic, p.name AS platform, m.caption,
           strftime(m.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
    FROM mentions m LEFT JOIN brands b ON m.brand_id = b.id LEFT JOIN topics t ON m.topic_id = t.id
         LEFT JOIN platforms p ON m.platform_id = p.id
    WHERE m.brand_id IN (SELECT id FROM brands WHERE profile_id = '3')
      AND m.platform IN ('F', 'O') AND NOT m.read_status
      AND m.published_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'
    ORDER BY m.created_at DESC, m.id DESC LIMIT 50 OFFSET 20""")
def mentions_scoped_page(spark, folder):
    r = Roles(spark, folder)
    page = reports.mention_page(
        r.mentions, r.brands.select("id", "profile_id", "name"), r.topics, r.platforms, "3", skip=20, limit=50,
        start="1996-01-01", end="2000-12-31", platform=["F", "O"], read_status=False,
    )
    return page.select(
        "id", F.col("brand.name").alias("brand"), F.col("topic.name").alias("topic"),
        F.col("platform.name").alias("platform"), "caption", _stamp("created_at"),
    )


@query("mentions_by_topic_filter", sql_with("mentions") + """
    SELECT id, brand_id, topic_id, strftime(created_at, '%Y-%m-%d') AS created_day FROM mentions
    WHERE topic_id = 2 AND brand_id IN (3, 8, 13) AND NOT read_status""")
def mentions_by_topic_filter(spark, folder):
    found = filters.where_given(Roles(spark, folder).mentions, topic_id=2, brand_id=[3, 8, 13], read_status=False, platform=None)
    return found.select("id", "brand_id", "topic_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_day"))


@query("mention_lookback", sql_with("mentions") + """
    SELECT brand_id, count(*) AS mentions, min(id) AS first_id FROM mentions
    WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY GROUP BY brand_id""")
def mention_lookback(spark, folder):
    found = filters.recent(Roles(spark, folder).mentions, AS_OF_ORDERS, 30)
    return found.groupBy("brand_id").agg(F.count("*").alias("mentions"), F.min("id").alias("first_id"))


@query("mention_keyword_matches", sql_with("mentions", "keywords", "mention_keywords") + """
    , page AS (SELECT id FROM mentions),
    links AS (SELECT DISTINCT mention_id, keyword_id, matched_in, score FROM mention_keywords)
    SELECT p.id, coalesce(string_agg(l.keyword_id || ':' || k.text || ':' || l.matched_in, ';'
               ORDER BY l.keyword_id, k.text, l.matched_in), '') AS matches, count(l.keyword_id) AS n
    FROM page p LEFT JOIN links l ON l.mention_id = p.id LEFT JOIN keywords k ON k.id = l.keyword_id
    GROUP BY p.id""")
def mention_keyword_matches(spark, folder):
    r = Roles(spark, folder)
    page = r.mentions.select("id")
    nested = joins.with_keyword_matches(page, r.mention_keywords.distinct(), r.keywords)
    one = lambda m: F.concat_ws(":", m["keyword_id"].cast("string"), m["text"], m["matched_in"])
    return nested.select(
        "id", F.array_join(F.transform("keyword_matches", one), ";").alias("matches"),
        F.size("keyword_matches").cast("long").alias("n"),
    )


@query("relation_normalisation", sql_with("brands", "mentions", "topics") + """
    SELECT m.id, b.name AS brand_name, coalesce(t.name, 'N/A') AS topic_name,
           CASE WHEN m.read_status THEN 1 ELSE 2 END AS matches
    FROM mentions m LEFT JOIN brands b ON b.id = m.brand_id LEFT JOIN topics t ON t.id = m.topic_id AND t.id <> 5""")
def relation_normalisation(spark, folder):
    r = Roles(spark, folder)
    raw = joins.embed(r.mentions.select("id", "brand_id", "topic_id", "read_status"), r.brands.select("id", "name"), "brand_id", "brands")
    raw = joins.embed(raw, r.topics.filter("id <> 5"), "topic_id", "topics")
    match = lambda word: F.struct(word.alias("keyword"), F.lit("title").alias("matched_in"))
    second = F.when(~F.col("read_status"), F.lit("b"))
    raw = raw.withColumn("mention_keywords", F.array(match(F.lit("a")), match(second)))
    out = joins.normalize_relations(raw)
    return out.select(
        "id", F.col("brand.name").alias("brand_name"), F.coalesce("topic.name", F.lit("N/A")).alias("topic_name"),
        F.size("keyword_matches").alias("matches"),
    )


@query("historical_projection", sql_with("mentions") + """
    SELECT id, caption AS title, post_link AS link, content_teaser, coalesce(nullif(platform, 'P'), 'Unknown') AS platform
    FROM mentions WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAY""")
def historical_projection(spark, folder):
    r = Roles(spark, folder)
    known = r.platforms.filter("name <> 'P'").select(F.col("id").alias("platform_id"), F.col("name").alias("platform"))
    rows_ = filters.recent(r.mentions.drop("platform"), AS_OF_ORDERS, 60).join(known, "platform_id", "left")
    return rows_.select(
        "id", F.col("caption").alias("title"), F.col("post_link").alias("link"), "content_teaser",
        F.coalesce("platform", F.lit("Unknown")).alias("platform"),
    )


@query("due_brands", sql_with("brands") + """
    SELECT id, name FROM brands WHERE last_scraped_at IS NULL
      OR (epoch(TIMESTAMP '2024-01-31') - epoch(last_scraped_at)) / 3600 >= coalesce(nullif(scrape_frequency_hours, 0), 24)""")
def due_brands(spark, folder):
    return filters.due_for_scrape(Roles(spark, folder).brands, AS_OF).select("id", "name")


@query("active_brands", sql_with("brands") + """
    SELECT id, name FROM brands WHERE coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE is_active END, true)""")
def active_brands(spark, folder):
    flagged = Roles(spark, folder).brands.withColumn("is_active", F.when(F.col("id") % 4 != 0, F.col("is_active")))
    return filters.active(flagged).select("id", "name")


@query("brand_locks", sql_with("brands") + """
    SELECT id, CASE WHEN NOT scrape_in_progress THEN 'free'
        WHEN scrape_started_at < TIMESTAMP '2024-01-31' - INTERVAL 180 MINUTE THEN 'stale' ELSE 'active' END AS lock_state
    FROM brands""")
def brand_locks(spark, folder):
    return Roles(spark, folder).brands.select("id", filters.lock_state(AS_OF).alias("lock_state"))


@query("accessible_rows", sql_with("brands", "mentions") + """
    SELECT m.brand_id, count(*) AS owned_mentions FROM mentions m
    WHERE EXISTS (SELECT 1 FROM brands b WHERE b.id = m.brand_id AND b.profile_id = '1') GROUP BY 1""")
def accessible_rows(spark, folder):
    r = Roles(spark, folder)
    return joins.owned_by(r.mentions, r.brands, "1").groupBy("brand_id").agg(F.count("*").alias("owned_mentions"))


@query("accessible_rows_admin", sql_with("mentions") + """
    SELECT brand_id, count(*) AS owned_mentions FROM mentions GROUP BY 1""")
def accessible_rows_admin(spark, folder):
    r = Roles(spark, folder)
    return joins.owned_by(r.mentions, r.brands, "1", admin=True).groupBy("brand_id").agg(F.count("*").alias("owned_mentions"))


@query("accessible_topic_keywords", sql_with("brands", "taxonomy_topics", "topic_keywords") + """
    SELECT topic_id, count(*) AS keywords FROM topic_keywords WHERE topic_id IN (
        SELECT id FROM taxonomy_topics WHERE brand_id IN (SELECT id FROM brands WHERE profile_id = '4')) GROUP BY 1""")
def accessible_topic_keywords(spark, folder):
    r = Roles(spark, folder)
    mine = joins.owned_through_topic(r.topic_keywords, r.taxonomy_topics, r.brands, "4")
    return mine.groupBy("topic_id").agg(F.count("*").alias("keywords"))


@query("taxonomy_flat", sql_with("taxonomy_topics", "topic_keywords", "keywords") + """
    SELECT t.brand_id, t.id AS topic_id, t.name AS topic, k.id AS keyword_id, k.text AS keyword
    FROM topic_keywords tk JOIN taxonomy_topics t ON t.id = tk.topic_id JOIN keywords k ON k.id = tk.keyword_id""")
def taxonomy_flat(spark, folder):
    r = Roles(spark, folder)
    return joins.topic_keywords(r.taxonomy_topics, r.topic_keywords, r.keywords)


@query("taxonomy_tree_counts", sql_with("brands", "taxonomy_topics", "topic_keywords") + """
    SELECT b.id, count(DISTINCT t.id) AS topics, count(tk.keyword_id) AS keywords
    FROM brands b LEFT JOIN taxonomy_topics t ON t.brand_id = b.id LEFT JOIN topic_keywords tk ON tk.topic_id = t.id
    GROUP BY 1""")
def taxonomy_tree_counts(spark, folder):
    r = Roles(spark, folder)
    return joins.taxonomy_counts(r.brands.select("id"), r.taxonomy_topics.select("id", "brand_id", "name"), r.topic_keywords, r.keywords)


@query("user_keyword_texts", sql_with("brands", "taxonomy_topics", "topic_keywords", "keywords") + """
    SELECT DISTINCT b.profile_id, k.text AS keyword FROM topic_keywords tk JOIN taxonomy_topics t ON t.id = tk.topic_id
    JOIN keywords k ON k.id = tk.keyword_id JOIN brands b ON b.id = t.brand_id WHERE t.is_active""")
def user_keyword_texts(spark, folder):
    r = Roles(spark, folder)
    return joins.user_keywords(r.brands, r.taxonomy_topics, r.topic_keywords, r.keywords)


@query("keyword_usage_by_topic", sql_with("topic_keywords", "mention_keywords") + """
    SELECT tk.topic_id, mk.matched_in, count(*) AS matches, count(DISTINCT mk.mention_id) AS mentions
    FROM mention_keywords mk JOIN topic_keywords tk ON tk.keyword_id = mk.keyword_id GROUP BY 1, 2""")
def keyword_usage_by_topic(spark, folder):
    r = Roles(spark, folder)
    return r.mention_keywords.join(r.topic_keywords, "keyword_id").groupBy("topic_id", "matched_in").agg(
        F.count("*").alias("matches"), F.count_distinct("mention_id").alias("mentions")
    )


@query("mentions_by_keys", sql_with("mentions") + """
    SELECT id, post_link, topic_id FROM mentions
    WHERE brand_id = 4 AND (post_link, topic_id) IN (SELECT post_link, topic_id FROM mentions WHERE NOT notified_status)""")
def mentions_by_keys(spark, folder):
    stored = Roles(spark, folder).mentions
    wanted = stored.filter("not notified_status").select("post_link", "topic_id")
    return joins.by_keys(stored.filter("brand_id = 4"), wanted).select("id", "post_link", "topic_id")


@query("insert_ignore_batch", sql_with("mentions") + """
    , batch AS (SELECT id, id // 2 AS pair, 'https://x.dk/' || (id // 2) AS post_link, topic_id FROM mentions),
    stored AS (SELECT 'https://x.dk/' || id AS post_link, topic_id FROM mentions WHERE id % 5 = 0),
    last AS (SELECT *, row_number() OVER (PARTITION BY post_link, topic_id ORDER BY id DESC) AS rn FROM batch)
    SELECT id, post_link, topic_id FROM last WHERE rn = 1
      AND (post_link, topic_id) NOT IN (SELECT post_link, topic_id FROM stored)""")
def insert_ignore_batch(spark, folder):
    m = Roles(spark, folder).mentions
    link = F.concat(F.lit("https://x.dk/"), F.floor(F.col("id") / 2).cast("string"))
    batch = m.select("id", F.col("id").alias("seq"), link.alias("post_link"), "topic_id")
    stored = m.filter("id % 5 = 0").select(F.concat(F.lit("https://x.dk/"), F.col("id").cast("string")).alias("post_link"), "topic_id")
    return tables.new_rows(batch, stored, ["post_link", "topic_id"]).select("id", "post_link", "topic_id")


@query("keyword_links_insert_ignore", sql_with("mention_keywords") + """
    SELECT DISTINCT mention_id, keyword_id FROM mention_keywords WHERE keyword_id % 10 <> 0
    EXCEPT SELECT mention_id, keyword_id FROM mention_keywords WHERE mention_id % 2 = 0""")
def keyword_links_insert_ignore(spark, folder):
    links = Roles(spark, folder).mention_keywords
    batch = links.withColumn("keyword_id", F.when(F.col("keyword_id") % 10 != 0, F.col("keyword_id"))).withColumn("seq", F.lit(0))
    stored = links.filter("mention_id % 2 = 0").select("mention_id", "keyword_id")
    return tables.new_rows(batch, stored, ["mention_id", "keyword_id"]).select("mention_id", "keyword_id")


@query("keyed_insert_ignore", sql_with("mentions") + """
    , batch AS (SELECT id, 'https://x.dk/' || (id // 2) AS post_link, topic_id, id % 3 AS part FROM mentions),
    last AS (SELECT *, row_number() OVER (PARTITION BY post_link, topic_id ORDER BY part, id DESC) AS rn FROM batch)
    SELECT id AS seq, post_link, topic_id, TRUE AS unique_id, TRUE AS found FROM last WHERE rn = 1""")
def keyed_insert_ignore(spark, folder):
    """Three batches through the key table, the second twice; of a key the last row of the first batch that has it stays."""
    from newsloom.schemas import MENTION
    from newsloom.session import shared_folder
    from newsloom.sinks import keyed

    path, keys = f"{shared_folder(spark)}/mentions", ["post_link", "topic_id"]
    link = F.concat(F.lit("https://x.dk/"), F.floor(F.col("id") / 2).cast("string"))
    rows = Roles(spark, folder).mentions.selectExpr(
        "id as seq", "cast(id as string) as caption", "'' as content_teaser", "published_at", "platform_id", "brand_id", "topic_id",
        "cast(null as bigint) as primary_keyword_id", "false as read_status", "false as notified_status", "id",
    ).withColumn("post_link", link)
    for part in (0, 1, 1, 2):
        batch = rows.filter(F.col("id") % 3 == part).drop("id")
        keyed.insert_ignore(spark, batch, path, MENTION, keys, F.lit(AS_OF).cast("timestamp"), "created_date", buckets=8)
    stored = spark.read.schema(MENTION).parquet(path)
    found = keyed.ids_of(spark, path, stored.select(*keys, F.col("id").alias("own")), keys, buckets=8)
    checked = stored.join(found.select(*keys, (F.col("own") == F.col("id")).alias("found")), keys)
    counts = stored.groupBy("id").agg((F.count("*") == 1).alias("unique_id"))
    return checked.join(counts, "id").select(F.col("caption").cast("long").alias("seq"), *keys, "unique_id", "found")


@query("config_upsert", """
    WITH old AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS domain FROM pages),
    o AS (SELECT DISTINCT regexp_replace(domain, '^www\\.', '') AS domain FROM old),
    a AS (SELECT domain, 'h1' AS title_selector, 'https://' || domain || '/s?q={keyword}' AS search_url_pattern FROM o WHERE length(domain) % 3 <> 0),
    n AS (SELECT domain, CASE WHEN length(domain) % 2 = 0 THEN 'article h1' END AS title_selector,
                 CASE WHEN length(domain) % 4 = 0 THEN 'https://' || domain || '/find/{keyword}' END AS search_url_pattern
          FROM o WHERE length(domain) % 5 <> 0)
    SELECT coalesce(n.domain, a.domain) AS domain, coalesce(n.title_selector, a.title_selector, '-') AS title_selector,
           coalesce(CASE WHEN n.domain IS NOT NULL THEN n.search_url_pattern ELSE a.search_url_pattern END, '-') AS search_url_pattern
    FROM a FULL OUTER JOIN n ON a.domain = n.domain""")
def config_upsert(spark, folder):
    host = F.regexp_replace(F.regexp_extract("url", "://([^/]+)", 1), r"^www\.", "")
    domains = Roles(spark, folder).table("pages", "url").select(host.alias("domain")).distinct()
    size = F.length("domain")
    current = domains.filter(size % 3 != 0).select(
        "domain", F.lit("h1").alias("title_selector"),
        F.concat(F.lit("https://"), "domain", F.lit("/s?q={keyword}")).alias("search_url_pattern"),
    )
    incoming = domains.filter(size % 5 != 0).select(
        F.concat(F.lit("https://www."), "domain", F.lit("/")).alias("domain"),
        F.when(size % 2 == 0, F.lit("article h1")).alias("title_selector"),
        F.when(size % 4 == 0, F.concat(F.lit("https://"), "domain", F.lit("/find/{keyword}"))).alias("search_url_pattern"),
    )
    merged = tables.merge_source_configs(current, incoming)
    return merged.select("domain", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("title_selector", "search_url_pattern")])


@query("mark_sent", sql_with("mentions") + """
    SELECT brand_id, count(*) FILTER (WHERE notified_status OR id % 6 = 1) AS sent, count(*) AS mentions
    FROM mentions GROUP BY 1""")
def mark_sent(spark, folder):
    m = Roles(spark, folder).mentions
    updated = tables.update_by_keys(m, m.filter("id % 6 = 1"), "id", notified_status=True)
    return updated.groupBy("brand_id").agg(F.count_if("notified_status").alias("sent"), F.count("*").alias("mentions"))


@query("cascade_delete_counts", sql_with("brands", "mentions", "mention_keywords") + """
    , b AS (SELECT id FROM brands WHERE profile_id = '1'), m AS (SELECT id FROM mentions WHERE brand_id IN (SELECT id FROM b)),
    k AS (SELECT * FROM mention_keywords WHERE mention_id IN (SELECT id FROM m))
    SELECT 'brands' AS table_name, count(*) AS rows FROM b UNION ALL SELECT 'mentions', count(*) FROM m
    UNION ALL SELECT 'mention_keywords', count(*) FROM k""")
def cascade_delete_counts(spark, folder):
    r = Roles(spark, folder)
    content = {"brands": r.brands, "mentions": r.mentions, "mention_keywords": r.mention_keywords}
    doomed = r.brands.filter("profile_id = '1'").select("id")
    _, gone = tables.cascade(
        content, "brands", doomed,
        [("mentions", "brand_id", "brands", "id"), ("mention_keywords", "mention_id", "mentions", "id")],
    )
    return tables.deletion_counts(gone)


@query("missing_keyword_texts", """
    SELECT DISTINCT trim(p_type || ' ' || p_name) AS text FROM part
    EXCEPT SELECT p_type || ' ' || p_name FROM part WHERE p_size < 20""")
def missing_keyword_texts(spark, folder):
    part = Roles(spark, folder).table("part", "p_type", "p_name", "p_size")
    named = part.withColumn("text", F.concat_ws(" ", "p_type", "p_name"))
    return tables.missing_dimension_rows(named, "text", named.filter("p_size < 20"), "text")


@query("get_or_create_platforms", """
    WITH known AS (SELECT DISTINCT source AS name FROM documents WHERE doc_id % 7 = 0 AND length(source) = 4),
    missing AS (SELECT DISTINCT source AS name FROM documents EXCEPT SELECT name FROM known)
    SELECT count(*) AS platforms, count(DISTINCT id) AS ids, max(id) AS top_id FROM (
        SELECT row_number() OVER (ORDER BY 1) AS id, name FROM known
        UNION ALL SELECT (SELECT count(*) FROM known) + row_number() OVER (ORDER BY 1), name FROM missing)""")
def get_or_create_platforms(spark, folder):
    docs = Roles(spark, folder).table("documents", "doc_id", "source")
    known = tables.with_ids(docs.filter("doc_id % 7 = 0 and length(source) = 4").select(F.col("source").alias("name")).distinct(), 0)
    _, complete = tables.get_or_create(known, docs, "source")
    return complete.agg(
        F.count("*").alias("platforms"), F.count_distinct("id").alias("ids"), F.max("id").cast("long").alias("top_id")
    )


@query("jobs_with_sites", """
    WITH j AS (SELECT s_suppkey AS id, s_nationkey AS brand_id FROM supplier),
    js AS (SELECT DISTINCT l_suppkey AS job, l_partkey AS site, l_partkey % 3 = 0 AS is_active FROM lineitem),
    s AS (SELECT p_partkey AS id, p_name AS name, p_type AS category FROM part)
    SELECT j.id, n.n_name AS brand_name, count(s.id) AS active_sites, coalesce(min(s.id), -1) AS first_site,
           coalesce(arg_min(s.name, s.id), '') AS first_name
    FROM j JOIN nation n ON n.n_nationkey = j.brand_id LEFT JOIN js ON js.job = j.id AND js.is_active LEFT JOIN s ON s.id = js.site
    GROUP BY ALL""")
def jobs_with_sites(spark, folder):
    r = Roles(spark, folder)
    jobs = r.table("supplier", "s_suppkey", "s_nationkey").selectExpr("s_suppkey as id", "cast(s_nationkey as bigint) as topic_id")
    topics = r.brands.selectExpr("id", "name", "id as brand_id")
    sites = r.table("part", "p_partkey", "p_name", "p_type").selectExpr("p_partkey as id", "p_name as name", "p_type as category")
    used = r.table("lineitem", "l_suppkey", "l_partkey")
    job_sites = used.selectExpr("l_suppkey as scraping_job_id", "l_partkey as scrapable_site_id", "l_partkey % 3 = 0 as is_active").distinct()
    rows = joins.job_site_rows(jobs, topics, r.brands.select("id", "name"), job_sites, sites)
    return rows.groupBy("id", "brand_name").agg(
        F.count("site_id").alias("active_sites"), F.coalesce(F.min("site_id"), F.lit(-1)).alias("first_site"),
        F.coalesce(F.min_by("site_name", "site_id"), F.lit("")).alias("first_name"),
    )


@query("site_usage", """
    SELECT p_partkey AS id, p_name AS name, count(l_suppkey) AS job_usage_count,
           count(*) FILTER (WHERE l_linestatus = 'O') AS active_job_count
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY ALL""")
def site_usage(spark, folder):
    r = Roles(spark, folder)
    sites = r.table("part", "p_partkey", "p_name", "p_size").selectExpr("p_partkey as id", "p_name as name", "p_size > 10 as is_active")
    used = r.table("lineitem", "l_partkey", "l_suppkey", "l_linestatus")
    links = used.selectExpr("l_partkey as scrapable_site_id", "l_suppkey as scraping_job_id", "l_linestatus = 'O' as is_active")
    return joins.site_usage(sites, links).drop("is_active")


@query("resolve_brand_names", sql_with("brands") + """
    SELECT c.c_custkey AS request_id, coalesce(min(b.id), -1) AS brand_id
    FROM customer c LEFT JOIN brands b ON lower(trim('  nation_' || (c_custkey % 30) || ' ')) = lower(trim(b.name))
    GROUP BY 1""")
def resolve_brand_names(spark, folder):
    r = Roles(spark, folder)
    asked = r.table("customer", "c_custkey").selectExpr("c_custkey as request_id", "'  nation_' || (c_custkey % 30) || ' ' as brand_name")
    return joins.resolve_names(asked, r.brands).select("request_id", F.coalesce("brand_id", F.lit(-1)).alias("brand_id"))


@query("reports_with_brand", sql_with("brands") + """
    SELECT conv_id AS id, CAST(conv_id % 5 AS VARCHAR) AS user_id, coalesce(b.name, 'none') AS brand,
           CASE conv_id % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'crisis' WHEN 2 THEN 'summary' ELSE 'custom' END AS report_type
    FROM conversations c LEFT JOIN brands b ON b.id = CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id % 25 END
    WHERE turn = 0 AND conv_id % 5 <> 4""")
def reports_with_brand(spark, folder):
    r = Roles(spark, folder)
    kinds = "element_at(array('weekly', 'crisis', 'summary', 'custom', 'daily'), cast(case when conv_id % 5 = 4 then 5 else conv_id % 4 + 1 end as int))"
    drafts = r.table("conversations").filter("turn = 0").selectExpr(
        "conv_id as id", "cast(conv_id % 5 as string) as user_id",
        "case when conv_id % 3 = 0 then null else conv_id % 25 end as brand_id", f"{kinds} as report_type",
    )
    accepted, _ = reports.valid_reports(drafts)
    named = accepted.join(r.brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand")), "brand_id", "left")
    return named.select("id", "user_id", F.coalesce("brand", F.lit("none")).alias("brand"), "report_type")


@query("chat_messages_numbered", """
    SELECT conv_id AS id, left(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn), 30) AS title, turn, role,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations
    QUALIFY min(turn) OVER (PARTITION BY conv_id) = 0""")
def chat_messages_numbered(spark, folder):
    r = Roles(spark, folder)
    chats = r.chats.withColumnRenamed("id", "chat_id")
    numbered = joins.numbered_messages(chats, r.messages.select("chat_id", "turn", "role"))
    return numbered.select(F.col("chat_id").alias("id"), "title", "turn", "role", F.col("position").cast("long").alias("position"))


@query("digest_targets", sql_with("brands") + """
    SELECT b.id AS brand_id, CASE WHEN b.profile_id IN ('0', '2', '4') THEN 'https://hooks.example.com/' || b.profile_id ELSE 'missing' END AS target
    FROM brands b""")
def digest_targets(spark, folder):
    r = Roles(spark, folder)
    hooks = r.profiles.selectExpr(
        "cast(id as bigint) as id", "id as profile_id", "case when id = '1' then 'email' else 'webhook' end as integration_name",
        "'https://hooks.example.com/' || id as webhook_url", "id <> '3' as is_active",
    )
    ready, missing = joins.digest_targets(r.brands.select("id", "profile_id"), hooks)
    columns = lambda df, target: df.select(F.col("id").alias("brand_id"), target.alias("target"))
    return columns(ready, F.col("webhook_url")).unionByName(columns(missing, F.lit("missing")))


@query("profiles_by_email", sql_with("profiles") + """
    , asked AS (SELECT DISTINCT lower(trim(CASE WHEN s_suppkey % 2 = 0 THEN 'PRESS@' || r_name || '.example.com' ELSE r_name || '@Example.com ' END)) AS email
               FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT DISTINCT a.email AS requested, p.id FROM asked a JOIN profiles p
      ON a.email = lower(trim(p.contact_email)) OR a.email = lower(trim(p.email))""")
def profiles_by_email(spark, folder):
    r = Roles(spark, folder)
    suppliers = r.table("supplier", "s_suppkey", "s_nationkey").join(r.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named = suppliers.join(r.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = named.selectExpr("case when s_suppkey % 2 = 0 then 'PRESS@' || r_name || '.example.com' else r_name || '@Example.com ' end as email")
    return joins.profiles_by_email(r.profiles, asked).select("requested", "id")


@query("topic_unread_breakdown", sql_with("em") + """
    SELECT topic, count(*) AS mentions, count(*) FILTER (WHERE NOT read_status) AS unread FROM em GROUP BY 1""")
def topic_unread_breakdown(spark, folder):
    return reports.topic_breakdown(Roles(spark, folder).em, ["topic"])


@query("platform_distribution", sql_with("em") + """
    SELECT coalesce(platform, 'N/A') AS platform, count(*) AS mentions FROM em GROUP BY 1""")
def platform_distribution(spark, folder):
    return reports.distribution(Roles(spark, folder).em, "platform")


@query("daily_activity_last7", sql_with("em") + """
    SELECT strftime(published_at, '%Y-%m-%d') AS day, count(*) AS mentions FROM em GROUP BY 1 ORDER BY 1 DESC LIMIT 7""")
def daily_activity_last7(spark, folder):
    return reports.daily_activity(Roles(spark, folder).em)


@query("report_grouping_sets", sql_with("em") + """
    SELECT 'topic' AS kind, topic AS name, count(*) AS mentions, count(*) FILTER (WHERE NOT read_status) AS unread FROM em GROUP BY 2
    UNION ALL SELECT 'platform', coalesce(platform, 'N/A'), count(*), count(*) FILTER (WHERE NOT read_status) FROM em GROUP BY 2
    UNION ALL SELECT 'day', strftime(published_at, '%Y-%m-%d'), count(*), count(*) FILTER (WHERE NOT read_status) FROM em GROUP BY 2""")
def report_grouping_sets(spark, folder):
    return reports.grouped_report(Roles(spark, folder).em)


@query("brand_profile", sql_with("mentions") + """
    SELECT brand_id, 'brand' AS kind, '' AS name, count(*) AS mentions, count(*) FILTER (WHERE NOT read_status) AS unread FROM mentions GROUP BY 1
    UNION ALL SELECT brand_id, 'topic', topic, count(*), count(*) FILTER (WHERE NOT read_status) FROM mentions GROUP BY 1, 3
    UNION ALL SELECT brand_id, 'platform', platform, count(*), count(*) FILTER (WHERE NOT read_status) FROM mentions GROUP BY 1, 3""")
def brand_profile(spark, folder):
    return reports.brand_profile(Roles(spark, folder).mentions)


@query("brand_samples", sql_with("em") + """
    SELECT brand_id, id, rank, caption FROM (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY created_at DESC, id DESC) AS rank FROM em)
    WHERE rank <= 3""")
def brand_samples(spark, folder):
    shown = reports.samples(Roles(spark, folder).em)
    return shown.select("brand_id", "id", F.col("rank").cast("long").alias("rank"), "caption")


@query("brand_compare_share", sql_with("em", "brands") + """
    SELECT b.name, count(*) AS mentions, round(count(*) / sum(count(*)) OVER (), 4) AS share
    FROM em JOIN brands b ON b.id = em.brand_id GROUP BY 1""")
def brand_compare_share(spark, folder):
    r = Roles(spark, folder)
    shares = reports.share_of_attention(r.em)
    return shares.join(r.brands.select(F.col("id").alias("brand_id"), "name"), "brand_id").select("name", "mentions", "share")


_ADAPTIVE = """
    , c AS (SELECT brand_id, least(count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL {d} DAY), {l}) AS n0,
                   least(count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL {d} DAY), {l2}) AS n1,
                   least(count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL {d2} DAY), {l3}) AS n2
            FROM {src} WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL {d2} DAY GROUP BY 1),
    w AS (SELECT brand_id, CASE WHEN n0 >= 20 THEN 0 WHEN n1 >= 20 THEN CASE WHEN n1 > n0 THEN 1 ELSE 0 END
                     WHEN n2 > greatest(n0, n1) THEN 2 WHEN n1 > n0 THEN 1 ELSE 0 END AS pick, n0, n1, n2 FROM c),
    aw AS (SELECT brand_id, CASE pick WHEN 2 THEN {d2} ELSE {d} END AS effective_days,
                  CASE pick WHEN 0 THEN {l} WHEN 1 THEN {l2} ELSE {l3} END AS effective_limit,
                  CASE pick WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS rows FROM w)
"""


def _adaptive(days, limit, src="em"):
    plan = reports.attempt_plan(days, limit)
    return _ADAPTIVE.format(d=plan[0][0], l=plan[0][1], l2=plan[1][1], d2=plan[2][0], l3=plan[2][1], src=src)


@query("adaptive_window", sql_with("em") + _adaptive(1, 15) + "SELECT * FROM aw")
def adaptive_window(spark, folder):
    return reports.adaptive_window(Roles(spark, folder).em, AS_OF, 1, 15)


@query("adaptive_rows", sql_with("em") + _adaptive(2, 12) + """
    , r AS (SELECT em.brand_id, em.id, effective_limit, row_number() OVER (PARTITION BY em.brand_id ORDER BY created_at DESC, id DESC) AS rank
            FROM em JOIN aw ON aw.brand_id = em.brand_id WHERE created_at >= TIMESTAMP '2024-01-31' - to_days(CAST(effective_days AS INTEGER)))
    SELECT brand_id, id, rank FROM r WHERE rank <= effective_limit""")
def adaptive_rows(spark, folder):
    found = reports.adaptive_rows(Roles(spark, folder).em, AS_OF, 2, 12)
    return found.select("brand_id", "id", F.col("rank").cast("long").alias("rank"))


@query("compare_two_brands", sql_with("em", "brands") + """
    , two AS (SELECT em.* FROM em JOIN brands b ON b.id = em.brand_id WHERE lower(b.name) IN ('nation_3', 'nation_11'))
    """ + _adaptive(7, 50, "two") + """
    , v AS (SELECT aw.brand_id, effective_days, effective_limit, rows, count(*) AS in_window FROM aw JOIN two t ON t.brand_id = aw.brand_id
            WHERE t.created_at >= TIMESTAMP '2024-01-31' - to_days(CAST(effective_days AS INTEGER)) GROUP BY ALL)
    SELECT b.name, effective_days, effective_limit, rows AS shown, in_window AS mentions, round(in_window / sum(in_window) OVER (), 4) AS share
    FROM v JOIN brands b ON b.id = v.brand_id""")
def compare_two_brands(spark, folder):
    r = Roles(spark, folder)
    return reports.compare_brands(r.em, r.brands, [" nation_3", "NATION_11"], AS_OF)


@query("brand_trend", sql_with("em") + """
    SELECT brand_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS mentions, count(*) FILTER (WHERE NOT read_status) AS unread
    FROM em GROUP BY ALL""")
def brand_trend(spark, folder):
    return reports.trend(Roles(spark, folder).em, ["brand_id"])


@query("monitoring_status", sql_with("mentions") + """
    SELECT count(*) AS total, count(*) FILTER (WHERE NOT read_status) AS unread, count(DISTINCT brand_id) AS brands FROM mentions""")
def monitoring_status(spark, folder):
    return reports.monitoring_status(Roles(spark, folder).mentions)


@query("mention_display_lines", sql_with("em") + r"""
    SELECT id, '- Mention #' || id || ' | ' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || ' | Topic: ' || topic || ' | Platform: '
        || coalesce(platform, 'N/A') || chr(10) || '  Text: ' ||
        left(CASE WHEN lower(content_teaser) <> lower(caption) THEN caption || ' ' || content_teaser ELSE caption END, 420) AS line
    FROM em""")
def mention_display_lines(spark, folder):
    return reports.mention_lines(Roles(spark, folder).em).select("id", "line")


@query("report_text_lines", sql_with("em") + """
    , one AS (SELECT * FROM em WHERE brand_id = 6),
    t AS (SELECT topic, count(*) AS n, count(*) FILTER (WHERE NOT read_status) AS u FROM one GROUP BY 1),
    p AS (SELECT coalesce(platform, 'N/A') AS platform, count(*) AS n FROM one GROUP BY 1),
    d AS (SELECT strftime(published_at, '%Y-%m-%d') AS day, count(*) AS n FROM one GROUP BY 1 ORDER BY 1 DESC LIMIT 7),
    s AS (SELECT * FROM one ORDER BY created_at DESC, id DESC LIMIT 15)
    SELECT '1 topics' AS section, row_number() OVER (ORDER BY n DESC, topic) AS position, '  • ' || topic || ': ' || n || ' mentions (' || u || ' unread)' AS line FROM t
    UNION ALL SELECT '2 platforms', row_number() OVER (ORDER BY n DESC, platform), '  • ' || platform || ': ' || n || ' mentions' FROM p
    UNION ALL SELECT '3 days', row_number() OVER (ORDER BY day DESC), '  • ' || day || ': ' || n || ' mentions' FROM d
    UNION ALL SELECT '4 samples', row_number() OVER (ORDER BY created_at DESC, id DESC),
        '[' || topic || '] ' || coalesce(platform, 'N/A') || ' - ' || strftime(published_at, '%Y-%m-%d') || ' ' || left(caption, 150) || '...' FROM s""")
def report_text_lines(spark, folder):
    mine = filters.where_given(Roles(spark, folder).em, brand_id=6).withColumn("platform", F.coalesce("platform", F.lit("N/A")))
    return reports.report_lines(mine).withColumn("position", F.col("position").cast("long"))


@query("unsent_digest_counts", sql_with("em") + """
    SELECT brand_id, CASE WHEN topic = 'view' THEN 'Uncategorized' ELSE topic END AS topic, count(*) AS mentions,
           strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_created, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_created
    FROM em WHERE NOT notified_status GROUP BY 1, 2""")
def unsent_digest_counts(spark, folder):
    em = Roles(spark, folder).em.withColumn("topic", F.nullif("topic", F.lit("view")))
    return digests.topic_counts(em).select("brand_id", "topic", "mentions", _stamp("first_created"), _stamp("last_created"))


@query("digest_blocks", sql_with("em", "brands") + """
    , u AS (SELECT *, row_number() OVER (PARTITION BY brand_id, topic ORDER BY created_at, id) AS position,
                   '• <' || post_link || '|' || caption || '> (' || coalesce(platform, 'Unknown') || ')' AS bullet
            FROM em WHERE NOT notified_status),
    body AS (SELECT brand_id, 2 AS part, topic, (position - 1) // 20 AS block, string_agg(bullet, chr(10) ORDER BY position) AS text FROM u GROUP BY brand_id, topic, (position - 1) // 20),
    head AS (SELECT brand_id, 2 AS part, topic, CAST(-1 AS BIGINT) AS block, '*📂 ' || topic || '* (' || count(*) || ' mentions)' AS text FROM u GROUP BY brand_id, topic),
    top AS (SELECT u.brand_id, 0 AS part, '' AS topic, CAST(0 AS BIGINT) AS block,
                   '🔔 *New Media Mentions for ' || b.name || '*' || chr(10) || '_' || count(*) || ' new mentions found_' AS text
            FROM u JOIN brands b ON b.id = u.brand_id GROUP BY u.brand_id, b.name),
    line AS (SELECT brand_id, 1 AS part, '' AS topic, CAST(0 AS BIGINT) AS block, 'divider' AS text FROM top),
    foot AS (SELECT brand_id, 3 AS part, '' AS topic, CAST(0 AS BIGINT) AS block, 'Automated digest' AS text FROM top)
    SELECT * FROM body UNION ALL SELECT * FROM head UNION ALL SELECT * FROM top UNION ALL SELECT * FROM line UNION ALL SELECT * FROM foot""")
def digest_blocks(spark, folder):
    r = Roles(spark, folder)
    blocks = digests.digest_blocks(r.em, r.brands, "Automated digest")
    shape = "type string, text struct<type:string,text:string>, elements array<struct<type:string,text:string>>"
    parsed = F.from_json("json", shape)
    text = F.coalesce(parsed["text"]["text"], F.get(parsed["elements"], F.lit(0))["text"], parsed["type"])
    return blocks.select("brand_id", "part", "topic", "block", text.alias("text"))


@query("user_run_rollup", """
    WITH runs AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'not_found' ELSE 'success' END AS status,
                         event_id % 10 AS found, event_id % 4 AS saved, CASE WHEN event_type = 'error' THEN props END AS error FROM events)
    SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE status IN ('error', 'not_found')) AS failed,
           CAST(sum(found) AS BIGINT) AS found, CAST(sum(saved) AS BIGINT) AS saved, count(error) AS errors FROM runs GROUP BY 1""")
def user_run_rollup(spark, folder):
    return reports.run_rollup(_runs(spark, folder), "user_id")


def _runs(spark, folder):
    return Roles(spark, folder).table("events").selectExpr(
        "user_id", "case event_type when 'error' then 'error' when 'signup' then 'not_found' else 'success' end as status",
        "event_id % 10 as found", "event_id % 4 as saved", "case when event_type = 'error' then props end as error",
    )


@query("scheduler_summary", """
    SELECT count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS successful,
           count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS failed,
           CAST(sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN event_id % 4 END) AS BIGINT) AS saved FROM events""")
def scheduler_summary(spark, folder):
    return reports.scheduler_summary(_runs(spark, folder))


@query("last_turns", """
    SELECT conv_id AS chat_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6""")
def last_turns(spark, folder):
    return reports.last_turns(Roles(spark, folder).messages).select("chat_id", "turn", "role")


@query("chat_titles", """
    SELECT conv_id AS chat_id, turn, CASE WHEN length(text) > 30 THEN left(text, 30) || '...' ELSE text END AS title FROM conversations WHERE role = 'user'""")
def chat_titles(spark, folder):
    from newsloom.functions.text import chat_title

    first = Roles(spark, folder).messages.filter("role = 'user'")
    return first.select("chat_id", "turn", chat_title("text").alias("title"))


@query("tools_in_first_use_order", """
    WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL)
    SELECT conv_id AS run_id, string_agg(role, ',' ORDER BY first, role) AS tools FROM f GROUP BY 1""")
def tools_in_first_use_order(spark, folder):
    log = Roles(spark, folder).table("conversations", "conv_id", "turn", "role")
    used = reports.tools_used(log.selectExpr("conv_id as run_id", "turn as seq", "role as tool_name"))
    return used.select("run_id", F.array_join("tools", ",").alias("tools"))


@query("chat_list_latest", """
    SELECT conv_id AS chat_id, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def chat_list_latest(spark, folder):
    chats = Roles(spark, folder).table("conversations", "conv_id", "turn").groupBy(F.col("conv_id").alias("chat_id"))
    return chats.agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "chat_id")


@query("first_spelling_keywords", """
    WITH k AS (SELECT o_orderkey AS seq, o_custkey AS run_id, trim(CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END) AS keyword FROM orders)
    SELECT run_id, keyword, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id, lower(keyword) ORDER BY seq) AS rn FROM k) WHERE rn = 1""")
def first_spelling_keywords(spark, folder):
    asked = Roles(spark, folder).table("orders", "o_orderkey", "o_custkey", "o_orderpriority").selectExpr(
        "o_orderkey as seq", "o_custkey as run_id",
        "case when o_orderkey % 2 = 0 then upper(o_orderpriority) else ' ' || lower(o_orderpriority) end as keyword",
    )
    return joins.distinct_keywords(asked, ["run_id"]).select("run_id", "keyword", "seq")


@query("capped_keywords", """
    WITH k AS (SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS seq, count(*) OVER (PARTITION BY l_suppkey) AS n,
                      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM lineitem)
    SELECT run_id, seq, greatest(n - 50, 0) AS dropped FROM k WHERE rn <= 50""")
def capped_keywords(spark, folder):
    from newsloom import settings

    asked = Roles(spark, folder).table("lineitem", "l_suppkey", "l_orderkey", "l_linenumber").selectExpr(
        "l_suppkey as run_id", "l_orderkey * 10 + l_linenumber as seq"
    )
    kept, dropped = joins.cap_keywords(asked, ["run_id"], settings.MAX_KEYWORDS_PER_RUN)
    return kept.join(dropped, "run_id").select("run_id", "seq", F.col("dropped").cast("long").alias("dropped"))


@query("distinct_platform_sets", """
    SELECT 'platform' AS kind, source AS name FROM documents GROUP BY 2 UNION ALL SELECT 'keyword', p_name FROM part GROUP BY 2""")
def distinct_platform_sets(spark, folder):
    r = Roles(spark, folder)
    platforms = r.table("documents", "source").distinct().select(F.lit("platform").alias("kind"), F.col("source").alias("name"))
    words = r.table("part", "p_name").distinct().select(F.lit("keyword").alias("kind"), F.col("p_name").alias("name"))
    return platforms.unionByName(words)


@query("requested_key_intersection", """
    SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def requested_key_intersection(spark, folder):
    orders = Roles(spark, folder).table("orders", "o_custkey", "o_orderstatus")
    side = lambda s: orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"))
    return side("F").intersect(side("P"))


@query("history_window", sql_with("em") + """
    SELECT brand_id, id FROM (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY created_at DESC, id DESC) AS rn FROM em
        WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 3 DAY) WHERE rn <= 10""")
def history_window(spark, folder):
    from newsloom.operators.dedup import recent_history

    em = Roles(spark, folder).em.withColumn("seq", F.col("id"))
    return recent_history(em, AS_OF, ["brand_id"], 3, 10).select("brand_id", "id")


@query("setup_counts", sql_with("taxonomy_topics", "topic_keywords") + """
    SELECT t.brand_id, count(DISTINCT t.id) AS topics_created, count(*) AS links_created FROM taxonomy_topics t JOIN topic_keywords k ON k.topic_id = t.id GROUP BY 1""")
def setup_counts(spark, folder):
    r = Roles(spark, folder)
    links = r.topic_keywords.join(r.taxonomy_topics.select(F.col("id").alias("topic_id"), "brand_id"), "topic_id")
    return links.groupBy("brand_id").agg(F.count_distinct("topic_id").alias("topics_created"), F.count("*").alias("links_created"))


@query("site_search_requests", """
    WITH k AS (SELECT o_custkey % 100 AS run_id, o_orderkey AS seq, o_orderpriority || ' & ' || o_orderkey AS keyword,
                      row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS rn FROM orders),
    s AS (SELECT s_suppkey AS site, s_suppkey % 100 AS run_id, 's' || s_suppkey || '.dk' AS domain,
                 CASE WHEN s_suppkey % 4 = 0 THEN 'https://x.dk/none' ELSE 'https://s' || s_suppkey || '.dk/?q={keyword}' END AS pattern FROM supplier)
    SELECT s.run_id, domain, keyword, replace(pattern, '{keyword}', replace(url_encode(keyword), '%20', '+')) AS search_url
    FROM k JOIN s ON k.run_id = s.run_id WHERE rn <= 12 AND contains(pattern, '{keyword}')""")
def site_search_requests(spark, folder):
    r = Roles(spark, folder)
    words = r.table("orders", "o_custkey", "o_orderkey", "o_orderpriority").selectExpr(
        "o_custkey % 100 as run_id", "o_orderkey as seq", "o_orderpriority || ' & ' || o_orderkey as keyword"
    )
    sites = r.table("supplier", "s_suppkey").selectExpr(
        "s_suppkey % 100 as run_id", "'s' || s_suppkey || '.dk' as domain",
        "case when s_suppkey % 4 = 0 then 'https://x.dk/none' else 'https://s' || s_suppkey || '.dk/?q={keyword}' end as search_url_pattern",
    )
    return joins.site_search_requests(sites, words)


@query("top_mentions_per_brand", sql_with("mentions") + """
    SELECT brand_id, id FROM (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY created_at DESC, id) AS rn FROM mentions) WHERE rn <= 5""")
def top_mentions_per_brand(spark, folder):
    return top_per_key(Roles(spark, folder).mentions, ["brand_id"], [F.desc("created_at"), "id"], 5).select("brand_id", "id")
