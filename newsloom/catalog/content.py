"""URL, text, date and source queries over pages, documents and derived payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.common import AS_OF, Roles, query
from newsloom.functions import dates, queries as search, text, url
from newsloom.operators import filters, guardrails, joins
from newsloom.operators.ordered import top_per_key
from newsloom.sources import feeds, lines, pages, payloads

# --- SQL building blocks ------------------------------------------------------------------------
_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_NORM = rf"regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_replace({_HOST}, '^www\.', '') || coalesce(nullif(regexp_replace({_PATH}, '/+$', ''), ''), '/')"
_SANITIZE = r"""trim(regexp_replace(translate({0}, '"''“”„‟«»`´&|/\:;()[]{{}}.,', repeat(' ', 24)), '\s+', ' ', 'g'))"""
_TITLE_NORM = r"array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"

# Derived article links: every page contributes one link whose path form depends on its id.
_LINK_SQL = """
    SELECT page_id, 'n' || (page_id % 6) || '.example.dk' AS domain,
        'https://' || CASE page_id % 3 WHEN 0 THEN 'www.' WHEN 1 THEN 'sport.' ELSE '' END || 'n' || (page_id % 6) || '.example.dk' ||
        CASE page_id % 9 WHEN 0 THEN '/nyheder/2024/01/' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') || '/sag-' || page_id
            WHEN 1 THEN '/art' || (100000 + page_id) || '/side'
            WHEN 2 THEN '/a-rather-long-article-slug-' || page_id || '/?utm=1'
            WHEN 3 THEN '/tag/some-quite-long-slug-here-' || page_id
            WHEN 4 THEN '/tag/2024/01/02/x-' || page_id || '#top'
            WHEN 5 THEN '/img/' || (1000000 + page_id) || '.jpg'
            WHEN 6 THEN '/kort-slug' WHEN 7 THEN '/' ELSE '//indland//' || (2000000 + page_id) || '//' END AS url
    FROM pages"""


def _links(spark, folder):
    ids = Roles(spark, folder).table("pages", "page_id")
    return ids.selectExpr(
        "page_id", "'n' || (page_id % 6) || '.example.dk' as domain",
        """'https://' || case page_id % 3 when 0 then 'www.' when 1 then 'sport.' else '' end || 'n' || (page_id % 6) || '.example.dk' ||
        case page_id % 9 when 0 then '/nyheder/2024/01/' || lpad(cast(1 + page_id % 28 as string), 2, '0') || '/sag-' || page_id
            when 1 then '/art' || (100000 + page_id) || '/side'
            when 2 then '/a-rather-long-article-slug-' || page_id || '/?utm=1'
            when 3 then '/tag/some-quite-long-slug-here-' || page_id
            when 4 then '/tag/2024/01/02/x-' || page_id || '#top'
            when 5 then '/img/' || (1000000 + page_id) || '.jpg'
            when 6 then '/kort-slug' when 7 then '/' else '//indland//' || (2000000 + page_id) || '//' end as url""",
    )


_CANDIDATES_SQL = r"""
    links AS (""" + _LINK_SQL + r"""),
    parts AS (SELECT page_id, domain, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM links),
    cand AS (SELECT page_id, domain,
        'https://' || regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '') || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/+$', '') AS url
        FROM parts WHERE path NOT IN ('', '/') AND NOT regexp_matches(path, '\.(jpg|jpeg|png|gif|svg|webp|pdf|xml|rss|mp3|mp4|mov|avi|zip|css|js|json)$')
        AND (regexp_matches(rtrim(path, '/') || '/', '/20\d{2}/\d{2}/\d{2}/') OR regexp_matches(rtrim(path, '/'), '(article|art)\d{5,}|/\d{6,}([./-]|$)')
             OR (NOT regexp_matches(path, '^/tag/') AND len(list_filter(string_split(path, '/'), lambda s: length(s) >= 20 AND regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+){2,}$'))) > 0)))
"""


@query("url_normalized", f"""
    SELECT page_id, {_NORM} AS norm_url, replace({_HOST}, 'www.', '') AS platform, regexp_replace({_HOST}, '^www\\.', '') AS domain,
           array_to_string(string_split({_HOST}, '.')[-2:], '.') AS etld1 FROM pages""")
def url_normalized(spark, folder):
    return Roles(spark, folder).table("pages", "page_id", "url").select(
        "page_id", url.normalize_url("url").alias("norm_url"), url.platform_from_url("url").alias("platform"),
        url.normalize_domain("url").alias("domain"), url.etld_plus_one("url").alias("etld1"),
    )


@query("url_normalized_dedup", f"""
    WITH n AS (SELECT page_id, {_NORM} AS norm_url, replace({_HOST}, 'www.', '') AS platform FROM pages)
    SELECT page_id, norm_url, platform FROM (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY page_id) AS rn FROM n) WHERE rn = 1""")
def url_normalized_dedup(spark, folder):
    from newsloom.operators.dedup import url_dedup

    rows_ = Roles(spark, folder).table("pages", "page_id", "url").selectExpr("page_id", "page_id as seq", "url as link", "'' as platform")
    return url_dedup(rows_).select("page_id", "norm_url", "platform")


@query("candidate_article_urls", "WITH " + _CANDIDATES_SQL + "SELECT DISTINCT domain, url FROM cand")
def candidate_article_urls(spark, folder):
    return pages.candidate_links(_links(spark, folder))


@query("candidate_urls_capped", "WITH " + _CANDIDATES_SQL + """
    , d AS (SELECT DISTINCT domain, url FROM cand), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY url) AS rn FROM d)
    SELECT domain, url FROM r WHERE rn <= 10 ORDER BY domain, url LIMIT 200""")
def candidate_urls_capped(spark, folder):
    found = pages.candidate_links(_links(spark, folder))
    return guardrails.url_budget(guardrails.cap_per_source(found, "domain", ["url"]), ["domain", "url"])


@query("url_budget_skipped", "WITH " + _CANDIDATES_SQL + """
    SELECT greatest(count(*) - 40, 0) AS skipped FROM (SELECT DISTINCT domain, url FROM cand)""")
def url_budget_skipped(spark, folder):
    found = pages.candidate_links(_links(spark, folder))
    return guardrails.budget_skipped(found, 40).select(F.col("skipped").cast("long").alias("skipped"))


@query("page_links", r"""
    SELECT page_id, generate_subscripts(hrefs, 1) - 1 AS position, unnest(hrefs) AS href,
           'https://' || domain || unnest(hrefs) AS url
    FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') AS domain,
                 regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs FROM pages)""")
def page_links(spark, folder):
    found = pages.page_links(
        Roles(spark, folder).table("pages").withColumn("domain", url.normalize_domain("url")), "domain"
    )
    return found.select("page_id", F.col("position").cast("long").alias("position"), "href", "url")


@query("harvested_urls_distinct", "WITH " + _CANDIDATES_SQL + """
    SELECT domain, count(*) AS urls FROM (SELECT domain, url FROM cand WHERE page_id % 3 <> 0 UNION SELECT domain, url FROM cand WHERE page_id % 3 <> 1) GROUP BY 1""")
def harvested_urls_distinct(spark, folder):
    links = _links(spark, folder)
    front, search = (pages.candidate_links(links.filter(F.col("page_id") % 3 != part)) for part in (0, 1))
    return front.union(search).distinct().groupBy("domain").agg(F.count("*").alias("urls"))


@query("config_suffix_match", r"""
    WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') AS host FROM pages),
    c AS (SELECT DISTINCT d FROM (SELECT host AS d FROM h WHERE page_id % 6 = 0
          UNION ALL SELECT array_to_string(string_split(host, '.')[-2:], '.') FROM h WHERE page_id % 3 = 1)),
    m AS (SELECT h.page_id, c.d, row_number() OVER (PARTITION BY h.page_id ORDER BY length(c.d) DESC) AS rn FROM h JOIN c ON h.host = c.d OR ends_with(h.host, '.' || c.d))
    SELECT h.page_id, coalesce(m.d, 'none') AS config_domain FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.rn = 1""")
def config_suffix_match(spark, folder):
    hosts = Roles(spark, folder).table("pages", "page_id", "url").select("page_id", url.normalize_domain("url").alias("host"))
    tail = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    exact = hosts.filter("page_id % 6 = 0").select(F.col("host").alias("domain"))
    configs = exact.unionByName(hosts.filter("page_id % 3 = 1").select(tail.alias("domain"))).distinct()
    matched = joins.longest_suffix(hosts, "host", configs)
    return matched.select("page_id", F.coalesce("config_domain", F.lit("none")).alias("config_domain"))


@query("best_article_link", "WITH links AS (" + _LINK_SQL + r"""),
    p AS (SELECT page_id, domain, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM links),
    ok AS (SELECT *, CASE WHEN host IN (domain, 'www.' || domain) THEN 10 ELSE 0 END + CASE WHEN regexp_matches(path, '/20\d{2}/\d{2}/\d{2}/') THEN 3
               WHEN regexp_matches(path, '(article|art)\d{5,}|/\d{6,}([./-]|$)') THEN 2
               WHEN len(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+){3,}$'))) > 0 THEN 1 ELSE 0 END AS score
           FROM p WHERE NOT contains(url, '/tag/') AND length(path) >= 30)
    SELECT domain, url, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, page_id) AS rn FROM ok) WHERE rn = 1""")
def best_article_link(spark, folder):
    links = _links(spark, folder).filter(url.is_plausible_article_link("url", "domain"))
    scored = links.withColumn("score", url.article_link_score("url", "domain").cast("long"))
    return top_per_key(scored, ["domain"], [F.desc("score"), "page_id"], 1).select("domain", "url", "score")


@query("slug_prefilter", "WITH links AS (" + _LINK_SQL + r""")
    SELECT page_id FROM links WHERE contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 'nyheder')
        OR regexp_matches(replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '-', ' '), 'article|long')""")
def slug_prefilter(spark, folder):
    wanted = F.array(F.lit("Nyheder i dag"), F.lit("an Article"), F.lit("long"))
    return _links(spark, folder).filter(text.path_has_keyword_token(url.path("url"), wanted)).select("page_id")


@query("redirect_targets", """
    SELECT doc_id, 'https://' || source || '.example.dk/a/' || doc_id AS canonical FROM documents WHERE doc_id % 3 <> 2
    UNION ALL SELECT doc_id, 'https://news.google.com/rss/articles/' || doc_id FROM documents WHERE doc_id % 3 = 2""")
def redirect_targets(spark, folder):
    docs = Roles(spark, folder).table("documents", "doc_id", "source")
    target = F.expr("'https://www.' || source || '.example.dk/a/' || doc_id || '/?x=1'")
    wrapped = F.concat(F.lit("https://www.google.com/url?sa=t&q=notaurl&url="), F.url_encode(target))
    plain = F.expr("'https://news.google.com/rss/articles/' || doc_id || '?oc=5'")
    anchor = F.concat(F.lit('<a href="'), target, F.lit('">x</a>'))
    nothing = F.lit(None).cast("string")
    rows_ = docs.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, wrapped).otherwise(plain).alias("link"),
        F.when(F.col("doc_id") % 3 == 1, anchor).alias("html"),
    )
    candidates = url.entry_candidates("link", nothing, nothing, "html")
    return rows_.select("doc_id", url.canonical_link(candidates).alias("canonical"))


@query("sanitized_keywords", "SELECT doc_id, " + _SANITIZE.format("text") + " AS keyword FROM documents")
def sanitized_keywords(spark, folder):
    return Roles(spark, folder).table("documents", "doc_id", "text").select("doc_id", text.sanitize("text").alias("keyword"))


@query("title_signature_blocks", "WITH t AS (SELECT doc_id, " + _TITLE_NORM.format("""
        CASE WHEN length(trim(split_part(text, chr(10), 1))) >= 20 THEN trim(split_part(text, chr(10), 1)) ELSE trim(split_part(text, chr(10), 1)) || ' ' || trim(text) END""") + """ AS normalized FROM documents)
    SELECT array_to_string(array_slice(string_split(normalized, ' '), 1, 5), ' ') AS signature, count(*) AS documents, min(doc_id) AS first_doc FROM t GROUP BY 1""")
def title_signature_blocks(spark, folder):
    title = F.expr("split_part(text, '\n', 1)")
    docs = Roles(spark, folder).table("documents", "doc_id", "text")
    normalized = text.normalize_title(text.comparison_text(title, F.col("text")))
    blocks = docs.select("doc_id", text.title_signature(normalized).alias("signature"))
    return blocks.groupBy("signature").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("clean_and_truncate", r"""
    SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 420) AS shown, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 80 AS meaningful FROM documents""")
def clean_and_truncate(spark, folder):
    docs = Roles(spark, folder).table("documents", "doc_id", "text")
    return docs.select("doc_id", F.left(text.squeeze("text"), F.lit(420)).alias("shown"), filters.meaningful_content("text").alias("meaningful"))


@query("label_slugs", r"""
    SELECT p_partkey AS id, regexp_replace(regexp_replace(trim(' ' || p_name || '/' || p_brand || '! '), '[^a-zA-Z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
           left(lower(trim(' ' || p_brand || ' ' || p_type)), 120) AS label FROM part""")
def label_slugs(spark, folder):
    part = Roles(spark, folder).table("part", "p_partkey", "p_name", "p_brand", "p_type")
    return part.select(
        F.col("p_partkey").alias("id"),
        text.slugify_label(F.expr("' ' || p_name || '/' || p_brand || '! '")).alias("slug"),
        text.metric_label(F.expr("' ' || p_brand || ' ' || p_type")).alias("label"),
    )


@query("quoted_search_queries", r"""
    SELECT p_partkey AS id, CASE WHEN contains(q, ' ') THEN '"' || q || '"' ELSE q END AS quoted
    FROM (SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN split_part(p_name, ' ', 1) ELSE p_name END, ''), replace(p_brand, '#', '#')) AS q FROM part)""")
def quoted_search_queries(spark, folder):
    part = Roles(spark, folder).table("part", "p_partkey", "p_name", "p_brand")
    raw = F.expr("case when p_partkey % 5 = 0 then ' \"' when p_partkey % 5 = 1 then split_part(p_name, ' ', 1) else p_name || '.' end")
    return part.select(F.col("p_partkey").alias("id"), text.quote_phrase(text.search_query(raw, "p_brand")).alias("quoted"))


@query("or_query_packing", """
    WITH RECURSIVE k AS (SELECT p_partkey // 20 AS grp, p_name || ' x' AS term, p_partkey % 20 + 1 AS rn, count(*) OVER (PARTITION BY p_partkey // 20) AS n FROM part),
    walk AS (SELECT grp, rn, n, term AS open, CAST('' AS VARCHAR) AS done FROM k WHERE rn = 1
        UNION ALL SELECT w.grp, k.rn, w.n, CASE WHEN length(w.open) + 4 + length(k.term) <= 70 THEN w.open || ' OR ' || k.term ELSE k.term END,
            CASE WHEN length(w.open) + 4 + length(k.term) <= 70 THEN w.done ELSE w.done || w.open || '|' END
        FROM walk w JOIN k ON k.grp = w.grp AND k.rn = w.rn + 1)
    SELECT grp, done || open AS packed FROM walk WHERE rn = n""")
def or_query_packing(spark, folder):
    parts = Roles(spark, folder).table("part", "p_partkey", "p_name")
    listed = parts.groupBy(F.floor(F.col("p_partkey") / 20).alias("grp")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("_k")
    )
    terms = F.transform("_k", lambda k: F.concat(k["p_name"], F.lit(" x")))
    return listed.select("grp", F.array_join(search.pack_or_queries(terms, 70), "|").alias("packed"))


@query("recency_buckets", """
    WITH a AS (SELECT o_orderkey AS id, (epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate)) / 86400.0 AS age, o_orderdate FROM orders)
    SELECT id, coalesce(CASE WHEN age <= 2 THEN 'qdr:d' WHEN age <= 15 THEN 'qdr:w' WHEN age <= 60 THEN 'qdr:m' WHEN age <= 400 THEN 'qdr:y' END, 'none') AS bucket,
           '(q' || id || ') after:' || strftime(o_orderdate, '%Y-%m-%d') AS query FROM a""")
def recency_buckets(spark, folder):
    orders = Roles(spark, folder).table("orders", "o_orderkey", "o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.coalesce(dates.recency_bucket("o_orderdate", "2001-08-01"), F.lit("none")).alias("bucket"),
        dates.after_operator(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")), "o_orderdate").alias("query"),
    )


@query("run_cutoffs", """
    SELECT o_orderkey AS id, strftime(least(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END,
        TIMESTAMP '1999-01-01' - to_days(CAST(1 + o_orderkey % 4 AS INTEGER))), TIMESTAMP '1999-01-01'), '%Y-%m-%d %H:%M:%S') AS cutoff FROM orders""")
def run_cutoffs(spark, folder):
    orders = Roles(spark, folder).table("orders", "o_orderkey", "o_orderdate").selectExpr(
        "o_orderkey as id", "case when o_orderkey % 3 = 0 then null else o_orderdate end as from_date", "1 + o_orderkey % 4 as days"
    )
    cutoff = dates.effective_from_date("from_date", "days", "1999-01-01")
    return orders.select("id", F.date_format(cutoff, "yyyy-MM-dd HH:mm:ss").alias("cutoff"))


@query("parsed_dates", """
    SELECT event_id AS id, strftime(CASE event_id % 8 WHEN 6 THEN TIMESTAMP '2024-01-31' - to_hours(event_id % 50) WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('minute', ts)
            WHEN 7 THEN NULL ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def parsed_dates(spark, folder):
    events = Roles(spark, folder).table("events", "event_id", "ts")
    forms = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
        F.date_format("ts", "d MMMM yyyy HH:mm:ss"),
        F.date_format("ts", "dd.MM.yyyy"),
        F.date_format("ts", "dd/MM/yyyy HH:mm"),
        F.concat((F.col("event_id") % 50).cast("string"), F.lit(" timer siden")),
        F.lit("in the near future"),
    ]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("id"), F.date_format(dates.parse_date(raw, AS_OF), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@query("date_confidence", r"""
    SELECT doc_id, doc_id % 4 = 0 OR regexp_matches(text, '\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b(19|20)\d{2}\b') AS certain FROM documents""")
def date_confidence(spark, folder):
    docs = Roles(spark, folder).table("documents", "doc_id", "text")
    return docs.select("doc_id", dates.certain_date("text", F.col("doc_id") % 4 == 0).alias("certain"))


@query("api_error_kinds", """
    WITH m AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Your RATE limit is hit' WHEN 1 THEN 'monthly search volume' WHEN 2 THEN 'Plan limit reached' WHEN 3 THEN 'Google hasn''t returned any results'
        WHEN 4 THEN 'boom ' || event_id WHEN 5 THEN 'insufficient account balance' END AS message FROM events)
    SELECT CASE event_id % 7 WHEN 0 THEN 'api_rate_limit' WHEN 1 THEN 'api_quota' WHEN 2 THEN 'api_limit_reached' WHEN 3 THEN 'api_no_results' WHEN 4 THEN 'api_error' ELSE 'api_quota' END AS error_type,
           count(*) AS payloads FROM m WHERE message IS NOT NULL GROUP BY 1""")
def api_error_kinds(spark, folder):
    message = F.expr("""case event_id % 7 when 0 then 'Your RATE limit is hit' when 1 then 'monthly search volume' when 2 then 'Plan limit reached'
        when 3 then "Google hasn't returned any results" when 4 then 'boom ' || event_id when 5 then 'insufficient account balance' end""")
    landed = Roles(spark, folder).table("events", "event_id").select(
        "event_id", F.to_json(F.struct(message.alias("error"))).alias("payload")
    )
    return payloads.payload_errors(landed).groupBy("error_type").agg(F.count("*").alias("payloads"))


def _payloads(spark, folder):
    """News payloads of three articles each, built from documents."""
    docs = Roles(spark, folder).table("documents", "doc_id", "text", "source")
    stamp = F.expr("case when doc_id % 7 = 0 then null when doc_id % 7 = 1 then 'soon' else date_format(timestamp'2024-01-31 00:00:00' - make_dt_interval(cast(doc_id % 10 as int)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end")
    link = F.expr("case when doc_id % 17 <> 3 then 'https://' || source || '.dk/' || doc_id end")
    article = F.struct(
        F.expr("case when doc_id % 19 <> 4 then split_part(text, '\n', 1) end").alias("title"), link.alias("url"),
        F.col("text").alias("description"), stamp.alias("publishedAt"), F.col("doc_id").alias("k"),
    )
    packed = docs.groupBy(F.floor(F.col("doc_id") / 3).alias("payload_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", article.alias("a")))).alias("_a"))
    return packed.select("payload_id", F.to_json(F.struct(F.transform("_a", lambda x: x["a"]).alias("articles"))).alias("payload"))


_NEWS_SQL = """
    WITH a AS (SELECT doc_id // 3 AS payload_id, coalesce(CASE WHEN doc_id % 19 <> 4 THEN split_part(text, chr(10), 1) END, 'Uden titel') AS title,
        'https://' || source || '.dk/' || doc_id AS link, text AS content_teaser,
        CASE WHEN doc_id % 7 = 0 THEN 'missing_date' WHEN doc_id % 7 = 1 THEN 'unparseable_date' WHEN doc_id % 10 > 5 THEN 'before_cutoff' ELSE 'kept' END AS outcome
        FROM documents WHERE doc_id % 17 <> 3)
"""


@query("news_payload_scan", _NEWS_SQL + "SELECT payload_id, title, link, content_teaser, outcome FROM a")
def news_payload_scan(spark, folder):
    found = payloads.news_articles(_payloads(spark, folder), F.lit("2024-01-26").cast("timestamp"), AS_OF)
    return found.select("payload_id", "title", "link", "content_teaser", F.coalesce("skip_reason", F.lit("kept")).alias("outcome"))


@query("skip_reason_counters", _NEWS_SQL + """
    SELECT coalesce(CAST(payload_id % 5 AS VARCHAR), 'total') AS lane, count(*) AS seen, count(*) FILTER (WHERE outcome = 'kept') AS kept,
           count(*) FILTER (WHERE outcome = 'missing_date') AS missing_date, count(*) FILTER (WHERE outcome = 'unparseable_date') AS unparseable_date,
           count(*) FILTER (WHERE outcome = 'before_cutoff') AS before_cutoff FROM a GROUP BY ROLLUP (payload_id % 5)""")
def skip_reason_counters(spark, folder):
    found = payloads.news_articles(_payloads(spark, folder), F.lit("2024-01-26").cast("timestamp"), AS_OF)
    laned = found.withColumn("lane", (F.col("payload_id") % 5).cast("string"))
    counts = payloads.reason_counts(laned, ["lane"])
    return counts.select(F.coalesce("lane", F.lit("total")).alias("lane"), "seen", "kept", "missing_date", "unparseable_date", "before_cutoff")


@query("search_payload_scan", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN split_part(text, chr(10), 1) ELSE 'No title' END AS title, 'https://' || source || '.dk/' || doc_id AS link,
           CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'plain ' || source WHEN 2 THEN 'Google News' ELSE 'Google' END AS platform,
           CASE WHEN doc_id % 5 = 0 THEN '2024-01-31 00:00:00' ELSE '2024-01-2' || (doc_id % 5) || ' 00:00:00' END AS published_at, doc_id % 5 = 0 AS date_imputed
    FROM documents WHERE doc_id % 6 <> 5""")
def search_payload_scan(spark, folder):
    docs = Roles(spark, folder).table("documents", "doc_id", "text", "source")
    # to_json leaves null fields out, so one struct serves both payload shapes.
    source = F.expr("""case doc_id % 4 when 0 then to_json(named_struct('name', source)) when 1 then 'plain ' || source end""")
    stamp = F.expr("case when doc_id % 5 = 0 then null else '2024-01-2' || (doc_id % 5) end")
    result = F.struct(
        F.expr("case when doc_id % 2 = 0 then split_part(text, '\n', 1) end").alias("title"),
        F.expr("'https://' || source || '.dk/' || doc_id").alias("link"),
        F.when(F.col("doc_id") % 2 == 0, stamp).alias("iso_date"), F.when(F.col("doc_id") % 2 == 1, stamp).alias("date"),
        source.alias("source"),
    )
    even, failed = F.col("doc_id") % 2 == 0, F.col("doc_id") % 6 == 5
    body = F.struct(
        F.when(even, F.array(result)).alias("news_results"), F.when(~even, F.array(result)).alias("organic_results"),
        F.when(failed, F.lit("Plan limit reached")).alias("error"),
    )
    found = payloads.search_results(docs.select("doc_id", F.to_json(body).alias("payload")), None, AS_OF)
    return found.select("doc_id", "title", "link", "platform", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "date_imputed")


_FEED_TEXT_SQL = r"""
    WITH i AS (SELECT event_id AS id, 'site' || (user_id % 5) || '.dk' AS domain, event_type || ' & story ' || event_id AS title,
                      'value ' || user_id AS summary, 'https://www.site' || (user_id % 5) || '.dk/2024/01/02/' || event_type || '-' || event_id AS link,
                      date_trunc('second', ts) AS ts, event_id % 9 = 0 AS undated FROM events)
"""


def _feed_source(spark, folder):
    return Roles(spark, folder).table("events", "event_id", "user_id", "event_type", "ts").selectExpr(
        "event_id as id", "event_id as seq", "'site' || (user_id % 5) || '.dk' as domain", "event_type || ' &amp; story ' || event_id as title",
        "'value ' || user_id as summary", "'https://www.site' || (user_id % 5) || '.dk/2024/01/02/' || event_type || '-' || event_id as link",
        "ts", "event_id % 9 = 0 as undated",
    )


def _rss(spark, folder):
    date = F.when(~F.col("undated"), F.concat(F.lit("<pubDate>"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate>")))
    xml = F.concat(
        F.lit("<item><title>"), "title", F.lit("</title><link>"), "link", F.lit("?utm=rss</link>"), F.coalesce(date, F.lit("")),
        F.lit("<description>"), "summary", F.lit("</description></item>"),
    )
    items = _feed_source(spark, folder).select("id", "seq", "domain", xml.alias("xml"))
    return feeds.rss_items(items, AS_OF)


@query("rss_item_scan", _FEED_TEXT_SQL + """
    SELECT id, title, summary, link || '?utm=rss' AS link, coalesce(CASE WHEN NOT undated THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END, '-') AS published_at FROM i""")
def rss_item_scan(spark, folder):
    return _rss(spark, folder).select(
        "id", "title", "summary", "link", F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("published_at")
    )


@query("rss_discovery", _FEED_TEXT_SQL + r"""
    SELECT DISTINCT domain, replace(link, '//www.', '//') AS url FROM i WHERE (undated OR ts >= TIMESTAMP '2024-01-20') AND (contains(title, 'error') OR contains(summary, 'value 12'))""")
def rss_discovery(spark, folder):
    wanted = F.array(F.lit("ERROR"), F.lit("value 12"))
    return feeds.discovered_urls(_rss(spark, folder), F.lit("2024-01-20").cast("timestamp"), wanted)


@query("atom_entry_scan", _FEED_TEXT_SQL + """
    SELECT id, title, link, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at FROM i""")
def atom_entry_scan(spark, folder):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    dated = F.when(F.col("undated"), F.concat(F.lit("<updated>"), iso, F.lit("</updated>"))).otherwise(
        F.concat(F.lit("<published>"), iso, F.lit("</published><updated>2020-01-01</updated>"))
    )
    xml = F.concat(
        F.lit('<a:entry><link rel="self" href="https://feed.example.com"/><link rel="alternate" href="'), "link", F.lit('"/><title>'), "title",
        F.lit("</title>"), dated, F.lit("</a:entry>"),
    )
    entries = feeds.atom_entries(_feed_source(spark, folder).select("id", xml.alias("xml")), AS_OF)
    return entries.select("id", "title", "link", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def _sitemap(spark, folder):
    news = F.concat(F.lit("<news:news><news:publication_date>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</news:publication_date><news:title>"), "title", F.lit("</news:title></news:news>"))
    xml = F.concat(F.lit("<url><loc>"), "link", F.lit("</loc><lastmod>2024-01-03</lastmod>"), F.when(~F.col("undated"), news).otherwise(F.lit("")), F.lit("</url>"))
    return feeds.sitemap_urls(_feed_source(spark, folder).select("id", "domain", xml.alias("xml")), AS_OF)


@query("sitemap_url_scan", _FEED_TEXT_SQL + """
    SELECT id, link, CASE WHEN undated THEN '' ELSE title END AS title, CASE WHEN undated THEN '2024-01-03 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published_at FROM i""")
def sitemap_url_scan(spark, folder):
    return _sitemap(spark, folder).select(
        "id", "link", F.coalesce("title", F.lit("")).alias("title"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at")
    )


@query("sitemap_discovery", _FEED_TEXT_SQL + """
    SELECT DISTINCT domain, replace(link, '//www.', '//') AS url FROM i
    WHERE CASE WHEN undated THEN false ELSE ts >= TIMESTAMP '2024-01-10' AND contains(title, 'purchase') END""")
def sitemap_discovery(spark, folder):
    wanted = F.array(F.lit("Purchase"))
    return feeds.discovered_urls(_sitemap(spark, folder), F.lit("2024-01-10").cast("timestamp"), wanted, sitemap=True)


@query("sitemap_children", """
    WITH c AS (SELECT p_partkey, p_size AS index_id, 'https://x.dk/' || CASE WHEN p_partkey % 4 = 0 THEN 'News-' ELSE 'map-' END || p_partkey || '.xml' AS loc FROM part)
    SELECT CAST(index_id AS BIGINT) AS index_id, loc FROM (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY contains(lower(loc), 'news') DESC, p_partkey) AS rn FROM c) WHERE rn <= 3""")
def sitemap_children(spark, folder):
    part = Roles(spark, folder).table("part", "p_partkey", "p_size").selectExpr(
        "cast(p_size as bigint) as index_id", "p_partkey as seq",
        "'<sitemap><loc> https://x.dk/' || case when p_partkey % 4 = 0 then 'News-' else 'map-' end || p_partkey || '.xml </loc></sitemap>' as xml",
    )
    return feeds.sitemap_children(part).select("index_id", "loc")


_KEYWORD_FEED_SQL = r"""
    WITH e AS (SELECT doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'with' ELSE 'les' END AS keyword, split_part(text, chr(10), 1) AS title, text AS summary, doc_id,
        'https://' || source || '.dk/' || (doc_id % 40) AS canonical_link FROM documents),
    j AS (SELECT *, CASE WHEN doc_id % 8 = 0 THEN 'missing_date' WHEN doc_id % 8 = 1 THEN 'unparseable_date' WHEN doc_id % 8 = 2 THEN 'before_cutoff'
        WHEN NOT regexp_matches(lower(title || chr(10) || summary), '(^|[^\p{L}\p{N}_])' || keyword || '([^\p{L}\p{N}_]|$)') THEN 'phrase_miss' END AS reason FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY keyword, canonical_link, reason IS NULL ORDER BY seq) AS rn FROM j),
    o AS (SELECT seq, keyword, CASE WHEN reason IS NULL AND rn > 1 THEN 'duplicate_link' ELSE reason END AS reason FROM f)
"""


def _keyword_feed(spark, folder):
    docs = Roles(spark, folder).table("documents", "doc_id", "text", "source").selectExpr(
        "doc_id as seq", "case doc_id % 3 when 0 then 'the' when 1 then 'with' else 'les' end as keyword", "split_part(text, '\n', 1) as title",
        "text as summary", "'https://www.' || source || '.dk/' || (doc_id % 40) || '/?oc=5' as link", "cast(null as string) as guid",
        "case when doc_id % 8 = 0 then '' when doc_id % 8 = 1 then 'soon' when doc_id % 8 = 2 then '2023-12-01' else '2024-01-30' end as published_raw",
    )
    dated = docs.withColumn("published_at", dates.parse_date("published_raw", AS_OF))
    return feeds.keyword_feed(dated, F.lit("2024-01-29").cast("timestamp"))


@query("keyword_feed_scan", _KEYWORD_FEED_SQL + "SELECT seq, keyword, coalesce(reason, 'kept') AS outcome FROM o")
def keyword_feed_scan(spark, folder):
    return _keyword_feed(spark, folder).select("seq", "keyword", F.coalesce("skip_reason", F.lit("kept")).alias("outcome"))


@query("keyword_feed_counters", _KEYWORD_FEED_SQL + """
    SELECT coalesce(keyword, 'total') AS keyword, count(*) AS seen, count(*) FILTER (WHERE reason IS NULL) AS kept, count(*) FILTER (WHERE reason = 'missing_date') AS missing_date,
        count(*) FILTER (WHERE reason = 'unparseable_date') AS unparseable_date, count(*) FILTER (WHERE reason = 'before_cutoff') AS before_cutoff,
        count(*) FILTER (WHERE reason = 'phrase_miss') AS phrase_miss, count(*) FILTER (WHERE reason = 'no_link') AS no_link,
        count(*) FILTER (WHERE reason = 'duplicate_link') AS duplicate_links FROM o GROUP BY ROLLUP (keyword)""")
def keyword_feed_counters(spark, folder):
    counts = payloads.reason_counts(_keyword_feed(spark, folder), ["keyword"])
    return counts.withColumn("keyword", F.coalesce("keyword", F.lit("total")))


@query("domain_list_scan", r"""
    WITH l AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN '# note' WHEN o_orderkey % 4 = 1 THEN '  ' ELSE ' HTTPS://www.site' || (o_custkey % 300) || '.dk/ ' END AS value FROM orders)
    SELECT regexp_replace(regexp_replace(regexp_replace(lower(trim(value)), '^https?://', ''), '/+$', ''), '^www\.', '') AS domain, min(seq) AS seq FROM l WHERE value LIKE '%site%' GROUP BY 1 ORDER BY 2 LIMIT 100""")
def domain_list_scan(spark, folder):
    listed = Roles(spark, folder).table("orders", "o_orderkey", "o_custkey").selectExpr(
        "o_orderkey as seq", "case when o_orderkey % 4 = 0 then '# note' when o_orderkey % 4 = 1 then '  ' else ' HTTPS://www.site' || (o_custkey % 300) || '.dk/ ' end as value"
    )
    return lines.domain_list(listed, 100)


@query("market_list_union", """
    SELECT domain, min(seq) AS seq FROM (SELECT 's' || s_suppkey % 40 || '.dk' AS domain, s_suppkey AS seq FROM supplier
        UNION ALL SELECT 's' || c_custkey % 60 || '.dk', 1000000 + c_custkey FROM customer) GROUP BY 1""")
def market_list_union(spark, folder):
    r = Roles(spark, folder)
    first = r.table("supplier", "s_suppkey").selectExpr("s_suppkey as seq", "'https://s' || s_suppkey % 40 || '.dk' as value")
    second = r.table("customer", "c_custkey").selectExpr("1000000 + c_custkey as seq", "'www.s' || c_custkey % 60 || '.dk/' as value")
    return lines.union_lists(first, second)


@query("metric_text_scan", """
    SELECT event_id, 'scrape_' || event_type || '_total' AS name, event_type AS provider, 'd' || (user_id % 10) AS domain, CAST(event_id % 100 AS DOUBLE) AS value FROM events WHERE event_id % 5 > 1""")
def metric_text_scan(spark, folder):
    text_lines = Roles(spark, folder).table("events", "event_id", "user_id", "event_type").selectExpr(
        "event_id",
        """case event_id % 5 when 0 then '# HELP scrape_x' when 1 then 'python_gc_total{generation="0"} 4'
           else 'scrape_' || event_type || '_total{provider="' || event_type || '",domain="d' || (user_id % 10) || '"} ' || (event_id % 100) end as value""",
    )
    found = lines.metric_samples(text_lines)
    label = lambda name: F.element_at("labels", F.lit(name)).alias(name)
    return found.select("event_id", "name", label("provider"), label("domain"), "value")


@query("robots_sitemaps", """
    WITH l AS (SELECT p_partkey // 20 AS site, p_partkey AS n, p_partkey % 6 = 0 AS news, 'https://x.dk/' || CASE WHEN p_partkey % 6 = 0 THEN 'news-' ELSE 'map-' END || p_partkey || '.xml' AS loc FROM part WHERE p_partkey % 6 <= 1),
    f AS (SELECT site, min(n) FILTER (WHERE news) AS first_news FROM l GROUP BY 1)
    SELECT l.site, coalesce(min(loc) FILTER (WHERE n = first_news), '-') AS news_sitemap, coalesce(arg_min(loc, n) FILTER (WHERE first_news IS NULL OR n <> first_news), '-') AS other_sitemap
    FROM l JOIN f ON f.site = l.site GROUP BY 1""")
def robots_sitemaps(spark, folder):
    line = F.expr("case p_partkey % 6 when 0 then 'SITEMAP: https://x.dk/news-' || p_partkey || '.xml' when 1 then 'Sitemap: https://x.dk/map-' || p_partkey || '.xml' else 'Disallow: /' || p_partkey end")
    rules = Roles(spark, folder).table("part", "p_partkey").select(F.floor(F.col("p_partkey") / 20).alias("site"), "p_partkey", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n")
    robots = rules.groupBy("site").agg(body.alias("body"))
    found = pages.robots_sitemaps(robots, ("site",))
    return found.select("site", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("news_sitemap", "other_sitemap")])


@query("feed_autodiscovery", r"""
    SELECT page_id, 0 AS position, 'https://' || regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') || '/feed/' || page_id || '.xml' AS feed_url FROM pages WHERE page_id % 3 <> 1""")
def feed_autodiscovery(spark, folder):
    landed = Roles(spark, folder).table("pages")
    kind = F.expr("case page_id % 3 when 0 then 'application/rss+xml' when 1 then 'text/html' else 'application/atom+xml' end")
    tag = F.concat(F.lit('<link href="/feed/'), F.col("page_id").cast("string"), F.lit('.xml" rel="alternate" type="'), kind, F.lit('"><link rel="stylesheet" href="x.css">'))
    with_feed = landed.select("page_id", url.normalize_domain("url").alias("domain"), F.concat(tag, "html").alias("html"))
    return pages.feed_links(with_feed, "domain").select("page_id", "position", "feed_url")


@query("discovery_priority", """
    SELECT CASE WHEN page_id % 4 = 0 THEN 'sitemap' WHEN page_id % 3 = 0 THEN 'rss' WHEN page_id % 5 = 0 THEN 'sitemap' ELSE 'site_search' END AS strategy, count(*) AS sites FROM pages GROUP BY 1""")
def discovery_priority(spark, folder):
    found = Roles(spark, folder).table("pages", "page_id").selectExpr(
        "case when page_id % 4 = 0 then 'https://x/news.xml' end as news", "case when page_id % 5 = 0 then 'https://x/map.xml' end as plain",
        "case when page_id % 3 = 0 then array('https://x/feed') end as feeds",
    )
    return found.groupBy(filters.best_discovery("news", "plain", "feeds").alias("strategy")).agg(F.count("*").alias("sites"))


_CONFIGS = """case page_id % 8 when 0 then 'site_search' when 1 then 'rss' when 2 then 'sitemap' when 3 then 'rss' when 4 then 'sitemap' when 5 then 'site_search' when 6 then 'ftp' end"""


def _configs(spark, folder):
    return Roles(spark, folder).table("pages", "page_id", "url").withColumn("domain", url.normalize_domain("url")).selectExpr(
        "page_id", "domain", "'h1' as title_selector", "'article' as content_selector", "cast(null as string) as date_selector",
        "case page_id % 8 when 0 then 'https://' || domain || '/?q={keyword}' when 5 then 'https://' || domain || '/?q=' when 7 then '/relative/{keyword}' end as search_url_pattern",
        "case page_id % 8 when 1 then array('https://' || domain || '/feed') when 6 then array('feed.xml') end as rss_urls",
        "case page_id % 8 when 2 then 'https://' || domain || '/map.xml' end as sitemap_url", f"{_CONFIGS} as discovery_type",
    )


@query("config_validation", """
    SELECT page_id, CASE page_id % 8 WHEN 3 THEN 'rss_without_feeds' WHEN 4 THEN 'sitemap_without_url' WHEN 5 THEN 'pattern_without_keyword' WHEN 6 THEN 'feed_not_absolute'
        WHEN 7 THEN 'pattern_not_absolute' ELSE 'valid' END AS outcome FROM pages""")
def config_validation(spark, folder):
    return _configs(spark, folder).select("page_id", F.coalesce(filters.config_reject_reason(), F.lit("valid")).alias("outcome"))


@query("eligible_sources", """
    SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'site_search' WHEN 1 THEN 'rss' WHEN 2 THEN 'sitemap' ELSE 'site_search' END AS strategy FROM pages WHERE page_id % 8 IN (0, 1, 2, 7)""")
def eligible_sources(spark, folder):
    usable = _configs(spark, folder).withColumn("strategy", filters.discovery_strategy())
    return usable.filter(F.col("strategy").isNotNull()).select("page_id", "strategy")


@query("thin_pages", r"""
    SELECT page_id, length(t) < 1000 AS thin FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->|<!doctype[^>]*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def thin_pages(spark, folder):
    return Roles(spark, folder).table("pages", "page_id", "html").select("page_id", filters.thin_page("html", 1000).alias("thin"))


@query("soft_404_pages", r"""
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'status' WHEN page_id % 5 = 1 THEN 'redirected_home'
        WHEN page_id % 5 = 2 AND trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) <> '' THEN 'same_title' ELSE 'works' END AS outcome FROM pages""")
def soft_404_pages(spark, folder):
    landed = Roles(spark, folder).table("pages").withColumn("domain", url.normalize_domain("url")).selectExpr(
        "page_id", "domain", "html", "case when page_id % 5 = 0 then 503 else 200 end as status",
        "case when page_id % 5 = 1 then 'http://' || domain || '/' else url end as final_url",
        "case when page_id % 5 = 2 then html else '<title>other home</title>' end as home",
    )
    reason = filters.soft_404_reason("status", "final_url", "domain", filters.html_title("html"), filters.html_title("home"))
    return landed.select("page_id", F.coalesce(reason, F.lit("works")).alias("outcome"))


@query("locale_attempts", """
    SELECT c_custkey AS run_id, count(*) AS attempts FROM (SELECT c_custkey, unnest(CASE c_custkey % 4 WHEN 0 THEN ['da', 'en', 'default'] WHEN 1 THEN ['no', 'default'] WHEN 2 THEN ['da', 'en', 'no', 'sv', 'default'] ELSE ['default'] END) FROM customer) GROUP BY 1""")
def locale_attempts(spark, folder):
    runs = Roles(spark, folder).table("customer", "c_custkey").selectExpr(
        "c_custkey as run_id", "'olie & gas' as keyword",
        "case c_custkey % 4 when 0 then array() when 1 then array('NO', 'nb', 'nn_NO') when 2 then array('da-DK', 'en', 'no', 'sv', 'nb') else array('fr') end as languages",
    )
    return joins.rss_requests(runs).groupBy("run_id").agg(F.count("feed_url").alias("attempts"))


@query("rss_request_urls", """
    SELECT o_orderkey AS run_id, CAST(a AS INTEGER) AS attempt, CASE a WHEN 0 THEN 'da' ELSE 'default' END AS language,
        'https://news.google.com/rss/search?q=' || replace(url_encode(o_orderpriority), '%20', '+') || CASE a WHEN 0 THEN '&hl=da&gl=DK&ceid=DK%3Ada' ELSE '' END AS feed_url
    FROM orders, (VALUES (0), (1)) v(a)""")
def rss_request_urls(spark, folder):
    runs = Roles(spark, folder).table("orders", "o_orderkey", "o_orderpriority").selectExpr("o_orderkey as run_id", "o_orderpriority as keyword", "array('da') as languages")
    return joins.rss_requests(runs).select("run_id", "attempt", "language", "feed_url")


@query("taxonomy_spec_lines", """
    SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_brand END AS topic, CASE p_partkey % 4 WHEN 2 THEN 'no_keywords' WHEN 3 THEN 'empty_topic' ELSE 'ok' END AS outcome,
        k AS keyword FROM (SELECT *, unnest(CASE WHEN p_partkey % 4 < 2 THEN [p_name, p_type] ELSE ['-'] END) AS k FROM part)""")
def taxonomy_spec_lines(spark, folder):
    specs = Roles(spark, folder).table("part", "p_partkey", "p_name", "p_brand", "p_type").selectExpr(
        "p_partkey as id", "case p_partkey % 4 when 2 then p_brand || '= , ' when 3 then ' =' || p_name else p_brand || ' = ' || p_name || ' ,, ' || p_type end as value"
    )
    parsed = lines.taxonomy_specs(specs)
    return parsed.select("id", "topic", F.coalesce("reject_reason", F.lit("ok")).alias("outcome"), F.coalesce("keyword", F.lit("-")).alias("keyword"))


# --- HTML job: no SQL twin -----------------------------------------------------------------------


def _page_configs(spark, folder):
    landed = Roles(spark, folder).table("pages").withColumn("host", url.normalize_domain("url"))
    configs = landed.filter("page_id % 4 = 0").select(F.col("host").alias("domain")).distinct().selectExpr(
        "domain", "'article h1' as title_selector", "'article' as content_selector", "'time[datetime]' as date_selector"
    )
    return joins.longest_suffix(landed, "host", configs)


@query("html_extract")
def html_extract(spark, folder):
    found = pages.extract_articles(_page_configs(spark, folder))
    return found.select(
        "page_id", "title", F.length("content").alias("content_chars"), "date_raw",
        dates.certain_date("date_raw", "date_from_attribute").alias("date_certain"), "extracted_via",
        filters.meaningful_content("content").alias("meaningful"),
    )


@query("selector_suggestions")
def selector_suggestions(spark, folder):
    landed = Roles(spark, folder).table("pages")
    hits = pages.selector_hits(landed)
    found = pages.suggest_selectors(hits, landed.select("page_id", url.etld_plus_one("url").alias("domain")))
    count = sum(F.col(c).isNotNull().cast("int") for c in ("title_selector", "content_selector", "date_selector"))
    return found.withColumn("confidence", filters.confidence(count))


@query("selector_quality_gates", r"""
    SELECT doc_id, length(trim(split_part(text, chr(10), 1))) >= 10 AS title_ok, length(trim(text)) >= 50 AS content_ok, regexp_matches(text, '202[0-9]') AS date_ok FROM documents""")
def selector_quality_gates(spark, folder):
    docs = Roles(spark, folder).table("documents", "doc_id", "text").selectExpr("doc_id", "split_part(text, '\n', 1) as title", "text as content", "text as date")
    return docs.select("doc_id", *filters.selector_quality("title", "content", "date"))


@query("extraction_date_chain", """
    SELECT CASE doc_id % 5 WHEN 0 THEN 'date_missing_cutoff_skip' WHEN 1 THEN 'date_low_confidence_cutoff_skip' WHEN 2 THEN 'date_unparseable_cutoff_skip' WHEN 3 THEN 'date_before_cutoff_skip' ELSE 'kept' END AS outcome, count(*) AS articles
    FROM documents GROUP BY 1""")
def extraction_date_chain(spark, folder):
    raw = "case doc_id % 5 when 0 then '' when 1 then 'yesterday' when 2 then 'year 2024' when 3 then '2023-12-31' else '30.01.2024' end"
    docs = Roles(spark, folder).table("documents", "doc_id").selectExpr("doc_id", f"{raw} as date_raw")
    judged = docs.withColumn("certain", dates.certain_date("date_raw", F.lit(False))).withColumn("parsed", dates.parse_date("date_raw", AS_OF))
    reason = filters.extraction_date_reason("date_raw", "certain", "parsed", F.lit("2024-01-01").cast("timestamp"))
    return judged.groupBy(F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(F.count("*").alias("articles"))


# A list as it lands: comments, blank lines, plain, wildcard and exception rules.
_SUFFIX_LIST = ["// public suffixes", "", "com", "dk", "uk", "co.uk", "jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck  trailing words", "github.io"]
_SUFFIX_HOSTS = [
    "a.b.{s}.dk", "{s}.co.uk", "www.{s}.co.uk", "co.uk", "x.{s}.ck", "{s}.ck", "www.ck", "{s}.www.ck", "{s}.kobe.jp", "a.{s}.kobe.jp", "b.city.kobe.jp",
    "{s}.unlisted", "a.{s}.unlisted", "{s}.github.io", "localhost", "10.0.0.1", "user@{s}.com:8080",
]


@query("registrable_domains", r"""
    WITH h AS (SELECT doc_id, source, doc_id % 17 AS k FROM documents),
    x AS (SELECT doc_id, CASE k WHEN 0 THEN 'dk' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'co.uk' WHEN 3 THEN 'co.uk' WHEN 4 THEN source || '.ck' WHEN 5 THEN source || '.ck' WHEN 6 THEN 'ck' WHEN 7 THEN 'ck'
            WHEN 8 THEN source || '.kobe.jp' WHEN 9 THEN source || '.kobe.jp' WHEN 10 THEN 'kobe.jp' WHEN 11 THEN 'unlisted' WHEN 12 THEN 'unlisted' WHEN 13 THEN 'github.io' WHEN 14 THEN 'localhost' WHEN 16 THEN 'com' END AS suffix,
          CASE k WHEN 0 THEN source || '.dk' WHEN 1 THEN source || '.co.uk' WHEN 2 THEN source || '.co.uk' WHEN 4 THEN 'x.' || source || '.ck' WHEN 6 THEN 'www.ck' WHEN 7 THEN 'www.ck'
            WHEN 9 THEN 'a.' || source || '.kobe.jp' WHEN 10 THEN 'city.kobe.jp' WHEN 11 THEN source || '.unlisted' WHEN 12 THEN source || '.unlisted' WHEN 13 THEN source || '.github.io' WHEN 16 THEN source || '.com' END AS domain FROM h)
    SELECT doc_id, coalesce(suffix, '-') AS public_suffix, coalesce(domain, '-') AS registrable FROM x""")
def registrable_domains(spark, folder):
    """Hosts of every shape, one per document, against rules read from a landed list."""
    from newsloom.functions import suffix
    from newsloom.session import shared_folder

    path = f"{shared_folder(spark)}/list"
    listed = spark.createDataFrame([(line,) for line in _SUFFIX_LIST], "value string")
    listed.coalesce(1).write.text(path)
    shapes = F.array(*[F.lit(h) for h in _SUFFIX_HOSTS])
    host = F.replace(F.element_at(shapes, (F.col("doc_id") % len(_SUFFIX_HOSTS) + 1).cast("int")), F.lit("{s}"), F.col("source"))
    docs = Roles(spark, folder).table("documents", "doc_id", "source").withColumn("link", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://"), host, F.lit("/a/b?c=d"))).otherwise(host))
    found = suffix.with_registrable(docs, "link", suffix.read_rules(spark, path))
    return found.select("doc_id", F.coalesce("public_suffix", F.lit("-")).alias("public_suffix"), F.coalesce("registrable", F.lit("-")).alias("registrable"))
