"""Matching, deduplication, language and ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.common import AS_OF, KEYWORDS, Roles, query, sql_with
from newsloom.functions import fuzzy, text
from newsloom.operators import dedup, filters, guardrails, language, matching
from newsloom.plans import ingest
from newsloom.session import cut_lineage

# Three topics over the fixed keyword list; "of the" is a two-word phrase.
_TAXONOMY = [(1, 1, "the"), (1, 2, "with"), (2, 3, "that"), (2, 4, "and"), (3, 5, "les"), (3, 6, "und"), (3, 7, "para"), (1, 8, "of the")]


def _pattern_sql(word: str) -> str:
    """The twin's boundary regex as a constant: RE2 has no look-around."""
    return r"'(^|[^\p{L}\p{N}_])" + word.replace(" ", r"[^\p{L}\p{N}]+") + r"([^\p{L}\p{N}_]|$)'"


def _hit_sql(topic: int, keyword: int, word: str) -> str:
    return (
        f"SELECT mention_id, CAST({topic} AS BIGINT) AS topic_id, CAST({keyword} AS BIGINT) AS keyword_id, '{word}' AS keyword, "
        f"regexp_matches(lower(title), {_pattern_sql(word)}) AS in_title, "
        f"regexp_matches(lower(content_teaser), {_pattern_sql(word)}) AS in_teaser FROM raw"
    )


_MATCH_SQL = sql_with("raw") + ", hit AS (" + " UNION ALL ".join(_hit_sql(*t) for t in _TAXONOMY) + r"""),
    found AS (SELECT mention_id, topic_id, keyword_id, keyword, CASE WHEN in_title AND in_teaser THEN 'both' WHEN in_title THEN 'title' ELSE 'teaser' END AS matched_in FROM hit WHERE in_title OR in_teaser),
    scored AS (SELECT mention_id, topic_id, count(*) AS score FROM found GROUP BY ALL),
    best AS (SELECT mention_id, topic_id, score FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, topic_id) AS rn FROM scored) WHERE rn = 1)
"""


def _keywords(spark, folder):
    """The fixed taxonomy as literal rows (it is a parameter of the query, not its data)."""
    values = ", ".join(f"({t}, {k}, '{w}')" for t, k, w in _TAXONOMY)
    return spark.sql(
        f"SELECT 1L AS brand_id, CAST(t AS BIGINT) AS topic_id, CAST(k AS BIGINT) AS keyword_id, w AS keyword FROM VALUES {values} AS v(t, k, w)"
    )


@query("phrase_matches", _MATCH_SQL + "SELECT mention_id, topic_id, keyword_id, matched_in FROM found")
def phrase_matches(spark, folder):
    found = matching.phrase_matches(Roles(spark, folder).raw, _keywords(spark, folder))
    return found.select("mention_id", *[F.col(c) for c in ("topic_id", "keyword_id", "matched_in")])


@query("phrase_match_best_topic", _MATCH_SQL + """
    , p AS (SELECT f.mention_id, f.keyword_id, row_number() OVER (PARTITION BY f.mention_id ORDER BY length(keyword) DESC, keyword_id) AS rn FROM found f JOIN best b ON b.mention_id = f.mention_id AND b.topic_id = f.topic_id)
    SELECT b.mention_id, b.topic_id, b.score, p.keyword_id AS primary_keyword_id FROM best b JOIN p ON p.mention_id = b.mention_id AND rn = 1 WHERE b.score >= 2""")
def phrase_match_best_topic(spark, folder):
    found = matching.phrase_matches(Roles(spark, folder).raw, _keywords(spark, folder))
    topics = matching.best_topics(found, 2)
    return topics.join(matching.primary_keywords(found, topics), "mention_id")


@query("strong_or_fallback_matches", _MATCH_SQL + """
    , s AS (SELECT r.mention_id, r.mention_id % 40 AS run_id, coalesce(count(f.keyword_id), 0) AS term_matches FROM raw r LEFT JOIN found f ON f.mention_id = r.mention_id GROUP BY 1, 2),
    b AS (SELECT run_id, max(term_matches) AS top FROM s GROUP BY 1)
    SELECT s.run_id, s.mention_id, s.term_matches FROM s JOIN b ON b.run_id = s.run_id WHERE s.term_matches >= CASE WHEN top >= 4 THEN 4 ELSE 1 END""")
def strong_or_fallback_matches(spark, folder):
    raw = Roles(spark, folder).raw
    counts = matching.phrase_matches(raw, _keywords(spark, folder)).groupBy("mention_id").agg(F.count("*").alias("term_matches"))
    scored = raw.select("mention_id", (F.col("mention_id") % 40).alias("run_id")).join(counts, "mention_id", "left")
    scored = scored.withColumn("term_matches", F.coalesce("term_matches", F.lit(0)))
    return filters.strong_or_fallback(scored, "run_id", "term_matches", primary=4)


_SCORE_SQL = " + ".join(f"CAST(regexp_matches(lower(text), {_pattern_sql(w)}) AS BIGINT)" for w in KEYWORDS)


@query("article_keyword_scores", f"""
    SELECT doc_id, n AS term_matches, least(n, 1) AS group_score FROM (SELECT doc_id, {_SCORE_SQL} AS n FROM documents)""")
def article_keyword_scores(spark, folder):
    docs = Roles(spark, folder).table("documents", "doc_id", "text")
    values = ", ".join(f"({i}, '{w}')" for i, w in enumerate(KEYWORDS))
    words = spark.sql(f"SELECT CAST(i AS BIGINT) AS keyword_id, w AS keyword FROM VALUES {values} AS v(i, w)")
    scored = matching.keyword_score(docs, words, "doc_id", "text")
    return scored.select("doc_id", "term_matches", F.least("term_matches", F.lit(1).cast("long")).alias("group_score"))


@query("strict_date_filter", sql_with("raw") + """
    SELECT CASE WHEN mention_id % 17 = 0 THEN 'unparseable_date' WHEN published_at IS NULL THEN 'missing_date' WHEN published_at < TIMESTAMP '2024-01-29' THEN 'before_cutoff' ELSE 'kept' END AS outcome, count(*) AS mentions
    FROM raw GROUP BY 1""")
def strict_date_filter(spark, folder):
    from newsloom.functions.dates import parse_date

    raw = Roles(spark, folder).raw
    shown = F.when(F.col("mention_id") % 17 == 0, F.lit("once upon a time")).otherwise(F.date_format("published_at", "dd.MM.yyyy"))
    dated = raw.select("mention_id", shown.alias("published_raw")).withColumn("published_at", parse_date("published_raw", AS_OF))
    reason = filters.strict_date_reason("published_raw", "published_at", F.lit("2024-01-29").cast("timestamp"))
    return dated.groupBy(F.coalesce(reason, F.lit("kept")).alias("outcome")).agg(F.count("*").alias("mentions"))


@query("lenient_date_filter", sql_with("raw") + """
    SELECT mention_id FROM raw WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-01-29'""")
def lenient_date_filter(spark, folder):
    return filters.lenient_since(Roles(spark, folder).raw, F.lit("2024-01-29").cast("timestamp")).select("mention_id")


@query("relevance_fail_open", """
    SELECT d.doc_id, coalesce(l.quality, -1) AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality, 1) = 1""")
def relevance_fail_open(spark, folder):
    r = Roles(spark, folder)
    verdicts = r.table("labels", "doc_id", "quality").withColumn("relevant", F.col("quality") == 1)
    kept = filters.keep_relevant(r.table("documents", "doc_id"), verdicts, "doc_id", "relevant")
    return kept.join(verdicts, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("verdict"))


_LANG_SQL = r"""
    WITH words AS (SELECT lang AS language, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
    g AS (SELECT language, n, '_' || word || '_' AS p, unnest(range(1, length(word) + 1)) AS i FROM words),
    t AS (SELECT language, substr(p, i, 3) AS gram, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL),
    prof AS (SELECT language, gram, 301 - rn AS weight FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, gram) AS rn FROM t) WHERE rn <= 300),
    title AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title, lang FROM documents),
    tw AS (SELECT doc_id, '_' || word || '_' AS p, unnest(range(1, length(word) + 1)) AS i FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(title), '[^\p{L}]+')) AS word FROM title WHERE length(title) >= 15) WHERE word <> ''),
    sc AS (SELECT doc_id, language, CAST(sum(weight) AS BIGINT) AS score FROM (SELECT doc_id, substr(p, i, 3) AS gram FROM tw) x JOIN prof ON prof.gram = x.gram GROUP BY ALL),
    det AS (SELECT doc_id, language AS detected FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS rn FROM sc) WHERE rn = 1)
"""


def _titled(spark, folder):
    return Roles(spark, folder).table("documents", "doc_id", "text", "lang").selectExpr("doc_id", "split_part(text, '\n', 1) as title", "lang")


def _profiles(spark, folder):
    return language.train_profiles(Roles(spark, folder).table("documents", "text", "lang"), "text", "lang")


@query("language_profiles", _LANG_SQL + "SELECT language, gram, weight FROM prof")
def language_profiles(spark, folder):
    return _profiles(spark, folder)


@query("language_filter", _LANG_SQL + """
    SELECT t.doc_id, coalesce(d.detected, 'none') AS detected FROM title t LEFT JOIN det d ON d.doc_id = t.doc_id
    WHERE length(t.title) < 15 OR d.detected IS NULL OR d.detected IN ('en', 'da')""")
def language_filter(spark, folder):
    allowed = F.array(F.lit("en"), F.lit("da"))
    kept = language.filter_by_language(_titled(spark, folder), "doc_id", "title", _profiles(spark, folder), allowed)
    return kept.select("doc_id", F.coalesce("detected", F.lit("none")).alias("detected"))


# The open set: profiles of two languages only, so titles in the others should come out as undetected.
_LEAST_KNOWN, _LEAST_MARGIN = 0.6, 0.1


@query("language_open_set", _LANG_SQL.replace("FROM documents) WHERE word <> '' GROUP BY ALL)", "FROM documents WHERE lang IN ('en', 'de')) WHERE word <> '' GROUP BY ALL)", 1) + f"""
    , n AS (SELECT doc_id, count(*) AS grams FROM tw GROUP BY 1),
    k AS (SELECT doc_id, language, CAST(sum(weight) AS BIGINT) AS score, count(*) AS known FROM (SELECT doc_id, substr(p, i, 3) AS gram FROM tw) x JOIN prof ON prof.gram = x.gram GROUP BY ALL),
    z AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS second FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, language)),
    d AS (SELECT z.doc_id, language FROM z JOIN n ON n.doc_id = z.doc_id WHERE rn = 1 AND known / grams >= {_LEAST_KNOWN}::DOUBLE AND (score - coalesce(second, 0)) / score >= {_LEAST_MARGIN}::DOUBLE)
    SELECT t.lang, coalesce(d.language, 'none') AS detected, count(*) AS titles FROM title t LEFT JOIN d ON d.doc_id = t.doc_id
    WHERE length(t.title) >= 15 GROUP BY ALL""")
def language_open_set(spark, folder):
    r = Roles(spark, folder)
    known = r.table("documents", "text", "lang").filter(F.col("lang").isin("en", "de"))
    titles = _titled(spark, folder).filter(F.length(F.trim("title")) >= 15)
    found = language.detect(titles, "doc_id", "title", language.train_profiles(known, "text", "lang"), _LEAST_KNOWN, _LEAST_MARGIN)
    return titles.join(found, "doc_id", "left").groupBy("lang", F.coalesce("detected", F.lit("none")).alias("detected")).agg(F.count("*").alias("titles"))


@query("url_dedup_mentions", sql_with("raw") + r"""
    SELECT mention_id, CASE WHEN platform = '' THEN regexp_replace(regexp_extract(link, '://([^/]*)', 1), 'www\.', '', 'g') ELSE platform END AS platform
    FROM (SELECT *, row_number() OVER (PARTITION BY brand_id, rtrim(link, '/') ORDER BY seq) AS rn FROM raw) WHERE rn = 1""")
def url_dedup_mentions(spark, folder):
    return dedup.url_dedup(Roles(spark, folder).raw, ["brand_id"]).select("mention_id", "platform")


@query("last_row_per_key", sql_with("raw") + """
    SELECT mention_id, link FROM (SELECT *, row_number() OVER (PARTITION BY link, brand_id ORDER BY seq DESC) AS rn FROM raw) WHERE rn = 1""")
def last_row_per_key(spark, folder):
    return dedup.last_in_batch(Roles(spark, folder).raw, ["link", "brand_id"]).select("mention_id", "link")


@query("near_dedup")
def near_dedup(spark, folder):
    kept = dedup.near_dedup(Roles(spark, folder).raw, ["brand_id"])
    return kept.select("mention_id", "title", "platform")


@query("historical_anti_join")
def historical_anti_join(spark, folder):
    """New mentions against stored ones: documents published before 29 January are the history of all others,
    together with the benchmark passages."""
    r = Roles(spark, folder)
    stored = F.coalesce(F.col("published_at") < F.lit("2024-01-29").cast("timestamp"), F.lit(False))
    new = r.raw.filter(~stored)
    old = r.raw.filter(stored).withColumn("created_at", F.lit("2024-01-30").cast("timestamp"))
    passages = r.table("benchmark").selectExpr(
        "item_id as mention_id", "1000000000 + item_id as seq", "cast(1 as bigint) as brand_id", "split_part(text, '\n', 1) as title",
        "text as content_teaser", "'https://news.google.com/' || item_id as link", "'Unknown' as platform",
        "cast(null as timestamp) as published_at", "'en' as lang", "timestamp'2024-01-30 12:00:00' as created_at",
    )
    history = dedup.recent_history(old.unionByName(passages), AS_OF, ["brand_id"], limit=None)
    return dedup.without_historical(new, history, ["brand_id"]).select("mention_id", "title")


@query("token_set_scores")
def token_set_scores(spark, folder):
    """Similarity of every document's title to the title of the copy family's first document."""
    title = text.normalize_title(F.expr("split_part(text, '\n', 1)"))
    docs = Roles(spark, folder).table("documents", "doc_id", "text").select("doc_id", title.alias("title"), text.title_signature(title).alias("signature"))
    firsts = docs.groupBy("signature").agg(F.min_by("title", "doc_id").alias("first_title"), F.count("*").alias("n"))
    pairs = docs.join(firsts.filter("n > 1"), "signature")
    return pairs.select("doc_id", F.round(fuzzy.similarity("title", "first_title"), 3).alias("score"))


_BREAKER_SQL = """
    WITH x AS (SELECT event_id AS seq, 'd' || (user_id % 10) AS domain, event_type = 'error' AS failed, event_type = 'view' AS blind FROM events),
    c AS (SELECT *, coalesce(sum(CAST(failed AS INTEGER)) OVER w, 0) AS f, coalesce(sum(CAST(blind AS INTEGER)) OVER w, 0) AS b FROM x
          WINDOW w AS (PARTITION BY domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT domain, seq, CASE WHEN f >= 5 THEN 'circuit_open_skip' WHEN b >= 8 THEN 'blind_circuit_skip' ELSE 'run' END AS breaker FROM c
"""


@query("circuit_breaker", _BREAKER_SQL)
def circuit_breaker(spark, folder):
    samples = Roles(spark, folder).samples
    rows_ = samples.select(F.col("event_id").alias("seq"), "domain", "failed", (F.col("provider") == "view").alias("blind"))
    bucket = F.floor(F.col("seq") / 100_000)
    states = guardrails.with_breaker(rows_, ["domain"], ["seq"], bucket, F.col("blind"), F.col("failed"))
    return states.select("domain", "seq", F.coalesce("breaker", F.lit("run")).alias("breaker"))


@query("noisy_domains", """
    SELECT 'd' || (user_id % 50) AS domain, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def noisy_domains(spark, folder):
    samples = Roles(spark, folder).samples.withColumn("domain", F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string")))
    return guardrails.noisy_domains(samples, "domain", F.col("failed"))


_UNION_SQL = """
    SELECT source_provider, source_label, count(*) AS mentions FROM (
        SELECT 'gnews' AS source_provider, CASE WHEN doc_id % 3 = 0 THEN 'special' ELSE 'gnews' END AS source_label FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT 'rss', 'rss' FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT 'serpapi', 'serpapi' FROM documents WHERE doc_id % 4 = 2
        UNION ALL SELECT 'configurable', 'configurable' FROM documents WHERE doc_id % 4 = 3) GROUP BY 1, 2
"""


@query("provider_union", _UNION_SQL)
def provider_union(spark, folder):
    raw = Roles(spark, folder).raw
    part = lambda i: raw.filter(F.col("mention_id") % 4 == i)
    labelled = part(0).withColumn("source_label", F.when(F.col("mention_id") % 3 == 0, F.lit("special")))
    joined = ingest.union_providers({"gnews": labelled, "rss": part(1).drop("lang"), "serpapi": part(2), "configurable": part(3).drop("platform"), "failed": None})
    return joined.groupBy("source_provider", "source_label").agg(F.count("*").alias("mentions"))


@query("provider_outcomes", """
    SELECT event_type AS provider, count(*) FILTER (WHERE event_id % 97 <> 0) AS mentions, CASE WHEN count(*) FILTER (WHERE event_id % 97 = 0 AND event_type = 'error') > 0 THEN 'error' ELSE 'success' END AS status FROM events GROUP BY 1""")
def provider_outcomes(spark, folder):
    results = Roles(spark, folder).table("events", "event_id", "event_type").selectExpr(
        "event_type as provider", "case when event_id % 97 <> 0 then 'https://x/' || event_id end as link",
        "case when event_id % 97 = 0 and event_type = 'error' then 'timeout' end as error",
    )
    return ingest.provider_outcomes(results).select("provider", "mentions", "status")


@query("stage_snapshot_rows", sql_with("raw") + r"""
    SELECT mention_id, platform, coalesce(title, '') AS title, regexp_replace(rtrim(link, '/'), '//www\.', '//') AS normalized_link,
           coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S') || 'Z', '-') AS published_at, lang, seq AS extra_seq
    FROM raw""")
def stage_snapshot_rows(spark, folder):
    known = ["source_provider", "source_label", "platform", "title", "content_teaser", "link"]
    shown = ingest.snapshot_rows(Roles(spark, folder).raw, known)
    extra = lambda k: F.element_at("extra", F.lit(k))
    return shown.select(
        extra("mention_id").cast("long").alias("mention_id"), "platform", "title", "normalized_link",
        F.coalesce("published_at", F.lit("-")).alias("published_at"), extra("lang").alias("lang"), extra("seq").cast("long").alias("extra_seq"),
    )


@query("snapshot_summary", """
    SELECT 'run1' AS run_id, '01_raw' AS stage, count(*) AS total_mentions, least(count(*), 500) AS exported_mentions, count(*) > 500 AS truncated, CAST(500 AS INTEGER) AS max_mentions FROM documents""")
def snapshot_summary(spark, folder):
    from newsloom.sinks.snapshots import snapshot

    _, summary = snapshot(Roles(spark, folder).raw, "run1", "01_raw", ["seq"])
    return summary.withColumn("exported_mentions", F.col("exported_mentions").cast("long"))


def _stages(spark, folder):
    r = Roles(spark, folder)
    raw = r.raw.withColumn("published_raw", F.date_format("published_at", "yyyy-MM-dd"))
    verdicts = r.table("labels", "doc_id", "quality").select(F.col("doc_id").alias("mention_id"), (F.col("quality") == 1).alias("relevant"))
    allowed = F.array(F.lit("en"), F.lit("da"))
    cutoff = F.lit("2024-01-28").cast("timestamp")
    profiles = cut_lineage(_profiles(spark, folder))
    return ingest.filter_mentions(raw, cutoff, ["brand_id"], profiles, allowed, verdicts)


@query("ingest_stage_counts")
def ingest_stage_counts(spark, folder):
    return ingest.stage_removals(_stages(spark, folder))


@query("ingest_drop_reasons", sql_with("raw") + r"""
    , x AS (SELECT seq, CASE WHEN mention_id % 7 <> 3 THEN rtrim(link, '/') END AS url,
                   CASE WHEN mention_id % 17 = 0 THEN 'unparseable_date' WHEN published_at IS NULL THEN 'missing_date' WHEN published_at < TIMESTAMP '2024-01-29' THEN 'before_cutoff' END AS reason FROM raw),
    d AS (SELECT reason, count(*) AS rows FROM x WHERE reason IS NOT NULL GROUP BY 1)
    SELECT n.reason, coalesce(d.rows, 0) AS rows FROM (VALUES ('missing_date'), ('unparseable_date'), ('before_cutoff')) n(reason) LEFT JOIN d ON d.reason = n.reason
    UNION ALL SELECT 'missing_link', count(*) FILTER (WHERE url IS NULL) FROM x WHERE reason IS NULL
    UNION ALL SELECT 'url_duplicate', count(url) - count(DISTINCT url) FROM x WHERE reason IS NULL""")
def ingest_drop_reasons(spark, folder):
    """Why rows went before the fuzzy stages, counted while the flow ran; some have no link, some no readable date."""
    raw = Roles(spark, folder).raw.withColumn("link", F.when(F.col("mention_id") % 7 != 3, F.col("link")))
    shown = F.when(F.col("mention_id") % 17 == 0, F.lit("once upon a time")).otherwise(F.date_format("published_at", "yyyy-MM-dd"))
    dated = raw.withColumns({"published_raw": shown, "published_at": F.when(F.col("mention_id") % 17 != 0, F.col("published_at"))})
    return ingest.drop_reasons(ingest.filter_mentions(dated, F.lit("2024-01-29").cast("timestamp"), ["brand_id"]))


@query("ingest_rows_to_store")
def ingest_rows_to_store(spark, folder):
    stages = _stages(spark, folder)
    platforms = Roles(spark, folder).table("documents", "source").distinct().select(F.xxhash64("source").alias("id"), F.col("source").alias("name"))
    mentions, _, _ = ingest.rows_to_store(stages.new, _keywords(spark, folder), platforms)
    return mentions.select("seq", "caption", "post_link", "topic_id", "primary_keyword_id")
