"""Filters, joins, ordered operators, guardrails and reports on literal rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators import filters, guardrails, joins, language, matching, ordered
from newsloom.operators.once import once
from newsloom.plans import digests, ingest, opsmetrics, reports

AS_OF = "2024-01-31 00:00:00"
NOON = dt.datetime(2024, 1, 30, 12)


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("ranged", [False, True])
def test_running_total_and_lag_across_buckets(spark, ranged):
    random.seed(1)
    rows = [(random.choice("ab"), i, random.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    bucket = None if ranged else F.floor(F.col("i") / 7)
    total = ordered.running_total(df, ["k"], ["i"], F.col("v"), bucket, "t")
    before = ordered.running_total(total, ["k"], ["i"], F.col("v"), bucket, "b", exclusive=True)
    lagged = ordered.previous_value(before, ["k"], ["i"], "v", bucket, "p")
    sums, last, want = {}, {}, []
    for k, i, v in rows:
        before_value = sums.get(k, 0)
        sums[k] = before_value + v
        want.append((k, i, sums[k], before_value, last.get(k)))
        last[k] = v
    assert _rows(lagged, "k", "i", "t", "b", F.coalesce("p", F.lit(-1))) == sorted((k, i, t, b, -1 if p is None else p) for k, i, t, b, p in want)


def test_once_keeps_the_value_and_blocks_reevaluation(spark):
    df = once(spark.range(5), y=F.col("id") * 2).filter("y > 4 and y < 8")
    assert _rows(df, "id", "y") == [(3, 6)]
    assert "Generate inline" in df._jdf.queryExecution().executedPlan().toString()


def test_due_brands(spark):
    rows = [(1, None, 24), (2, NOON - dt.timedelta(hours=12), 24), (3, NOON, 24), (4, NOON - dt.timedelta(hours=12), 0), (5, NOON, None)]
    df = spark.createDataFrame(rows, "id bigint, last_scraped_at timestamp, scrape_frequency_hours int")
    assert [r.id for r in filters.due_for_scrape(df, "2024-01-31 00:00:00").orderBy("id").collect()] == [1, 2, 4]


def test_locks(spark):
    rows = [(1, False, NOON), (2, True, NOON), (3, True, NOON + dt.timedelta(hours=11)), (4, None, None)]
    df = spark.createDataFrame(rows, "id bigint, scrape_in_progress boolean, scrape_started_at timestamp")
    assert _rows(df, "id", filters.lock_state(AS_OF).alias("s")) == [(1, "free"), (2, "stale"), (3, "active"), (4, "free")]


def test_feed_and_sitemap_prefilters(spark):
    df = spark.createDataFrame([("Vindkraft i dag", None, "u"), (None, None, "u"), ("Andet", "om VIND", "u"), ("Andet", "nej", "u")], "t string, s string, l string")
    wanted = F.array(F.lit("vind"))
    assert [r[0] for r in df.select(filters.feed_item_matches("t", "s", wanted)).collect()] == [True, True, True, False]
    links = spark.createDataFrame([("", "https://x.dk/ny-vindmoelle-park"), ("Andet", "https://x.dk/vindmoelle"), (None, "https://x.dk/sport")], "t string, l string")
    tokens = F.array(F.lit("vindmoelle på"), F.lit("ny"))
    assert [r[0] for r in links.select(filters.sitemap_item_matches("t", "l", tokens)).collect()] == [True, False, False]


def test_relevance_is_fail_open(spark):
    rows = spark.range(4).withColumnRenamed("id", "k")
    verdicts = spark.createDataFrame([(0, True), (1, False), (2, None)], "k bigint, relevant boolean")
    assert _rows(filters.keep_relevant(rows, verdicts, "k", "relevant"), "k") == [(0,), (2,), (3,)]


def test_strong_or_fallback(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 1), (2, 0)], "run bigint, score bigint")
    assert _rows(filters.strong_or_fallback(df, "run", "score"), "run", "score") == [(1, 2), (2, 1)]


def test_breaker_opens_after_thresholds(spark):
    rows = [("a", i, i < 5, False) for i in range(7)] + [("b", i, False, True) for i in range(10)]
    df = spark.createDataFrame(rows, "domain string, seq bigint, failed boolean, blind boolean")
    out = guardrails.with_breaker(df, ["domain"], ["seq"], F.floor(F.col("seq") / 3), F.col("blind"), F.col("failed"))
    skipped = _rows(out.filter("breaker is not null"), "domain", "seq", "breaker")
    assert skipped == [("a", 5, "circuit_open_skip"), ("a", 6, "circuit_open_skip"), ("b", 8, "blind_circuit_skip"), ("b", 9, "blind_circuit_skip")]


def test_longest_suffix_wins(spark):
    pages = spark.createDataFrame([("a.b.x.dk",), ("c.x.dk",), ("y.dk",), ("dk",)], "host string")
    configs = spark.createDataFrame([("x.dk",), ("b.x.dk",), ("dk",)], "domain string")
    got = _rows(joins.longest_suffix(pages, "host", configs), "host", F.coalesce("config_domain", F.lit("-")))
    assert got == [("a.b.x.dk", "b.x.dk"), ("c.x.dk", "x.dk"), ("dk", "dk"), ("y.dk", "-")]


def test_topic_choice_and_primary_keyword(spark):
    mentions = spark.createDataFrame(
        [(1, 1, "Havvind og offshore wind", "om atomkraft"), (1, 2, "Atomkraft", "havvind"), (1, 3, "Intet", ""), (1, 4, "C++ i dag", None)],
        "brand_id bigint, mention_id bigint, title string, content_teaser string",
    )
    keywords = spark.createDataFrame(
        [(1, 10, 1, "havvind"), (1, 10, 2, "offshore wind"), (1, 20, 3, "atomkraft"), (1, 30, 4, "++"), (2, 40, 5, "intet")],
        "brand_id bigint, topic_id bigint, keyword_id bigint, keyword string",
    )
    found = matching.phrase_matches(mentions, keywords)
    assert _rows(found, "mention_id", "keyword_id", "matched_in") == [(1, 1, "title"), (1, 2, "title"), (1, 3, "teaser"), (2, 1, "teaser"), (2, 3, "title")] 
    topics = matching.best_topics(found)
    assert _rows(topics, "mention_id", "topic_id", "score") == [(1, 10, 2), (2, 10, 1)]
    assert _rows(matching.primary_keywords(found, topics), "mention_id", "primary_keyword_id") == [(1, 2), (2, 1)]


def test_symbol_only_keyword(spark):
    mentions = spark.createDataFrame([(1, 1, "se ++ her", "")], "brand_id bigint, mention_id bigint, title string, content_teaser string")
    keywords = spark.createDataFrame([(1, 1, 1, "++")], "brand_id bigint, topic_id bigint, keyword_id bigint, keyword string")
    assert matching.phrase_matches(mentions, keywords).count() == 1


def test_language_detection_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang", "left(split_part(text, '\n', 1), 120) as title")
    profiles = language.train_profiles(docs, "text", "lang")
    judged = language.detect(docs.filter("length(title) >= 15"), "doc_id", "title", profiles).join(docs, "doc_id")
    right, total = judged.selectExpr("count_if(detected = lang)", "count(*)").first()
    assert total > 50 and right / total > 0.85


def test_language_filter_keeps_short_and_free_rows(spark):
    profiles = spark.createDataFrame([("da", "_og", 3), ("en", "the", 3)], "language string, gram string, weight bigint")
    rows = [(1, "kort"), (2, "her og der og alle vegne"), (3, "the other one of these"), (4, "zzzzzzzzzzzzzzzzzzzzz")]
    df = spark.createDataFrame(rows, "k bigint, title string")
    kept = language.filter_by_language(df, "k", "title", profiles, F.array(F.lit("da")))
    assert _rows(kept, "k") == [(1,), (2,), (4,)]
    free = language.filter_by_language(df, "k", "title", profiles, F.lit(None).cast("array<string>"))
    assert free.count() == 4


def test_adaptive_window_stops_or_keeps_the_largest(spark):
    stamp = lambda days: dt.datetime(2024, 1, 31) - dt.timedelta(days=days)
    rows = [(1, stamp(0.5))] * 30 + [(2, stamp(0.5))] * 3 + [(2, stamp(1.5))] * 2 + [(3, stamp(0.5))] * 2
    df = spark.createDataFrame(rows, "brand_id bigint, created_at timestamp")
    got = _rows(reports.adaptive_window(df, AS_OF, 1, 50), "brand_id", "effective_days", "effective_limit", "rows")
    assert got == [(1, 1, 50, 30), (2, 2, 150, 5), (3, 1, 50, 2)]


def test_digest_blocks_split_and_order(spark):
    rows = [(i, 1, "t", "p", NOON + dt.timedelta(minutes=i), i == 0, f"c{i}", f"https://x/{i}") for i in range(46)]
    df = spark.createDataFrame(rows, "id bigint, brand_id bigint, topic string, platform string, created_at timestamp, notified_status boolean, caption string, post_link string")
    blocks = digests.digest_blocks(df, spark.createDataFrame([(1, "B")], "id bigint, name string"), "foot").orderBy("part", "topic", "block").collect()
    assert [b.part for b in blocks] == [0, 1, 2, 2, 2, 2, 3]
    assert "_45 new mentions found_" in blocks[0].json and blocks[3].json.count("•") == 20 and blocks[5].json.count("•") == 5
    assert "<https://x/1|c1> (p)" in blocks[3].json and '"foot"' in blocks[-1].json


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([("a", v) for v in (0.1, 0.5, 3.0, 999.0)], "k string, value double")
    buckets = opsmetrics.histogram(df, ["k"], (0.5, 1, 5))
    assert _rows(buckets, "le", "bucket_count") == [(0.5, 2), (1.0, 2), (5.0, 3), (float("inf"), 4)]
    assert opsmetrics.quantile(buckets, ["k"], 0.5).first()["quantile"] == pytest.approx(0.5)
    assert opsmetrics.quantile(buckets, ["k"], 0.95).first()["quantile"] == 5.0


def test_increases_survive_counter_resets(spark):
    stamps = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=40 * i) for i in range(5)]
    df = spark.createDataFrame(list(zip(["a"] * 5, stamps, [1.0, 4.0, 2.0, 2.0, 7.0])), "k string, ts timestamp, value double")
    grown = [r.increase for r in opsmetrics.increases(df, ["k"]).orderBy("ts").collect()]
    assert grown == [None, 3.0, 2.0, 0.0, 5.0]


def test_sustained_needs_the_full_hold(spark):
    at = list(range(0, 600, 60)) + list(range(1200, 1500, 60))
    df = spark.createDataFrame([("d", t, True) for t in at] + [("d", 660, False)], "k string, at bigint, firing boolean")
    got = _rows(opsmetrics.sustained(df, ["k"], "at", "firing", 60, 300, "warning", bucket_s=240), "pending_since", "firing_since", "last_firing")
    assert got == [(0, 300, 540)]


def test_unions_fill_provenance_and_skip_failed_providers(spark):
    a = spark.createDataFrame([(1, "x")], "seq bigint, title string")
    b = spark.createDataFrame([(2, "y", "site")], "seq bigint, title string, source_label string")
    out = ingest.union_providers({"gnews": a, "rss": None, "configurable": b})
    assert _rows(out, "seq", "source_provider", "source_label") == [(1, "gnews", "gnews"), (2, "configurable", "site")]


def test_config_validation_and_strategy(spark):
    schema = "domain string, title_selector string, content_selector string, date_selector string, search_url_pattern string, rss_urls array<string>, sitemap_url string, discovery_type string"
    good = ("x.dk", "h1", None, None, "https://x.dk/?q={keyword}", None, None, None)
    cases = [
        (good, None), (("", *good[1:]), "empty_domain"), ((*good[:4], "https://x.dk/?q=", *good[5:]), "pattern_without_keyword"),
        ((*good[:4], "x.dk/{keyword}", *good[5:]), "pattern_not_absolute"), ((*good[:5], ["feed"], None, None), "feed_not_absolute"),
        ((*good[:5], [], None, "rss"), "rss_without_feeds"), ((*good[:5], None, " ", "sitemap"), "sitemap_without_url"),
        ((*good[:4], None, None, None, "site_search"), "search_without_pattern"), (("x.dk", "h" * 501, *good[2:]), "field_too_long"),
        ((*good[:7], "ftp"), "unknown_strategy"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], schema)
    assert [r[0] for r in df.select(filters.config_reject_reason()).collect()] == [w for _, w in cases]


def test_report_type_check_and_name_resolution(spark):
    df = spark.createDataFrame([("weekly",), ("daily",), (None,)], "report_type string")
    ok, bad = reports.valid_reports(df)
    assert (ok.count(), bad.count()) == (1, 2)
    brands = spark.createDataFrame([(7, " ACME "), (3, "acme")], "id bigint, name string")
    asked = spark.createDataFrame([("Acme",), ("none",)], "brand_name string")
    assert _rows(joins.resolve_names(asked, brands), "brand_name", F.coalesce("brand_id", F.lit(-1))) == [("Acme", 3), ("none", -1)]


def test_keyword_capping_reports_what_it_drops(spark):
    df = spark.createDataFrame([(1, i, f"k{i % 4}") for i in range(6)], "run_id bigint, seq bigint, keyword string")
    kept, dropped = joins.cap_keywords(joins.distinct_keywords(df, ["run_id"]), ["run_id"], 3)
    assert kept.count() == 3 and dropped.first()["dropped"] == 1


def test_taxonomy_tree_nests_and_keeps_empty_brands(spark):
    brands = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    topics = spark.createDataFrame([(10, 1, "t")], "id bigint, brand_id bigint, name string")
    links = spark.createDataFrame([(10, 5), (10, 4)], "topic_id bigint, keyword_id bigint")
    words = spark.createDataFrame([(4, "x"), (5, "y")], "id bigint, text string")
    tree = {r.id: r.topics for r in joins.taxonomy_tree(brands, topics, links, words).collect()}
    assert tree[2] is None and [k.text for k in tree[1][0].keywords] == ["x", "y"]


def test_an_open_set_of_languages_leaves_foreign_titles_undetected(spark):
    from newsloom.operators import language

    samples = spark.createDataFrame([("the weather and the wind with them", "en"), ("und der wind mit dem wetter", "de")], "body string, lang string")
    profiles = language.train_profiles(samples, "body", "lang")
    titles = [(1, "the wind and the weather"), (2, "der wind und das wetter"), (3, "qsi zoxu kaji yabo"), (4, "wind wind wind"), (5, "")]
    df = spark.createDataFrame(titles, "id bigint, title string")
    found = lambda **more: {r.id: r.detected for r in language.detect(df, "id", "title", profiles, **more).collect()}
    assert found()[1] == "en" and found()[2] == "de" and 4 in found() and 5 not in found()
    assert found(least_known=0.5) == {1: "en", 2: "de", 4: found()[4]}
    # "wind" is in both profiles, so neither is clearly ahead.
    assert 4 not in found(least_known=0.5, least_margin=0.2) and 1 in found(least_known=0.5, least_margin=0.2)
    kept = language.filter_by_language(df.withColumn("title", F.concat("title", F.lit(" " * 20))), "id", "title", profiles, F.array(F.lit("de")), 0.5)
    assert {r.id for r in kept.collect()} >= {2, 3, 5} and 1 not in {r.id for r in kept.collect()}


def test_titles_leave_their_task_as_sums(spark):
    """Neither trigrams nor words are shuffled: what a task holds does not grow with the texts."""
    rows = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "die katze und der hund", "de")], "id bigint, body string, lang string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    profiles = language.train_profiles(rows, "body", "lang")
    assert not re.search(r"hashpartitioning\([^)]*word", plan(profiles))
    for more in ((), (0.6, 0.1)):
        assert "hashpartitioning(gram" not in plan(language.detect(rows, "id", "body", profiles, *more)).replace("id#", "id")


def test_detection_sums_rows_of_one_key(spark):
    """A key that stands twice is one text; words count as often as they occur, and a word without a known trigram only in the share."""
    profiles = spark.createDataFrame([("en", "_th", 3), ("en", "the", 2), ("de", "_de", 4)], "language string, gram string, weight bigint")
    rows = spark.createDataFrame([(1, "the the"), (1, "der"), (2, "zzz"), (3, "der xyz")], "id bigint, body string")
    assert {tuple(r) for r in language.detect(rows, "id", "body", profiles).collect()} == {(1, "en"), (3, "de")}
    # 4 of 9 trigrams of key 1 are English ones; 1 of 6 of key 3 is German.
    assert {tuple(r) for r in language.detect(rows, "id", "body", profiles, 0.4, 0.1).collect()} == {(1, "en")}
