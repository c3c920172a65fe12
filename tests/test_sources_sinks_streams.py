"""Landed files, stored tables and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions import url
from newsloom.operators import filters
from newsloom.plans import ingest as plans_ingest
from newsloom.schemas import MENTION, MENTION_KEYWORD
from newsloom.session import shared_folder
from newsloom.sinks import snapshots, tables
from newsloom.sources import feeds, lines, pages, payloads
from newsloom.streaming import alerts, ingest

AS_OF = "2024-01-31 00:00:00"


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def folder(spark):
    return shared_folder(spark)


def test_feed_files(spark, tmp_path):
    (tmp_path / "rss.xml").write_text(
        "<rss><channel><item><title>Vind &amp; vejr</title><link> https://x.dk/indland/1234567?utm=1 </link>"
        "<pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Uden link</title></item></channel></rss>"
    )
    items = feeds.read_xml(spark, str(tmp_path / "rss.xml"), "item", feeds.RSS_ITEM)
    assert items.count() == 2
    (tmp_path / "map.xml").write_text(
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'
        "<url><loc>https://x.dk/a</loc><lastmod>2024-01-01</lastmod><news:news><news:publication_date>2024-01-30</news:publication_date>"
        "<news:title>T</news:title></news:news></url></urlset>"
    )
    found = feeds.read_xml(spark, str(tmp_path / "map.xml"), "url", feeds.SITEMAP_URL).first()
    assert (found.loc, found.news.publication_date, found.news.title) == ("https://x.dk/a", "2024-01-30", "T")


def test_discovery_is_lenient_about_dates_and_distinct(spark):
    item = "<item><title>{}</title><link>https://www.x.dk/indland/{}</link>{}</item>"
    rows = [
        (item.format("vind", 1234567, "<pubDate>2024-01-30</pubDate>"),), (item.format("vind", 1234567, ""),),
        (item.format("vind", 7654321, "<pubDate>2023-01-30</pubDate>"),), (item.format("andet", 1111111, ""),),
    ]
    df = spark.createDataFrame(rows, "xml string").withColumn("domain", F.lit("x.dk"))
    found = feeds.discovered_urls(feeds.rss_items(df, AS_OF), F.lit("2024-01-29").cast("timestamp"), F.array(F.lit("vind")))
    assert _rows(found, "url") == [("https://x.dk/indland/1234567",)]


def test_search_payload_shapes(spark):
    news = {"news_results": [{"title": "a", "link": "l1", "iso_date": "2024-01-30T00:00:00Z", "source": {"name": "DR"}}]}
    organic = {"organic_results": [{"url": "l2", "date": "2 days ago", "source": "TV2"}, {"link": "l3"}]}
    error = {"error": "limit reached", "news_results": [{"title": "ignored"}]}
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate((news, organic, error))], "id bigint, payload string")
    open_ended = payloads.search_results(df, None, AS_OF)
    assert _rows(open_ended, "link", "title", "platform", "date_imputed") == [
        ("l1", "a", "DR", False), ("l2", "No title", "TV2", False), ("l3", "No title", "Google", True)
    ]
    strict = payloads.search_results(df, F.lit("2024-01-30").cast("timestamp"), AS_OF)
    assert _rows(strict, "link", F.coalesce("skip_reason", F.lit("kept"))) == [("l1", "kept"), ("l2", "before_cutoff"), ("l3", "missing_date")]
    assert payloads.payload_errors(df).first()["error_type"] == "api_limit_reached"


def test_article_extraction_levels(spark):
    body = "Lang tekst om havvind. " * 6
    rows = [
        (1, "https://a.x.dk/1", f"<div class='c'>{body}</div><h1>T</h1><time datetime='2024-01-30'>i går</time>", "x.dk", "h1", ".c", "time"),
        (2, "https://y.dk/2", f"<article><h1>G</h1>{body}</article><span class='date'>30.01.2024</span>", None, None, None, None),
        (3, "https://z.dk/3", f"<title>P</title><p>{body}</p>" + "<i></i>" * 100, None, None, None, None),
        (4, "https://w.dk/4", "<p>kort</p>", None, None, None, None),
        (5, "https://v.dk/5", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, config_domain string, title_selector string, content_selector string, date_selector string")
    got = _rows(pages.extract_articles(df), "page_id", "title", "extracted_via", "date_raw", "date_from_attribute")
    assert got == [
        (1, "T", "config", "2024-01-30", True), (2, "G", "generic", "30.01.2024", False), (3, "P", "page", "", False),
        (4, "", "none", "", False), (5, "", "none", "", False),
    ]


def test_selector_suggestions_pass_quality_gates(spark):
    body = "x" * 60
    html = f"<article><h1>A proper headline</h1>{body}</article><time datetime='2024-01-30'>n</time>"
    df = spark.createDataFrame([(1, html), (2, "<h1>tiny</h1>")], "page_id bigint, html string")
    domains = spark.createDataFrame([(1, "x.dk"), (2, "y.dk")], "page_id bigint, domain string")
    found = pages.suggest_selectors(pages.selector_hits(df), domains).collect()
    assert [(r.domain, r.title_selector, r.content_selector, r.date_selector) for r in found] == [("x.dk", "article h1", "article", "time[datetime]")]
    short = pages.suggested_selector_hits(df).filter("page_id = 1 and rank = 0").select("field").collect()
    assert sorted(r.field for r in short) == ["date", "title"]


def test_robots_and_metric_lines(spark):
    robots = spark.createDataFrame([("x", "User-agent: *\nSitemap: https://x/a.xml\nsitemap:https://x/News.xml\nSitemap: https://x/news2.xml")], "domain string, body string")
    assert _rows(pages.robots_sitemaps(robots), "news_sitemap", "other_sitemap") == [("https://x/News.xml", "https://x/a.xml")]
    text = spark.createDataFrame([('scrape_runs_total{scope="brand",status="success"} 3',), ("# HELP x",), ("other 1",), ("scrape_up 1.5e3",), ("broken",)], "value string")
    got = {r.name: (r.labels, r.value) for r in lines.metric_samples(text).collect()}
    assert got == {"scrape_runs_total": ({"scope": "brand", "status": "success"}, 3.0), "scrape_up": ({}, 1500.0)}


def test_links_without_brand_names(spark):
    df = spark.createDataFrame([(1, "x.dk", '<a href="/indland/1234567">a</a><A class=b HREF=\'https://x.dk/indland/1234567/\'>b</A><a href="">c</a>')], "page_id bigint, domain string, html string")
    found = pages.candidate_links(pages.page_links(df, "domain"))
    assert _rows(found, "url") == [("https://x.dk/indland/1234567",)]
    assert df.select(url.platform_from_url(F.lit("https://www.dr.dk"))).first()[0] == "dr.dk"


# --- sinks -----------------------------------------------------------------------------------------

BATCH = "seq bigint, caption string, post_link string, topic_id bigint, brand_id bigint"


def _batch(spark, rows):
    df = spark.createDataFrame(rows, BATCH)
    for f in MENTION.fields:
        if f.name not in df.columns and f.name not in ("id", "created_at", "created_date"):
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def test_insert_ignore_is_idempotent_and_numbers_rows(spark, folder):
    path = f"{folder}/mentions"
    first = _batch(spark, [(1, "old", "l1", 1, 1), (2, "new", "l1", 1, 1), (3, "x", "l2", 1, 1), (4, "y", None, 1, 1), (5, "z", "l3", None, 1)])
    stamp = F.lit("2024-01-30").cast("timestamp")
    args = (path, MENTION, ["post_link", "topic_id"], stamp, "created_date")
    assert tables.insert_ignore(spark, first, *args) == 2
    assert tables.insert_ignore(spark, first, *args) == 0
    assert tables.insert_ignore(spark, _batch(spark, [(1, "again", "l1", 1, 1), (2, "other", "l1", 2, 1)]), *args) == 1
    stored = spark.read.schema(MENTION).parquet(path)
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3]
    assert _rows(stored, "post_link", "topic_id", "caption") == [("l1", 1, "new"), ("l1", 2, "other"), ("l2", 1, "x")]


def test_update_rewrites_only_touched_partitions(spark, folder):
    path = f"{folder}/mentions"
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp")
    for d, link in ((29, "a"), (30, "b")):
        tables.insert_ignore(spark, _batch(spark, [(1, link, link, 1, 1)]), path, MENTION, ["post_link", "topic_id"], day(d), "created_date")
    keys = spark.createDataFrame([("a",)], "post_link string")
    tables.update_partitions(spark, path, MENTION, keys, "post_link", "created_date", notified_status=True)
    stored = spark.read.schema(MENTION).parquet(path)
    assert _rows(stored, "post_link", F.coalesce("notified_status", F.lit(False))) == [("a", True), ("b", False)]


def test_source_config_upsert_clears_discovery_fields_only(spark):
    schema = "domain string, title_selector string, search_url_pattern string, rss_urls array<string>, sitemap_url string, discovery_type string"
    old = spark.createDataFrame([("a.dk", "h1", "p", ["f"], "s", "rss"), ("b.dk", "h2", None, None, None, None)], schema)
    new = spark.createDataFrame([("https://www.A.dk/", None, None, None, "s2", "sitemap"), ("c.dk", "h3", None, None, None, None)], schema)
    got = {r.domain: tuple(r)[1:] for r in tables.merge_source_configs(old, new).collect()}
    assert got["a.dk"] == ("h1", None, None, "s2", "sitemap")
    assert got["b.dk"][0] == "h2" and got["c.dk"][0] == "h3" and len(got) == 3


def test_cascade_and_dry_run_counts(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    content = {
        "brands": frame([(1,), (2,)], "id bigint"), "topics": frame([(10, 1), (20, 2)], "id bigint, brand_id bigint"),
        "mentions": frame([(100, 1, 10), (200, 2, 20)], "id bigint, brand_id bigint, topic_id bigint"),
    }
    links = [("topics", "brand_id", "brands", "id"), ("mentions", "topic_id", "topics", "id"), ("mentions", "brand_id", "brands", "id")]
    left, gone = tables.cascade(content, "brands", frame([(1,)], "id bigint"), links)
    assert _rows(tables.deletion_counts(gone), "table_name", "rows") == [("brands", 1), ("mentions", 1), ("topics", 1)]
    assert {n: df.count() for n, df in left.items()} == {"brands": 1, "topics": 1, "mentions": 1}


def test_get_or_create_gives_every_text_one_id(spark):
    dim = spark.createDataFrame([(5, "dr.dk")], "id bigint, name string")
    wanted = spark.createDataFrame([("dr.dk",), ("tv2.dk",), ("tv2.dk",), ("",), ("bt.dk",)], "platform string")
    fresh, complete = tables.get_or_create(dim, wanted, "platform")
    assert sorted(r.id for r in fresh.collect()) == [6, 7]
    assert sorted(r.name for r in complete.collect()) == ["bt.dk", "dr.dk", "tv2.dk"]


def test_snapshots_and_metadata(spark, folder):
    df = spark.range(7).withColumnRenamed("id", "seq")
    exported, summary = snapshots.snapshot(df, "r1", "s1", ["seq"], 5)
    assert exported.count() == 5
    assert summary.first().asDict() == {"run_id": "r1", "stage": "s1", "total_mentions": 7, "exported_mentions": 5, "truncated": True, "max_mentions": 5}
    snapshots.write_snapshot(df, folder, "r1", "s1", ["seq"])
    snapshots.write_run_metadata(spark, f"{folder}/meta", "r1", {"providers": 4, "cutoff": None})
    assert spark.read.json(f"{folder}/mentions").count() == 7
    assert spark.read.json(f"{folder}/meta").first()["metadata"]["providers"] == "4"


# --- streams ---------------------------------------------------------------------------------------


def _drain(spark, stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_streamed_mentions_with_links_and_replay(spark, folder):
    rows = [(1, "a", "l1", 1, 1), (2, "b", "l1", 1, 1), (3, "c", "l2", 2, 1)]
    _batch(spark, rows).withColumn("published_at", F.lit("2024-01-30").cast("timestamp")).write.parquet(f"{folder}/landed")
    landed = spark.read.parquet(f"{folder}/landed")
    links = spark.createDataFrame([("l1", 1, 7, "title", 1), ("l1", 1, 8, "both", 1)], "post_link string, topic_id bigint, keyword_id bigint, matched_in string, score int")
    for run in ("one", "two"):
        stream = ingest.landed(spark, f"{folder}/landed", landed.schema)
        ingest.write_mentions(stream, f"{folder}/mentions", f"{folder}/{run}", lambda b: (b, links), link_path=f"{folder}/links").awaitTermination()
    assert spark.read.schema(MENTION).parquet(f"{folder}/mentions").count() == 2
    assert spark.read.schema(MENTION_KEYWORD).parquet(f"{folder}/links").count() == 2


def test_stream_link_dedup_equals_batch(spark, folder):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, f"https://www.x.dk/{i % 5}/?q={i}", base + dt.timedelta(hours=i)) for i in range(40)]
    spark.createDataFrame(rows, "brand_id bigint, link string, published_at timestamp").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("brand_id bigint, link string, published_at timestamp").parquet(f"{folder}/in")
    assert _drain(spark, ingest.unique_links(stream), folder).count() == 5


def test_stream_sustained_alert(spark, folder):
    firing = [(60 * i, i not in (3,)) for i in range(20)]
    rows = [("d", at, on) for at, on in firing]
    spark.createDataFrame(rows, "domain string, window_end bigint, firing boolean").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("domain string, window_end bigint, firing boolean").parquet(f"{folder}/in")
    out = _drain(spark, alerts.sustained(stream, ["domain"], "domain string", 60, 600, "warning"), folder)
    assert _rows(out, "domain", "pending_since", "firing_since", "severity") == [("d", 240, 840, "warning")]


def test_stream_breaker(spark, folder):
    """Counts go on from batch to batch, and a batch may come in any order and size."""
    schema = "domain string, seq bigint, blind boolean, failed boolean"
    read = spark.readStream.schema(schema)
    for start, end in ((0, 3), (3, 9)):
        rows = [("a", i, False, i < 6) for i in reversed(range(start, end))] + [("b", i, True, False) for i in range(start, end)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{folder}/in")
        alerts.judge_extractions(read.parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    out = spark.read.schema("domain string, seq bigint, breaker string").parquet(f"{folder}/out/rows")
    assert _rows(out.filter("breaker is not null"), "domain", "seq", "breaker") == [
        *(("a", i, "circuit_open_skip") for i in (5, 6, 7, 8)), ("b", 8, "blind_circuit_skip"),
    ]
    assert out.count() == 18


def test_breaker_over_many_files_of_one_domain(spark, folder):
    """Rows of a domain over many files and Arrow frames, in no order: as if sorted first."""
    rows = [("a", i, i % 4000 == 7, i % 9000 == 11) for i in range(60_000)]
    schema = "domain string, seq bigint, blind boolean, failed boolean"
    spark.createDataFrame(rows, schema).repartition(4, "blind", "failed", (F.col("seq") % 7)).write.parquet(f"{folder}/in")
    out = _drain(spark, alerts.breakers(spark.readStream.schema(schema).parquet(f"{folder}/in")), folder)
    blind = failed = wrong = 0
    got = {r.seq: r.breaker for r in out.collect()}
    for _, seq, is_blind, has_failed in rows:
        want = "circuit_open_skip" if failed >= 5 else "blind_circuit_skip" if blind >= 8 else None
        wrong += got[seq] != want
        blind, failed = blind + is_blind, failed + has_failed
    assert wrong == 0 and len(got) == len(rows)


def test_breaker_stream_goes_on_from_batch_to_batch(spark, folder):
    """Counts are kept, a missing flag counts for nothing, and the verdicts are those of ``judge_extractions``."""
    schema = "domain string, seq bigint, blind boolean, failed boolean"
    read, judged = spark.readStream.schema(schema), "domain string, seq bigint, breaker string"
    for start, end in ((0, 4), (4, 7), (7, 12)):
        rows = [("a", i, None, i < 6) for i in reversed(range(start, end))] + [("b", i, True, None) for i in range(start, end)]
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{folder}/in")
        got = _drain(spark, alerts.breakers(read.parquet(f"{folder}/in")), folder)
        alerts.judge_extractions(read.parquet(f"{folder}/in"), f"{folder}/other", f"{folder}/other/state").awaitTermination()
    want = spark.read.schema(judged).parquet(f"{folder}/other/rows")
    assert _rows(got, "domain", "seq", "breaker") == _rows(want, "domain", "seq", "breaker")
    assert _rows(got.filter("breaker is not null"), "domain", "seq") == [*(("a", i) for i in range(5, 12)), *(("b", i) for i in range(8, 12))]


def test_items_with_other_namespaces(spark):
    xml = """<item><title>Real</title><link>https://a.dk/1</link><atom:link href="https://a.dk/feed" rel="self"/>
        <media:title>Photo</media:title><description><![CDATA[see <https://x.dk/y:z>]]></description></item>"""
    found = feeds.rss_items(spark.createDataFrame([(xml,)], "xml string"), AS_OF).first()
    assert (found.title, found.link, found.summary) == ("Real", "https://a.dk/1", "see <https://x.dk/y:z>")


def test_no_keywords_and_no_cutoff_keep_everything(spark):
    items = spark.createDataFrame([("t", "s", None), ("u", "", "x")], "title string, summary string, link string")
    none = F.array().cast("array<string>")
    assert [r[0] for r in items.select(filters.feed_item_matches("title", "summary", none)).collect()] == [True, True]
    assert [r[0] for r in items.select(filters.sitemap_item_matches("title", "link", none)).collect()] == [True, True]
    dated = items.withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    assert filters.lenient_since(dated, None).count() == filters.lenient_since(dated, F.lit(None).cast("timestamp")).count() == 2


def test_upsert_takes_the_last_row_of_a_domain(spark):
    schema = "domain string, title_selector string, seq bigint"
    old = spark.createDataFrame([("a.dk", "h1", 0)], schema)
    new = spark.createDataFrame([("a.dk", "h2", 1), ("https://www.a.dk/", "h3", 2)], schema)
    assert [tuple(r)[:2] for r in tables.merge_source_configs(old, new).select("domain", "title_selector").collect()] == [("a.dk", "h3")]


def test_mentions_of_new_platforms_are_stored(spark):
    mentions = spark.createDataFrame(
        [(i, i, 1, "vind og sol", "", f"https://a.dk/{i}", p) for i, p in enumerate(("Old", " New ", "", None))],
        "mention_id bigint, seq bigint, brand_id bigint, title string, content_teaser string, link string, platform string",
    ).withColumn("published_at", F.lit(None).cast("timestamp"))
    words = spark.createDataFrame([(1, 5, 7, "vind")], "brand_id bigint, topic_id bigint, keyword_id bigint, keyword string")
    platforms = spark.createDataFrame([(3, "Old")], "id bigint, name string")
    rows, links, fresh = plans_ingest.rows_to_store(mentions, words, platforms, min_matches=1)
    assert rows.count() == links.count() == 4
    assert sorted(r.name for r in fresh.collect()) == ["New", "Unknown"]


def test_fuzzy_horizon_against_stored_mentions(spark, folder):
    path = f"{folder}/mentions"
    old = _batch(spark, [(1, "en to tre fire fem havvind park", "https://a.dk/1", 1, 1)])
    tables.insert_ignore(spark, old, path, MENTION, ["post_link", "topic_id"], F.lit("2024-01-30").cast("timestamp"), "created_date")
    new = spark.createDataFrame(
        [(9, 1, "En to tre fire fem park havvind!", "", "https://a.dk/2", ""), (10, 1, "Noget helt andet om en fond", "", "https://a.dk/3", "")],
        "seq bigint, brand_id bigint, title string, content_teaser string, link string, platform string",
    ).withColumn("published_at", F.lit(None).cast("timestamp"))
    assert _rows(ingest.without_recent_stories(new, path, AS_OF, spark), "seq") == [(10,)]
