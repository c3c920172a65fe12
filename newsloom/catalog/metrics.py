"""Operational metrics, alert windows and streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import settings
from newsloom.catalog.common import AS_OF, Roles, query, sql_with
from newsloom.functions import text
from newsloom.plans import alert_rules, opsmetrics
from newsloom.session import prepare
from newsloom.streaming import alerts, ingest as stream_ingest

_BOUNDS = settings.HISTOGRAM_BUCKETS["scrape_provider_duration_seconds"]
_EDGES = ", ".join(f"({float(b)!r}::DOUBLE)" for b in _BOUNDS) + ", ('infinity'::DOUBLE)"
_HIST_SQL = f"""
    WITH b(le) AS (VALUES {_EDGES}), p AS (SELECT DISTINCT event_type AS provider FROM events),
    h AS (SELECT p.provider, b.le, (SELECT count(*) FROM events e WHERE e.event_type = p.provider AND e.value <= b.le) AS bucket_count FROM p, b)
"""


def _histogram(spark, folder):
    return opsmetrics.histogram(Roles(spark, folder).samples, ["provider"], _BOUNDS)


@query("metric_histogram", _HIST_SQL + "SELECT provider, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, bucket_count FROM h")
def metric_histogram(spark, folder):
    finite = F.when(F.col("le") == float("inf"), F.lit(-1.0)).otherwise(F.col("le"))
    return _histogram(spark, folder).withColumn("le", finite)


@query("metric_histogram_p95", _HIST_SQL + """
    , r AS (SELECT *, max(bucket_count) OVER (PARTITION BY provider) * 0.95::DOUBLE AS rank, coalesce(lag(bucket_count) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS floor FROM h WINDOW w AS (PARTITION BY provider ORDER BY le)),
    f AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY le) AS n FROM r WHERE bucket_count >= rank)
    SELECT provider, round(CASE WHEN isinf(le) THEN floor ELSE floor + (le - floor) * (rank - below) / (bucket_count - below) END, 4) AS p95 FROM f WHERE n = 1""")
def metric_histogram_p95(spark, folder):
    return opsmetrics.quantile(_histogram(spark, folder), ["provider"], 0.95).select("provider", F.round("quantile", 4).alias("p95"))


@query("labelled_counters", """
    SELECT 'scrape_' || event_type AS name, 'd' || (user_id % 10) AS domain, CAST(sum(event_id % 10) AS BIGINT) AS total FROM events GROUP BY ALL""")
def labelled_counters(spark, folder):
    samples = Roles(spark, folder).samples.selectExpr("'scrape_' || provider as name", "upper(domain) || ' ' as domain", "event_id % 10 as value")
    return opsmetrics.counters(samples, ["domain"])


_MINUTES = """
    WITH m AS (SELECT 'd' || (user_id % 10) AS domain, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS s, count(*) FILTER (WHERE event_type <> 'error') AS good, count(*) AS everything FROM events GROUP BY ALL),
    w AS (SELECT domain, s + i * 60 AS window_end, CAST(sum(good) AS BIGINT) AS good, CAST(sum(everything) AS BIGINT) AS everything FROM m, range(1, {n} + 1) t(i) GROUP BY ALL)
"""


def _sums():
    return {"good": (~F.col("failed")).cast("long"), "everything": F.lit(1).cast("long")}


@query("sliding_rates_15m", _MINUTES.format(n=15) + """
    SELECT domain, window_end, good, everything, good / 900.0::DOUBLE AS good_rate, everything / 900.0::DOUBLE AS everything_rate FROM w""")
def sliding_rates_15m(spark, folder):
    return opsmetrics.rates(Roles(spark, folder).samples, ["domain"], 900, _sums())


# The rule's own floor (0.20 of at least 0.1 requests a second) never fires on these quiet tables, so both queries set theirs.
_RATIO = "(good / 900.0::DOUBLE) / greatest(everything / 900.0::DOUBLE, 0.001::DOUBLE)"
_LOW, _VOLUME = 0.6, 0.002


@query("success_ratio_alert", _MINUTES.format(n=15) + f"""
    SELECT domain, window_end, round({_RATIO}, 6) AS ratio FROM w WHERE {_RATIO} < 0.6 AND everything / 900.0::DOUBLE > 0.002""")
def success_ratio_alert(spark, folder):
    rolled = opsmetrics.rates(Roles(spark, folder).samples, ["domain"], 900, _sums())
    judged = opsmetrics.success_ratio(rolled, "good", "everything", low=_LOW, volume=_VOLUME)
    return judged.filter("firing").select("domain", "window_end", F.round("ratio", 6).alias("ratio"))


@query("sustained_alerts", _MINUTES.format(n=15) + f"""
    , hot AS (SELECT domain, window_end FROM w WHERE {_RATIO} < 0.6 AND everything / 900.0::DOUBLE > 0.002),
    f AS (SELECT *, CASE WHEN window_end - lag(window_end) OVER o > 60 OR lag(window_end) OVER o IS NULL THEN 1 ELSE 0 END AS st FROM hot WINDOW o AS (PARTITION BY domain ORDER BY window_end)),
    i AS (SELECT *, sum(st) OVER (PARTITION BY domain ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT domain, min(window_end) AS pending_since, min(window_end) + 1200 AS firing_since, max(window_end) AS last_firing, 'warning' AS severity
    FROM i GROUP BY domain, island HAVING max(window_end) - min(window_end) >= 1200""")
def sustained_alerts(spark, folder):
    rolled = opsmetrics.rates(Roles(spark, folder).samples, ["domain"], 900, _sums())
    judged = opsmetrics.success_ratio(rolled, "good", "everything", low=_LOW, volume=_VOLUME)
    return opsmetrics.sustained(judged, ["domain"], "window_end", "firing", 60, 1200, "warning")


# A few events an hour: the query stretches the rules' minutes to hours and lowers what they compare with.
_STRETCH = 60
_LOWERED = {
    "ScrapingRunP95TooSlow": (150.0, 0.0), "ScrapingHttpErrorRateHigh": (0.0001, 0.0), "ScrapingExtractionSuccessRateLow": (0.02, 0.00003),
    "ScrapingPlaywrightFallbackFailures": (0.0001, 0.0), "ScrapingBlindDomainCircuitOpened": (0.0, 0.0), "ScrapingUrlBudgetClipping": (0.0, 0.0),
}
_LES = (10.0, 30.0, 60.0, 120.0, 300.0)


def _rules():
    stretched = lambda r: r._replace(window_s=r.window_s * _STRETCH, hold_s=r.hold_s * _STRETCH, threshold=_LOWERED[r.name][0], volume=_LOWERED[r.name][1])
    return [stretched(r) for r in alert_rules.RULES]


def _counter_samples(spark, folder):
    """Events as increments of the counters that the rules watch; durations as histogram buckets, one row per bound that holds."""
    series = ["scrape_run_duration_seconds_bucket", "scrape_http_errors_total", "scrape_extractions_total", "scrape_playwright_fallback_total", "scrape_guardrail_events_total"]
    names = "element_at(array(" + ", ".join(f"'{s}'" for s in series) + "), cast(event_id % 5 + 1 as int))"
    labels = (
        "map('scope', 's' || (user_id % 2), 'provider', event_type, 'domain', 'd' || (user_id % 3), 'result', if(event_id % 2 = 0, 'success', 'failed'), "
        "'guardrail', if(user_id % 2 = 0, 'blind_domain_circuit', 'max_total_urls_per_run'), 'reason', if(user_id % 2 = 0, 'open', 'skip'))"
    )
    events = Roles(spark, folder).table("events", "event_id", "user_id", "event_type", "ts", "value")
    rows = events.select("ts", F.expr(names).alias("name"), F.expr(labels).alias("labels"), F.col("value").alias("seconds"))
    plain = rows.filter(F.col("name") != series[0]).select("ts", "name", "labels", F.lit(1.0).alias("value"))
    bounds = F.array(*[F.struct(F.lit(b).alias("at"), F.lit(str(b)).alias("le")) for b in _LES], F.struct(F.lit(float("inf")).alias("at"), F.lit("+Inf").alias("le")))
    spread = rows.filter(F.col("name") == series[0]).withColumn("bound", F.explode(F.filter(bounds, lambda b: b["at"] >= F.col("seconds"))))
    return plain.unionByName(spread.select("ts", "name", F.map_concat("labels", F.create_map(F.lit("le"), F.col("bound.le"))).alias("labels"), F.lit(1.0).alias("value")))


def _rule_sql() -> str:
    rows = ", ".join(
        f"('{r.name}', '{r.kind}', {i}, {r.window_s}, {r.threshold!r}::DOUBLE, {r.volume!r}::DOUBLE, {r.hold_s}, '{r.severity}', {r.above})"
        for i, r in zip((0, 1, 2, 3, 4, 4), _rules())
    )
    les = ", ".join(f"({b!r}::DOUBLE)" for b in _LES)
    return f"""
    WITH r(rule, kind, series, window_s, threshold, volume, hold_s, severity, above) AS (VALUES {rows}),
    le(le) AS (VALUES {les}, ('infinity'::DOUBLE)),
    s AS (SELECT r.*, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS step_start, event_id % 2 = 0 AS ok, value,
            CASE rule WHEN 'ScrapingRunP95TooSlow' THEN 's' || (user_id % 2) WHEN 'ScrapingPlaywrightFallbackFailures' THEN 'd' || (user_id % 3)
                 WHEN 'ScrapingHttpErrorRateHigh' THEN event_type || '/d' || (user_id % 3) WHEN 'ScrapingExtractionSuccessRateLow' THEN event_type || '/d' || (user_id % 3) ELSE '' END AS grp
          FROM events JOIN r ON event_id % 5 = series
          WHERE CASE rule WHEN 'ScrapingPlaywrightFallbackFailures' THEN event_id % 2 = 1 WHEN 'ScrapingBlindDomainCircuitOpened' THEN user_id % 2 = 0
                          WHEN 'ScrapingUrlBudgetClipping' THEN user_id % 2 = 1 ELSE TRUE END),
    w AS (SELECT s.*, step_start + i * 3600 AS window_end FROM s, range(1, 31) t(i) WHERE i * 3600 <= window_s),
    hb AS (SELECT rule, grp, window_end, le, count(*) FILTER (WHERE value <= le) AS c FROM w, le WHERE kind = 'quantile' GROUP BY ALL),
    hr AS (SELECT *, 0.95 * max(c) OVER (PARTITION BY rule, grp, window_end) AS rank, coalesce(lag(c) OVER o, 0) AS below, coalesce(lag(le) OVER o, 0) AS low
           FROM hb WHERE c > 0 WINDOW o AS (PARTITION BY rule, grp, window_end ORDER BY le)),
    hq AS (SELECT *, row_number() OVER (PARTITION BY rule, grp, window_end ORDER BY le) AS n FROM hr WHERE c >= rank),
    v AS (SELECT rule, grp, window_end, CASE WHEN isinf(le) THEN low WHEN c > below THEN low + (le - low) * ((rank - below) / (c - below)) ELSE low END AS value, TRUE AS enough FROM hq WHERE n = 1
          UNION ALL
          SELECT rule, grp, window_end, CASE kind WHEN 'increase' THEN count(*) WHEN 'rate' THEN count(*) / window_s::DOUBLE
                 ELSE (count(*) FILTER (WHERE ok) / window_s::DOUBLE) / greatest(count(*) / window_s::DOUBLE, 0.001::DOUBLE) END,
                 kind <> 'ratio' OR count(*) / window_s::DOUBLE > volume FROM w WHERE kind <> 'quantile' GROUP BY rule, grp, window_end, kind, window_s, volume),
    e AS (SELECT v.rule, grp, window_end, value, enough AND CASE WHEN above THEN value > threshold ELSE value < threshold END AS firing, hold_s, severity FROM v JOIN r ON r.rule = v.rule),
    """


@query("alert_evaluations", _rule_sql() + """
    z AS (SELECT 1) SELECT rule, grp AS groups, window_end, round(value, 6) AS value, firing FROM e""")
def alert_evaluations(spark, folder):
    found = alert_rules.evaluations(_counter_samples(spark, folder), alert_rules.rule_table(prepare(spark), _rules()), 60 * _STRETCH)
    return found.select("rule", F.array_join("group", "/").alias("groups"), "window_end", F.round("value", 6).alias("value"), "firing")


@query("alert_rules", _rule_sql() + """
    h AS (SELECT *, CASE WHEN window_end - lag(window_end) OVER o > 3600 OR lag(window_end) OVER o IS NULL THEN 1 ELSE 0 END AS st FROM e WHERE firing WINDOW o AS (PARTITION BY rule, grp ORDER BY window_end)),
    i AS (SELECT *, sum(st) OVER (PARTITION BY rule, grp ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS island FROM h)
    SELECT rule, severity, grp AS groups, min(window_end) AS pending_since, min(window_end) + hold_s AS firing_since, max(window_end) AS last_firing
    FROM i GROUP BY rule, severity, grp, hold_s, island HAVING max(window_end) - min(window_end) >= hold_s""")
def alert_rules_query(spark, folder):
    found = alert_rules.alerts(_counter_samples(spark, folder), alert_rules.rule_table(prepare(spark), _rules()), 60 * _STRETCH, bucket_s=30 * 86_400)
    return found.select("rule", "severity", F.array_join("group", "/").alias("groups"), "pending_since", "firing_since", "last_firing")


_POLLS = """
    WITH polls AS (SELECT 'd' || (user_id % 10) AS domain, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(sum(event_id % 5) AS BIGINT) AS n FROM events GROUP BY ALL),
    c AS (SELECT domain, hour, CAST(sum(n) OVER (PARTITION BY domain ORDER BY hour) AS BIGINT) AS value FROM polls),
    d AS (SELECT domain, hour, value, value - lag(value) OVER (PARTITION BY domain ORDER BY hour) AS delta FROM c)
"""


def _polls(spark, folder):
    """A cumulative counter per domain, polled once an hour."""
    from newsloom.operators.ordered import running_total

    hourly = Roles(spark, folder).samples.groupBy("domain", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(F.col("event_id") % 5).alias("n"))
    return running_total(hourly, ["domain"], ["ts"], F.col("n"), F.date_trunc("day", "ts"), "value").select("domain", "ts", "value")


@query("counter_delta_last20", _POLLS + """
    SELECT domain, hour, delta, CAST(sum(delta) OVER (PARTITION BY domain ORDER BY hour ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM d WHERE delta IS NOT NULL""")
def counter_delta_last20(spark, folder):
    history = opsmetrics.counter_history(_polls(spark, folder), ["domain"])
    return history.select("domain", F.floor(F.unix_seconds("ts") / 3600).alias("hour"), "delta", "recent")


@query("counter_increases", """
    WITH x AS (SELECT user_id % 25 AS series, ts, event_id % 50 AS value FROM events),
    p AS (SELECT series, ts, value, lag(value) OVER (PARTITION BY series ORDER BY ts) AS prev FROM x)
    SELECT series, CAST(sum(CASE WHEN value < prev THEN value ELSE value - prev END) AS BIGINT) AS increase, count(*) FILTER (WHERE value < prev) AS resets FROM p GROUP BY 1""")
def counter_increases(spark, folder):
    polls = Roles(spark, folder).table("events", "event_id", "user_id", "ts").selectExpr("user_id % 25 as series", "ts", "event_id % 50 as value")
    grown = opsmetrics.increases(polls, ["series"])
    return grown.groupBy("series").agg(
        F.sum("increase").cast("long").alias("increase"), F.count_if(F.col("value") < F.col("previous")).alias("resets")
    )


@query("tumbling_activity_30s", """
    SELECT event_type AS provider, CAST(floor(epoch(ts) / 30) * 30 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_activity_30s(spark, folder):
    steps = opsmetrics.per_step(Roles(spark, folder).samples, ["provider"], 30, {"n": F.lit(1).cast("long")})
    return steps.withColumnRenamed("step_start", "window_start")


def _dashboard(spark, folder):
    name = "element_at(array('scrape_runs_total', 'scrape_provider_articles_total', 'scrape_http_errors_total', 'scrape_duplicates_removed_total'), cast(event_id % 4 + 1 as int)) as name"
    status = "case when event_type = 'error' then 'error' when event_type = 'signup' then null else 'success' end as status"
    return Roles(spark, folder).table("events", "event_id", "event_type", "user_id").selectExpr(name, status, "'p' || (user_id % 6) as provider", "cast(event_id % 9 as double) as value")


@query("dashboard_totals", """
    WITH s AS (SELECT CAST(sum(CASE WHEN event_id % 4 = 0 THEN event_id % 9 END) AS DOUBLE) AS runs, CAST(sum(CASE WHEN event_id % 4 = 1 THEN event_id % 9 END) AS DOUBLE) AS articles,
        CAST(sum(CASE WHEN event_id % 4 = 2 THEN event_id % 9 END) AS DOUBLE) AS errors, CAST(sum(CASE WHEN event_id % 4 = 3 THEN event_id % 9 END) AS DOUBLE) AS duplicates FROM events)
    SELECT *, round(errors / (runs * 5) * 100, 1) AS error_rate FROM s""")
def dashboard_totals(spark, folder):
    return opsmetrics.dashboard_totals(_dashboard(spark, folder))


@query("run_status_distribution", """
    WITH s AS (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'unknown' ELSE 'success' END AS status, CAST(sum(event_id % 9) AS DOUBLE) AS runs FROM events GROUP BY 1)
    SELECT status, runs, round((SELECT runs FROM s WHERE status = 'success') / (SELECT sum(runs) FROM s) * 100) AS success_percent FROM s""")
def run_status_distribution(spark, folder):
    return opsmetrics.status_distribution(_dashboard(spark, folder))


@query("provider_table", """
    WITH r AS (SELECT 'p' || (user_id % 6) AS provider, CAST(sum(event_id % 9) AS DOUBLE) AS runs, bool_or(event_type IN ('error') AND event_id % 9 > 0) AS has_errors FROM events WHERE event_id % 4 = 0 AND event_type <> 'signup' GROUP BY 1),
    a AS (SELECT 'p' || (user_id % 6) AS provider, CAST(sum(event_id % 9) AS DOUBLE) AS articles FROM events WHERE event_id % 4 = 1 AND user_id % 6 <> 5 GROUP BY 1)
    SELECT r.provider, runs, coalesce(articles, 0) AS articles, round(coalesce(articles, 0) / runs, 1) AS average, has_errors FROM r LEFT JOIN a ON a.provider = r.provider""")
def provider_table(spark, folder):
    samples = _dashboard(spark, folder)
    runs = samples.filter("name = 'scrape_runs_total' and status is not null")
    articles = samples.filter("name = 'scrape_provider_articles_total' and provider <> 'p5'")
    return opsmetrics.provider_table(runs, articles)


@query("bootstrap_summary", """
    SELECT count(*) AS total, count(*) FILTER (WHERE page_id % 7 <> 0) AS succeeded, count(*) FILTER (WHERE page_id % 7 = 0) AS failed FROM pages""")
def bootstrap_summary(spark, folder):
    return Roles(spark, folder).table("pages", "page_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("page_id") % 7 != 0).alias("succeeded"), F.count_if(F.col("page_id") % 7 == 0).alias("failed")
    )


@query("selector_confidence", """
    SELECT CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS assisted, CASE WHEN n = 3 THEN 'medium' ELSE 'low' END AS unassisted, count(*) AS pages
    FROM (SELECT (page_id % 2 = 0)::INT + (page_id % 3 = 0)::INT + (page_id % 5 < 3)::INT AS n FROM pages) GROUP BY ALL""")
def selector_confidence(spark, folder):
    from newsloom.operators.filters import confidence

    found = F.expr("cast(page_id % 2 = 0 as int) + cast(page_id % 3 = 0 as int) + cast(page_id % 5 < 3 as int)")
    pages = Roles(spark, folder).table("pages", "page_id").select(confidence(found).alias("assisted"), confidence(found, False).alias("unassisted"))
    return pages.groupBy("assisted", "unassisted").agg(F.count("*").alias("pages"))


# --- incremental behaviour as batch twins ---------------------------------------------------------


@query("start_marks", sql_with("brands") + """
    SELECT id AS brand_id, strftime(coalesce(last_scraped_at, TIMESTAMP '2024-01-31' - to_days(CAST(initial_lookback_days AS INTEGER))), '%Y-%m-%d %H:%M:%S') AS cutoff FROM brands""")
def start_marks(spark, folder):
    marks = stream_ingest.start_marks(Roles(spark, folder).brands, F.lit(AS_OF).cast("timestamp"))
    return marks.select("brand_id", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss").alias("cutoff"))


@query("mentions_since_marks", sql_with("brands", "em") + """
    SELECT e.brand_id, count(*) AS mentions FROM em e JOIN brands b ON b.id = e.brand_id
    WHERE e.published_at >= coalesce(b.last_scraped_at, TIMESTAMP '2024-01-31' - to_days(CAST(b.initial_lookback_days AS INTEGER))) GROUP BY 1""")
def mentions_since_marks(spark, folder):
    r = Roles(spark, folder)
    marks = stream_ingest.start_marks(r.brands, F.lit(AS_OF).cast("timestamp"))
    return stream_ingest.since_marks(r.em, marks).groupBy("brand_id").agg(F.count("*").alias("mentions"))


@query("advanced_marks", sql_with("brands") + """
    SELECT id, coalesce(strftime(CASE WHEN id % 2 = 0 THEN TIMESTAMP '2024-01-31' ELSE last_scraped_at END, '%Y-%m-%d %H:%M:%S'), '-') AS mark FROM brands""")
def advanced_marks(spark, folder):
    brands = Roles(spark, folder).brands
    moved = stream_ingest.advance_marks(brands, brands.filter("id % 2 = 0"), F.lit(AS_OF).cast("timestamp"))
    return moved.select("id", F.coalesce(F.date_format("last_scraped_at", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("mark"))


# --- streams over the landed events -----------------------------------------------------------------


def _events_stream(spark, folder):
    spark = prepare(spark)
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    landed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return landed.selectExpr(
        "ts", "event_type as provider", "'d' || (user_id % 10) as domain", "user_id", "event_id", "1.0D as value", "event_type = 'error' as failed"
    )


def _drain(stream, spark, mode="append"):
    """Runs a stream over what has landed into a Parquet folder and reads that back."""
    from newsloom.session import shared_folder

    out = shared_folder(spark)
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    sink.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("stream_tumbling_activity", """
    SELECT * FROM (SELECT event_type AS provider, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1, 2)
    WHERE window_start + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)""")
def stream_tumbling_activity(spark, folder):
    counts = alerts.tumbling_activity(_events_stream(spark, folder), ["provider"], "1 hour")
    return _drain(counts, spark)


@query("stream_sliding_rates", """
    WITH m AS (SELECT 'd' || (user_id % 10) AS domain, CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS s, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL),
    w AS (SELECT domain, s + i * 300 AS window_end, CAST(sum(n) AS DOUBLE) AS increase FROM m, range(1, 4) t(i) GROUP BY ALL)
    SELECT domain, window_end, increase, increase / 900.0::DOUBLE AS rate FROM w WHERE window_end <= (SELECT epoch(max(ts)) - 600 FROM events WHERE event_type = 'error')""")
def stream_sliding_rates(spark, folder):
    errors = _events_stream(spark, folder).filter("failed")
    return _drain(alerts.sliding_rates(errors, ["domain"], "15 minutes", "5 minutes", 900), spark)


@query("stream_unique_links", """
    SELECT user_id % 25 AS brand_id, 'https://x.dk/' || user_id AS norm_url, CAST(1 AS BIGINT) AS kept, count(*) AS landed FROM events GROUP BY 1, 2""")
def stream_unique_links(spark, folder):
    links = _events_stream(spark, folder).selectExpr(
        "user_id % 25 as brand_id", "'https://www.x.dk/' || user_id || '/?e=' || event_id as link", "ts as published_at", "event_id"
    )
    kept = _drain(stream_ingest.unique_links(links, "40 days").select("brand_id", "norm_url", "event_id"), spark)
    # Every user's link lands many times, each time with another query string; one row of each is kept.
    landed = Roles(spark, folder).table("events", "user_id").groupBy((F.col("user_id") % 25).alias("brand_id"), F.concat(F.lit("https://x.dk/"), "user_id").alias("norm_url")).agg(F.count("*").alias("landed"))
    return kept.groupBy("brand_id", "norm_url").agg(F.count("*").alias("kept")).join(landed, ["brand_id", "norm_url"])


@query("stream_circuit_breaker", """
    WITH x AS (SELECT event_id AS seq, 'd' || (user_id % 10) AS domain, event_type = 'error' AS failed, event_type = 'view' AS blind FROM events),
    c AS (SELECT *, coalesce(sum(CAST(failed AS INTEGER)) OVER w, 0) AS f, coalesce(sum(CAST(blind AS INTEGER)) OVER w, 0) AS b FROM x
          WINDOW w AS (PARTITION BY domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT domain, CASE WHEN f >= 5 THEN 'circuit_open_skip' WHEN b >= 8 THEN 'blind_circuit_skip' ELSE 'run' END AS breaker, count(*) AS extractions FROM c GROUP BY ALL""")
def stream_circuit_breaker(spark, folder):
    extractions = _events_stream(spark, folder).selectExpr("domain", "event_id as seq", "provider = 'view' as blind", "failed")
    from newsloom.session import shared_folder

    out = shared_folder(spark)
    alerts.judge_extractions(extractions, out, f"{out}/state").awaitTermination()
    verdicts = spark.read.schema("domain string, seq bigint, breaker string").parquet(f"{out}/rows")
    return verdicts.groupBy("domain", F.coalesce("breaker", F.lit("run")).alias("breaker")).agg(F.count("*").alias("extractions"))


@query("stream_insert_ignore", """
    SELECT post_link, topic_id, id AS caption_id FROM (SELECT 'https://x.dk/' || (event_id // 3) AS post_link, user_id % 4 AS topic_id, event_id AS id,
        row_number() OVER (PARTITION BY event_id // 3, user_id % 4 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_insert_ignore(spark, folder):
    from newsloom.schemas import MENTION
    from newsloom.session import shared_folder

    out = shared_folder(spark)
    batch = _events_stream(spark, folder).selectExpr(
        "event_id as seq", "cast(event_id as string) as caption", "'https://x.dk/' || floor(event_id / 3) as post_link", "ts as published_at", "'' as content_teaser",
        "1L as platform_id", "user_id % 25 as brand_id", "user_id % 4 as topic_id", "cast(null as bigint) as primary_keyword_id", "false as read_status", "false as notified_status",
    )
    stream_ingest.write_mentions(batch, f"{out}/mentions", f"{out}/state").awaitTermination()
    # A second run over the same files has nothing new and must not add rows.
    stream_ingest.write_mentions(batch, f"{out}/mentions", f"{out}/state2").awaitTermination()
    stored = spark.read.schema(MENTION).parquet(f"{out}/mentions")
    return stored.select("post_link", "topic_id", F.col("caption").cast("long").alias("caption_id"))


@query("stream_unique_stories")
def stream_unique_stories(spark, folder):
    """The rows that near-duplicate removal leaves, found over five micro-batches that land one after the other."""
    from newsloom.session import shared_folder

    r, out, parts = Roles(spark, folder), shared_folder(spark), 5
    rows = r.raw.select("mention_id", "seq", "brand_id", "title", "content_teaser", "link", "platform", "published_at")
    last = rows.agg(F.max("seq")).first()[0] or 0
    rows = rows.withColumn("part", F.least(F.floor(F.col("seq") * parts / (last + 1)), F.lit(parts - 1)))
    rows = rows.withColumn("seen_at", F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(hours=F.col("part").cast("int")))
    stories = None
    with stream_ingest.rocksdb_state(spark):
        for part in range(parts):
            rows.filter(F.col("part") == part).repartition(F.xxhash64("seq")).write.mode("append").parquet(f"{out}/landed")
            stories = stream_ingest.unique_stories(spark.readStream.schema(rows.schema).parquet(f"{out}/landed"), "seen_at")
            sink = stories.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
            sink.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    kept = spark.read.schema(stories.schema).parquet(f"{out}/rows").select("seq")
    untitled = rows.filter(text.normalize_title(text.comparison_text("title", "content_teaser")) == "").select("seq")
    return rows.join(kept.unionByName(untitled), "seq", "left_semi").select("mention_id", "title", "platform")


@query("stream_drop_reasons", sql_with("brands") + """
    , m AS (SELECT user_id % 30 AS brand_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS published_at FROM events),
    x AS (SELECT CASE WHEN b.id IS NULL THEN 'unknown_brand' WHEN published_at IS NULL THEN 'missing_date'
                      WHEN published_at < coalesce(b.last_scraped_at, TIMESTAMP '2024-01-31' - to_days(CAST(b.initial_lookback_days AS INTEGER))) THEN 'before_cutoff' ELSE 'kept' END AS reason
          FROM m LEFT JOIN brands b ON b.id = m.brand_id)
    SELECT n.reason, count(x.reason) AS mentions FROM (VALUES ('unknown_brand'), ('missing_date'), ('before_cutoff'), ('kept')) n(reason) LEFT JOIN x ON x.reason = n.reason GROUP BY 1""")
def stream_drop_reasons(spark, folder):
    """Rows a stream dropped, by reason, from the counts it observed on its way; the kept ones from what it wrote."""
    from newsloom.session import shared_folder

    out = shared_folder(spark)
    mentions = _events_stream(spark, folder).selectExpr("user_id % 30 as brand_id", "if(event_id % 11 <> 0, ts, null) as published_at", "event_id")
    marks = stream_ingest.start_marks(Roles(spark, folder).brands, F.lit(AS_OF).cast("timestamp"))
    kept = stream_ingest.since_marks_observed(mentions, marks)
    sink = kept.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").option("path", f"{out}/rows")
    running = sink.start()
    running.awaitTermination()
    counts = stream_ingest.dropped_rows(running)
    written = spark.read.schema(kept.schema).parquet(f"{out}/rows").agg(F.lit("kept").alias("reason"), F.count("*").alias("mentions"))
    found = [(reason, counts[reason]) for reason in stream_ingest.SINCE_REASONS]
    return spark.createDataFrame(found, "reason string, mentions bigint").unionByName(written)
