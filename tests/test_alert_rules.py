"""The rule table against hand-made counters."""

import datetime as dt

from newsloom.plans import alert_rules

BASE = dt.datetime(2024, 1, 1)
START = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp())


def samples(spark, rows):
    df = [(BASE + dt.timedelta(minutes=m, seconds=5), name, labels, float(value)) for m, name, labels, value in rows]
    return spark.createDataFrame(df, "ts timestamp, name string, labels map<string,string>, value double")


def fired(spark, rows):
    found = alert_rules.alerts(samples(spark, rows), alert_rules.rule_table(spark)).collect()
    return sorted((r.rule, r.severity, tuple(r.group), (r.pending_since - START) // 60, (r.firing_since - START) // 60, (r.last_firing - START) // 60) for r in found)


def test_error_rate_holds_ten_minutes(spark):
    """More than 0.5 errors a second over five minutes is more than 150; 40 a minute reach that after four minutes."""
    labels = {"provider": "rss", "domain": "a.dk"}
    rows = [(m, "scrape_http_errors_total", labels, 40) for m in range(20)] + [(m, "scrape_http_errors_total", {"provider": "rss"}, 20) for m in range(20)]
    assert fired(spark, rows) == [("ScrapingHttpErrorRateHigh", "warning", ("rss", "a.dk"), 4, 14, 21)]
    assert fired(spark, [x for x in rows if x[0] < 9]) == []


def test_success_ratio_needs_volume(spark):
    at = lambda result, n, domain: [(m, "scrape_extractions_total", {"result": result, "provider": "c", "domain": domain}, n) for m in range(40)]
    rows = at("success", 1, "a.dk") + at("failed", 9, "a.dk") + at("failed", 1, "quiet.dk") + at("success", 5, "good.dk") + at("failed", 5, "good.dk")
    found = fired(spark, rows)
    assert [f[:3] for f in found] == [("ScrapingExtractionSuccessRateLow", "warning", ("c", "a.dk"))]


def test_p95_is_that_of_each_window(spark):
    """Slow runs in the last half hour only: an all-time quantile would not see them."""
    bucket = lambda m, le, n: (m, "scrape_run_duration_seconds_bucket", {"scope": "user", "le": le}, n)
    rows = [x for m in range(90) for x in (bucket(m, "300", 9 if m < 60 else 1), bucket(m, "600", 9), bucket(m, "+Inf", 9))]
    found = fired(spark, rows)
    assert [f[:3] for f in found] == [("ScrapingRunP95TooSlow", "warning", ("user",))] and 60 <= found[0][3] <= 62
    values = {r.window_end: r.value for r in alert_rules.evaluations(samples(spark, rows), alert_rules.rule_table(spark)).collect()}
    # 0.95 * 135 of one to eight ninths under 300 seconds, the rest under 600.
    assert abs(values[START + 90 * 60] - (300 + 300 * (0.95 * 135 - 15) / 120)) < 1e-9


def test_increases_and_failed_fallbacks(spark):
    rows = [(0, "scrape_guardrail_events_total", {"guardrail": "blind_domain_circuit", "reason": "open"}, 1)]
    rows += [(0, "scrape_guardrail_events_total", {"guardrail": "max_total_urls_per_run", "reason": "skip"}, 3), (0, "scrape_guardrail_events_total", {"guardrail": "other", "reason": "open"}, 3)]
    rows += [(m, "scrape_playwright_fallback_total", {"result": r, "domain": r}, 20) for m in range(40) for r in ("failed", "success")]
    assert [f[:4] for f in fired(spark, rows)] == [
        ("ScrapingBlindDomainCircuitOpened", "warning", (), 1), ("ScrapingPlaywrightFallbackFailures", "warning", ("failed",), 10), ("ScrapingUrlBudgetClipping", "info", (), 1),
    ]


def test_no_samples(spark):
    assert fired(spark, []) == []


def test_samples_are_not_dealt_by_series(spark):
    """Rules are few rows of known size: samples are not shuffled by their series, of which one may hold nearly all."""
    plan = alert_rules.evaluations(samples(spark, [(0, "scrape_http_errors_total", {}, 1)]), alert_rules.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(name" not in plan and "hashpartitioning(series" not in plan
