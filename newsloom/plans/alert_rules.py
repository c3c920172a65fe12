"""Alert rules as rows, all evaluated by one job.

Samples are increments of counters: ``ts``, ``name``, ``labels`` (map), ``value``. Every rule picks its samples by name and labels
and groups them by labels; they are added up to steps once, and only step rows are copied to the sliding windows. Histogram rules
keep one sum per bucket and step, so a quantile of a window comes from merged buckets and never from samples.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.operators.ordered import previous_value, running_total
from newsloom.plans import opsmetrics
from newsloom.session import cut_lineage


class Rule(NamedTuple):
    """``kind``: rate (per second), increase, ratio (of the samples that match ``good`` to all), quantile (of histogram buckets, label ``le``)."""

    name: str
    kind: str
    series: str
    where: dict[str, str]
    good: dict[str, str]
    by: list[str]
    window_s: int
    threshold: float
    #: Fires above the threshold, or below it.
    above: bool
    #: Least rate per second of all samples of a ratio.
    volume: float
    q: float
    hold_s: int
    severity: str


# The monitored service's own alert rules.
RULES = (
    Rule("ScrapingRunP95TooSlow", "quantile", "scrape_run_duration_seconds_bucket", {}, {}, ["scope"], 900, 300.0, True, 0.0, 0.95, 900, "warning"),
    Rule("ScrapingHttpErrorRateHigh", "rate", "scrape_http_errors_total", {}, {}, ["provider", "domain"], 300, 0.5, True, 0.0, 0.0, 600, "warning"),
    Rule("ScrapingExtractionSuccessRateLow", "ratio", "scrape_extractions_total", {}, {"result": "success"}, ["provider", "domain"], 900, 0.20, False, 0.1, 0.0, 1200, "warning"),
    Rule("ScrapingPlaywrightFallbackFailures", "rate", "scrape_playwright_fallback_total", {"result": "failed"}, {}, ["domain"], 900, 0.2, True, 0.0, 0.0, 900, "warning"),
    Rule("ScrapingBlindDomainCircuitOpened", "increase", "scrape_guardrail_events_total", {"guardrail": "blind_domain_circuit", "reason": "open"}, {}, [], 900, 0.0, True, 0.0, 0.0, 60, "warning"),
    Rule("ScrapingUrlBudgetClipping", "increase", "scrape_guardrail_events_total", {"guardrail": "max_total_urls_per_run", "reason": "skip"}, {}, [], 1800, 0.0, True, 0.0, 0.0, 300, "info"),
)
#: Least rate a ratio is divided by.
LEAST_RATE = 0.001
_SCHEMA = (
    "rule string, kind string, series string, where map<string,string>, good map<string,string>, by array<string>, window_s bigint, threshold double, "
    "above boolean, volume double, q double, hold_s bigint, severity string"
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    # Stored, the few rows have a known size, so samples meet them where they are read and no task gets all samples of a series.
    return cut_lineage(spark.createDataFrame([tuple(r) for r in rules], _SCHEMA).coalesce(1))


def _matches(labels: Column, wanted: Column) -> Column:
    return F.size(F.array_except(F.map_entries(wanted), F.map_entries(labels))) == 0


def steps(samples: DataFrame, rules: DataFrame, step_s: int) -> DataFrame:
    """rule, group (label values), le, step_start, total, good: what each rule's samples add up to in every step.

    A group of no labels is one for all samples; a missing label is the empty string. Rules are few rows and a parameter, so the join
    is by series name alone. ``le`` is null but for quantile rules.
    """
    picked = samples.join(rules.select("rule", "kind", "series", "where", "good", "by"), F.col("name") == F.col("series"))
    picked = picked.filter(_matches(F.col("labels"), F.col("where")))
    group = F.transform("by", lambda b: F.coalesce(F.col("labels")[b], F.lit("")))
    bound = F.when(F.col("labels")["le"] == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(labels['le'] AS double)"))
    le = F.when(F.col("kind") == "quantile", bound)
    start = (F.floor(F.unix_seconds("ts") / step_s) * step_s).cast("bigint")
    good = F.when(_matches(F.col("labels"), F.col("good")), F.col("value")).otherwise(F.lit(0.0))
    return picked.groupBy("rule", group.alias("group"), le.alias("le"), start.alias("step_start")).agg(
        F.sum("value").alias("total"), F.sum(good).alias("good")
    )


def evaluations(samples: DataFrame, rules: DataFrame, step_s: int = 60) -> DataFrame:
    """rule, group, window_end (epoch seconds), value, firing: one row for every window that holds a sample of the rule."""
    times = rules.select("rule", "window_s", "kind", "threshold", "above", "volume", "q")
    stepped = steps(samples, rules, step_s).join(times, "rule")
    ends = F.transform(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("window_s") / step_s)), lambda i: F.col("step_start") + i * step_s)
    spread = stepped.withColumn("window_end", F.explode(ends))
    key = ["rule", "group", "window_end"]
    merged = spread.groupBy(*key, "le").agg(F.sum("total").alias("total"), F.sum("good").alias("good"))
    buckets = merged.filter("le IS NOT NULL").select(*key, "le", F.col("total").alias("bucket_count"))
    quantiles = opsmetrics.quantile_of(buckets.join(times.select("rule", "q"), "rule"), key, F.col("q"))
    plain = merged.filter("le IS NULL").join(times, "rule")
    rate = lambda c: F.col(c) / F.col("window_s")
    value = F.when(F.col("kind") == "increase", F.col("total")).when(F.col("kind") == "rate", rate("total")).otherwise(
        rate("good") / F.greatest(rate("total"), F.lit(LEAST_RATE))
    )
    enough = (F.col("kind") != "ratio") | (rate("total") > F.col("volume"))
    values = plain.select(*key, value.alias("value"), enough.alias("enough")).unionByName(
        quantiles.select(*key, F.col("quantile").alias("value"), F.lit(True).alias("enough"))
    )
    over = F.when(F.col("above"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return values.join(times.select("rule", "above", "threshold"), "rule").select(*key, "value", (over & F.col("enough")).alias("firing"))


def alerts(samples: DataFrame, rules: DataFrame, step_s: int = 60, bucket_s: int = 86_400) -> DataFrame:
    """rule, severity, group, pending_since, firing_since, last_firing of every alert that held for its rule's time.

    Evaluations that fire step after step form an interval; a window without samples ends it.
    """
    hot = evaluations(samples, rules, step_s).filter("firing").select("rule", "group", "window_end")
    key, bucket = ["rule", "group"], F.floor(F.col("window_end") / bucket_s)
    seen = previous_value(hot, key, ["window_end"], "window_end", bucket, "previous")
    begins = F.when(F.col("previous").isNull() | (F.col("window_end") - F.col("previous") > step_s), 1).otherwise(0)
    islands = running_total(seen.withColumn("begins", begins), key, ["window_end"], F.col("begins"), bucket, "island")
    spans = islands.groupBy(*key, "island").agg(F.min("window_end").alias("pending_since"), F.max("window_end").alias("last_firing"))
    held = spans.join(rules.select("rule", "hold_s", "severity"), "rule").filter(F.col("last_firing") - F.col("pending_since") >= F.col("hold_s"))
    return held.select("rule", "severity", "group", "pending_since", (F.col("pending_since") + F.col("hold_s")).alias("firing_since"), "last_firing")
