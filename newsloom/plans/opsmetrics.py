"""Operational metrics: counters, histograms, quantiles, rates, alert windows, dashboard tables.

Samples have ``ts``, ``name``, label columns and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom import settings
from newsloom.operators.ordered import previous_value, running_total, running_totals


def counters(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Labelled counter totals; labels are cleaned the way the registry does."""
    from newsloom.functions.text import metric_label

    clean = [metric_label(c).alias(c) for c in labels]
    return samples.groupBy("name", *clean).agg(F.sum("value").alias("total"))


def histogram(samples: DataFrame, labels: list[str], bounds: tuple, value: str = "value") -> DataFrame:
    """Cumulative buckets per label set, the ``+Inf`` bucket as ``infinity``.

    Every sample is counted once in its own bucket; only the few grouped rows are then spread
    over the larger bounds.
    """
    bounds = [float(b) for b in bounds] + [float("inf")]
    slot = sum(F.when(F.col(value) > F.lit(b), 1).otherwise(0) for b in bounds[:-1])
    own = samples.groupBy(*labels, slot.alias("_slot")).agg(F.count("*").alias("n"))
    spread = own.select(*labels, "n", F.explode(F.sequence(F.col("_slot"), F.lit(len(bounds) - 1))).alias("_i"))
    edges = F.array(*[F.lit(b) for b in bounds])
    cumulative = spread.groupBy(*labels, "_i").agg(F.sum("n").alias("bucket_count"))
    return _with_empty_buckets(cumulative, labels, len(bounds)).select(
        *labels, F.get(edges, F.col("_i")).alias("le"), "bucket_count"
    )


def _with_empty_buckets(cumulative: DataFrame, labels: list[str], size: int) -> DataFrame:
    """Adds zero rows for bounds below every sample of a label set."""
    first = cumulative.groupBy(*labels).agg(F.min("_i").alias("_first"))
    gaps = first.filter("_first > 0").select(
        *labels, F.explode(F.sequence(F.lit(0), F.col("_first") - 1)).alias("_i"), F.lit(0).cast("long").alias("bucket_count")
    )
    return cumulative.unionByName(gaps)


def quantile(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation; the open bucket yields the last
    finite bound."""
    return quantile_of(buckets, labels, F.lit(q))


def quantile_of(buckets: DataFrame, labels: list[str], q: Column) -> DataFrame:
    """``quantile`` with a ``q`` that may differ from row to row, but not within a label set."""
    w = Window.partitionBy(*labels).orderBy("le")
    total = F.max("bucket_count").over(Window.partitionBy(*labels))
    ranked = buckets.select(
        "*", (total * q).alias("_rank"),
        F.coalesce(F.lag("bucket_count").over(w), F.lit(0)).alias("_below"),
        F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("_floor"),
    )
    hit = ranked.filter((F.col("bucket_count") >= F.col("_rank")) & (F.col("_rank") > 0))
    first = hit.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    inside = F.col("bucket_count") - F.col("_below")
    part = F.when(inside > 0, (F.col("_rank") - F.col("_below")) / inside).otherwise(F.lit(0.0))
    value = F.when(F.col("le") == float("inf"), F.col("_floor")).otherwise(
        F.col("_floor") + (F.col("le") - F.col("_floor")) * part
    )
    return first.select(*labels, value.alias("quantile"))


def increases(samples: DataFrame, series: list[str], bucket: Column | None = None) -> DataFrame:
    """Growth since the previous sample of a cumulative counter; after a reset, the new value."""
    bucket = F.date_trunc("hour", "ts") if bucket is None else bucket
    with_previous = previous_value(samples, series, ["ts"], "value", bucket, "previous")
    grown = F.when(F.col("previous").isNull(), F.lit(None).cast("double")).when(
        F.col("value") < F.col("previous"), F.col("value")
    ).otherwise(F.col("value") - F.col("previous"))
    return with_previous.withColumn("increase", grown)


def sliding(per_step: DataFrame, keys: list[str], start: str, step_s: int, window_s: int, sums: list[str]) -> DataFrame:
    """Sliding window sums from already aggregated steps: a step row is copied to the windows it
    belongs to, instead of every raw row. ``window_end`` is epoch seconds."""
    copies = window_s // step_s
    ends = F.transform(F.sequence(F.lit(1), F.lit(copies)), lambda i: F.col(start) + i * step_s)
    spread = per_step.select(*keys, *sums, F.explode(ends).alias("window_end"))
    return spread.groupBy(*keys, "window_end").agg(*[F.sum(c).alias(c) for c in sums])


def per_step(events: DataFrame, keys: list[str], step_s: int, sums: dict[str, Column]) -> DataFrame:
    start = (F.floor(F.unix_seconds("ts") / step_s) * step_s).cast("long")
    return events.groupBy(*keys, start.alias("step_start")).agg(*[F.sum(v).alias(n) for n, v in sums.items()])


def rates(events: DataFrame, keys: list[str], window_s: int, sums: dict[str, Column], step_s: int = 60) -> DataFrame:
    """Increase and per-second rate per sliding window; rate = increase / window length."""
    steps = per_step(events, keys, step_s, sums)
    rolled = sliding(steps, keys, "step_start", step_s, window_s, list(sums))
    for name in sums:
        rolled = rolled.withColumn(f"{name}_rate", F.col(name) / F.lit(float(window_s)))
    return rolled


def success_ratio(rolled: DataFrame, good: str, everything: str, low: float = 0.20, volume: float = 0.1) -> DataFrame:
    """Ratio of per-second rates with a floor under the denominator, and the low-ratio alert condition with its
    minimum volume, per second as well."""
    rate = F.col(f"{everything}_rate")
    ratio = F.col(f"{good}_rate") / F.greatest(rate, F.lit(0.001))
    return rolled.withColumn("ratio", ratio).withColumn("firing", (ratio < low) & (rate > volume))


def sustained(
    evaluations: DataFrame, keys: list[str], at: str, firing: str, step_s: int, hold_s: int, severity: str,
    bucket_s: int = 86_400,
) -> DataFrame:
    """Alert intervals: runs of consecutive firing evaluations that lasted at least ``hold_s``.

    Gaps and islands: a firing evaluation that does not follow another one by exactly one step
    starts an island. Days keep the numbering parallel.
    """
    hot = evaluations.filter(firing).select(*keys, at)
    bucket = F.floor(F.col(at) / bucket_s)
    seen = previous_value(hot, keys, [at], at, bucket, "_previous")
    starts = F.when(F.col("_previous").isNull() | (F.col(at) - F.col("_previous") > step_s), 1).otherwise(0)
    flagged = seen.withColumn("_start", starts)
    islands = running_total(flagged, keys, [at], F.col("_start"), bucket, "island")
    spans = islands.groupBy(*keys, "island").agg(F.min(at).alias("pending_since"), F.max(at).alias("last_firing"))
    lasting = spans.filter(F.col("last_firing") - F.col("pending_since") >= hold_s)
    return lasting.select(
        *keys, "pending_since", (F.col("pending_since") + hold_s).alias("firing_since"), "last_firing",
        F.lit(severity).alias("severity"),
    )


def dashboard_totals(samples: DataFrame) -> DataFrame:
    """Runs, articles, errors, duplicates and the heuristic error rate in percent."""
    total = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0))
    sums = samples.agg(
        total("scrape_runs_total").alias("runs"),
        total("scrape_provider_articles_total").alias("articles"),
        total("scrape_http_errors_total").alias("errors"),
        total("scrape_duplicates_removed_total").alias("duplicates"),
    )
    rate = F.when(F.col("runs") > 0, F.col("errors") / (F.col("runs") * settings.REQUESTS_PER_RUN) * 100).otherwise(0.0)
    return sums.withColumn("error_rate", F.round(rate, 1))


def status_distribution(samples: DataFrame) -> DataFrame:
    """Runs per status with the rounded overall success percentage."""
    counts = samples.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.sum("value").alias("runs"))
    everything = counts.agg(F.sum("runs")).scalar()
    good = counts.agg(F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("runs"))), F.lit(0))).scalar()
    percent = F.when(everything > 0, F.round(good / everything * 100)).otherwise(0.0)
    return counts.select("status", "runs", percent.alias("success_percent"))


def provider_table(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """Runs, articles, average articles per run and health per provider."""
    by_run = runs.groupBy("provider").agg(
        F.sum("value").alias("runs"), F.bool_or((F.col("status") != "success") & (F.col("value") > 0)).alias("has_errors")
    )
    by_article = articles.groupBy("provider").agg(F.sum("value").alias("articles"))
    joined = by_run.join(by_article, "provider", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))
    average = F.when(F.col("runs") > 0, F.round(F.col("articles") / F.col("runs"), 1)).otherwise(0.0)
    return joined.select("provider", "runs", "articles", average.alias("average"), "has_errors")


def counter_history(polls: DataFrame, series: list[str], points: int = settings.HISTORY_POINTS) -> DataFrame:
    """Delta per poll (the first one skipped) with the sum over the last ``points`` deltas.

    The sliding sum is the running total minus the running total ``points`` rows earlier, so a
    long series is not one window partition.
    """
    day = F.date_trunc("day", "ts")
    grown = previous_value(polls, series, ["ts"], "value", day, "previous")
    deltas = grown.filter(F.col("previous").isNotNull()).withColumn("delta", F.col("value") - F.col("previous"))
    summed = running_totals(deltas, series, ["ts"], {"_sum": F.col("delta"), "_n": F.lit(1)}, day)
    earlier = summed.select(*series, (F.col("_n") + points).alias("_n"), F.col("_sum").alias("_before"))
    return (
        summed.join(earlier, [*series, "_n"], "left")
        .withColumn("recent", F.col("_sum") - F.coalesce("_before", F.lit(0)))
        .drop("_n", "_sum", "_before")
    )
