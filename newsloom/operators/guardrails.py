"""URL budgets and circuit breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom import settings
from newsloom.operators.ordered import running_totals, top_per_key


def cap_per_source(df: DataFrame, domain: str, order: list, limit: int = settings.MAX_URLS_PER_SOURCE) -> DataFrame:
    return top_per_key(df, [domain], order, max(1, limit))


def url_budget(df: DataFrame, order: list, limit: int = settings.MAX_URLS_PER_RUN) -> DataFrame:
    """Global budget of one run; a top-k, so no full sort."""
    return df.orderBy(*order).limit(max(1, limit))


def budget_skipped(df: DataFrame, limit: int = settings.MAX_URLS_PER_RUN) -> DataFrame:
    return df.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("skipped"))


def breaker_state(blind_before: Column, failed_before: Column) -> Column:
    """Null while extractions of a domain run; else why they are skipped."""
    return F.when(failed_before >= settings.FAILED_DOMAIN_THRESHOLD, F.lit("circuit_open_skip")).when(
        blind_before >= settings.BLIND_DOMAIN_THRESHOLD, F.lit("blind_circuit_skip")
    )


def with_breaker(
    df: DataFrame, domain: list[str], order: list, bucket: Column | None,
    blind: Column | None = None, failed: Column | None = None, earlier: DataFrame | None = None,
) -> DataFrame:
    """Adds the earlier blind and failed extractions of the domain and the resulting breaker.

    A row is skipped once its domain has 8 blind or 5 failed extractions before it. ``earlier`` (domain, blind, failed) counts
    those of batches before this one.
    """
    flag = lambda c: F.lit(0).cast("long") if c is None else c.cast("long")
    values = {"blind_before": flag(blind), "failed_before": flag(failed)}
    counts = running_totals(df, domain, order, values, bucket, exclusive=True)
    if earlier is not None:
        known = earlier.select(*domain, F.col("blind").alias("_blind"), F.col("failed").alias("_failed"))
        counts = counts.join(known, domain, "left")
        for name in ("blind", "failed"):
            counts = counts.withColumn(f"{name}_before", F.col(f"{name}_before") + F.coalesce(f"_{name}", F.lit(0)))
        counts = counts.drop("_blind", "_failed")
    return counts.withColumn("breaker", breaker_state(F.col("blind_before"), F.col("failed_before")))


def noisy_domains(df: DataFrame, domain: str, failed: Column, limit: int = settings.NOISY_DOMAINS) -> DataFrame:
    """Domains with most failures."""
    counts = df.groupBy(domain).agg(F.count_if(failed).alias("failures")).filter("failures > 0")
    return counts.orderBy(F.desc("failures"), domain).limit(limit)
