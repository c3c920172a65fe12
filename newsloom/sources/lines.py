"""Line-oriented text sources: domain lists, taxonomy specs and metric expositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions import url
from newsloom.operators.ordered import top_per_key

_SAMPLE = r"^([a-z0-9_]+)(\{.*\})?\s+([0-9.e+-]+)$"


def domain_list(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Ordered distinct domains of a list (columns ``seq``, ``value``); blanks and ``#`` lines skip."""
    kept = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    named = kept.select("seq", url.clean_domain_entry("value").alias("domain")).filter(F.col("domain") != "")
    firsts = named.groupBy("domain").agg(F.min("seq").alias("seq"))
    return firsts.orderBy("seq").limit(limit) if limit else firsts


def union_lists(*lists: DataFrame) -> DataFrame:
    """Union of market lists, first occurrence first."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return domain_list(out)


def taxonomy_specs(specs: DataFrame) -> DataFrame:
    """``Topic=kw1,kw2`` lines to topic and keyword rows; invalid lines carry a reason."""
    parts = F.split("value", "=", 2)
    topic = F.trim(F.get(parts, F.lit(0)))
    words = F.filter(
        F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != ""
    )
    reason = (
        F.when(~F.col("value").contains("="), F.lit("no_equals"))
        .when(topic == "", F.lit("empty_topic"))
        .when(F.size(words) == 0, F.lit("no_keywords"))
    )
    rows = specs.select(*specs.columns, topic.alias("topic"), words.alias("_words"), reason.alias("reject_reason"))
    return rows.select(
        *specs.columns, "topic", "reject_reason",
        F.posexplode_outer(F.when(F.col("reject_reason").isNull(), F.col("_words"))).alias("position", "keyword"),
    )


def metric_samples(lines: DataFrame, prefix: str = "scrape_") -> DataFrame:
    """Samples of a text exposition: name, label map and value."""
    fit = lines.filter(~F.col("value").startswith("#") & F.col("value").rlike(_SAMPLE))
    labels = F.regexp_extract("value", _SAMPLE, 2)
    keys = F.regexp_extract_all(labels, F.lit(r'([a-z0-9_]+)="([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(labels, F.lit(r'([a-z0-9_]+)="([^"]*)"'), F.lit(2))
    rows = fit.select(
        *[c for c in lines.columns if c != "value"],
        F.regexp_extract("value", _SAMPLE, 1).alias("name"),
        F.map_from_arrays(keys, values).alias("labels"),
        F.regexp_extract("value", _SAMPLE, 3).try_cast("double").alias("value"),
    )
    return rows.filter(F.col("name").startswith(prefix))


def ordered_distinct(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return top_per_key(df, keys, [order], 1)
