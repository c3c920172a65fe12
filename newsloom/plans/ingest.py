"""The ingestion flow, for all runs at once: union, filter, dedup, match, and rows to store."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from newsloom import settings
from newsloom.functions import url
from newsloom.operators import dedup, filters, language, matching
from newsloom.session import cut_lineage
from newsloom.sinks import tables


DATE_REASONS = ("missing_date", "unparseable_date", "before_cutoff")


def union_providers(outputs: dict[str, DataFrame | None]) -> DataFrame:
    """Provider outputs under one schema with provenance; a failed provider (None) adds nothing."""
    frames = []
    for provider, df in outputs.items():
        if df is None:
            continue
        for column in ("source_provider", "source_label"):
            if column not in df.columns:
                df = df.withColumn(column, F.lit(None).cast("string"))
        frames.append(
            df.withColumn("source_provider", F.coalesce("source_provider", F.lit(provider)))
            .withColumn("source_label", F.coalesce("source_label", F.lit(provider)))
        )
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


@dataclass
class Stages:
    """Rows left after every stage, each but the first stored, and what was counted while they were computed."""

    dated: DataFrame
    unique_url: DataFrame
    unique_story: DataFrame
    in_language: DataFrame
    relevant: DataFrame
    new: DataFrame
    counts: dict[str, Observation]


def filter_mentions(
    raw: DataFrame,
    cutoff: Column,
    scope: list[str],
    profiles: DataFrame | None = None,
    languages: Column | None = None,
    verdicts: DataFrame | None = None,
    history: DataFrame | None = None,
) -> Stages:
    """Strict date filter, URL dedup, near dedup, language, relevance and history, in that order.

    Rows and reasons are counted in the same pass that computes a stage (observed metrics); no stage runs again to be counted.
    """
    counts = {name: Observation(f"{name}_{uuid.uuid4().hex}") for name in ("raw", "dated", "unique_url", "unique_story", "in_language", "relevant", "new")}
    rows = F.count(F.lit(1)).alias("rows")

    def counted(df: DataFrame, name: str, *more: Column) -> DataFrame:
        return df.observe(counts[name], rows, *more)

    reason = filters.strict_date_reason("published_raw", "published_at", cutoff)
    reasons = [F.count_if(F.coalesce(reason == r, F.lit(False))).alias(r) for r in DATE_REASONS]
    dated = counted(counted(raw, "raw", *reasons).filter(reason.isNull()), "dated", F.count_if(F.coalesce("link", F.lit("")) == "").alias("missing_link"))
    # The later stages are read more than once, so each is computed and stored once.
    unique_url = cut_lineage(counted(dedup.url_dedup(dated, scope), "unique_url"))
    unique_story = cut_lineage(counted(dedup.near_dedup(unique_url, scope), "unique_story"))
    in_language = unique_story
    if profiles is not None:
        in_language = language.filter_by_language(unique_story, "mention_id", "title", profiles, languages).drop("detected")
    in_language = cut_lineage(counted(in_language, "in_language"))
    relevant = in_language
    if verdicts is not None:
        relevant = filters.keep_relevant(in_language, verdicts, "mention_id", "relevant")
    relevant = cut_lineage(counted(relevant, "relevant"))
    new = relevant
    if history is not None:
        new = dedup.without_historical(relevant, history, scope)
    new = cut_lineage(counted(new, "new"))
    return Stages(dated, unique_url, unique_story, in_language, relevant, new, counts)


def stage_removals(stages: Stages) -> DataFrame:
    """A row per stage: stage, rows_in, rows_out, removed. Rows without a link are a stage of their own (linked), apart from URL duplicates."""
    rows = {name: seen.get["rows"] for name, seen in stages.counts.items()}
    rows["linked"] = rows["dated"] - stages.counts["dated"].get["missing_link"]
    order = ["raw", "dated", "linked", "unique_url", "unique_story", "in_language", "relevant", "new"]
    found = [(name, rows[before], rows[name], rows[before] - rows[name]) for before, name in zip(order, order[1:])]
    return stages.new.sparkSession.createDataFrame(found, "stage string, rows_in bigint, rows_out bigint, removed bigint")


def drop_reasons(stages: Stages) -> DataFrame:
    """reason, rows: why the first filters dropped rows, and how many went as duplicates of a URL."""
    raw, dated, unique = (stages.counts[name].get for name in ("raw", "dated", "unique_url"))
    found = [(r, raw[r]) for r in DATE_REASONS] + [("missing_link", dated["missing_link"]), ("url_duplicate", dated["rows"] - dated["missing_link"] - unique["rows"])]
    return stages.new.sparkSession.createDataFrame(found, "reason string, rows bigint")


def rows_to_store(mentions: DataFrame, keywords: DataFrame, platforms: DataFrame, min_matches: int = settings.MIN_KEYWORD_MATCHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mention rows with topic, primary keyword and platform id, their keyword links, and the platforms to append first.

    A platform that the dimension does not have yet gets an id here, so no mention is lost for it.
    """
    # Read for topics, primary keywords and links, so computed once.
    matches = cut_lineage(matching.phrase_matches(mentions, keywords))
    topics = matching.best_topics(matches, min_matches)
    primary = matching.primary_keywords(matches, topics)
    name = F.trim(F.coalesce("platform", F.lit("")))
    named = mentions.withColumn("platform", F.when(name == "", F.lit("Unknown")).otherwise(name))
    fresh, every = tables.get_or_create(platforms, named.join(topics, "mention_id", "left_semi"), "platform")
    platform_ids = every.select(F.col("id").alias("platform_id"), F.col("name").alias("platform"))
    rows = (
        named.join(topics.select("mention_id", "topic_id"), "mention_id")
        .join(primary, "mention_id", "left")
        .join(platform_ids, "platform")
        .select(
            "seq",
            F.col("title").alias("caption"),
            F.col("link").alias("post_link"),
            "published_at", "content_teaser", "platform_id", "brand_id", "topic_id", "primary_keyword_id",
            F.lit(False).alias("read_status"),
            F.lit(False).alias("notified_status"),
        )
    )
    links = (
        matches.join(topics.select("mention_id", "topic_id"), ["mention_id", "topic_id"])
        .join(named.select("mention_id", F.col("link").alias("post_link")), "mention_id")
        .filter(F.coalesce("post_link", F.lit("")) != "")
        .select("post_link", "topic_id", "keyword_id", "matched_in", "score")
    )
    return rows, links, fresh


def provider_outcomes(results: DataFrame) -> DataFrame:
    """Status, mentions and first error per provider."""
    return results.groupBy("provider").agg(
        F.count("link").alias("mentions"),
        F.when(F.count("error") > 0, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.min("error").alias("error"),
    )


def snapshot_rows(mentions: DataFrame, known: list[str]) -> DataFrame:
    """Canonical projection of a stage; every other column goes into the ``extra`` map."""
    others = [c for c in mentions.columns if c not in known and c != "published_at"]
    pairs = [x for c in others for x in (F.lit(c), F.col(c).cast("string"))]
    extra = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map()
    have = lambda c: F.col(c) if c in mentions.columns else F.lit(None).cast("string").alias(c)
    return mentions.select(
        *[have(c) for c in known],
        url.normalize_url("link").alias("normalized_link"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published_at"),
        extra.alias("extra"),
    )
