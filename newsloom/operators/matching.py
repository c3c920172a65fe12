"""Keyword phrases found in mentions, topic choice and primary keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom import settings
from newsloom.functions import text
from newsloom.operators.once import once
from newsloom.operators.ordered import top_per_key


def phrase_matches(mentions: DataFrame, keywords: DataFrame, scope: list[str] = ("brand_id",)) -> DataFrame:
    """One row per (mention, topic, keyword) whose phrase occurs in title or teaser.

    ``mentions``: scope, ``mention_id``, ``title``, ``content_teaser``.
    ``keywords``: scope, ``topic_id``, ``keyword_id``, ``keyword``.

    Testing every keyword against every text would be a nested loop. Every phrase contains its
    longest word as a word token of the text, so an equi-join on that token yields all candidates
    and the boundary regex confirms them. Keywords of symbols only have no token; they are tested
    within their scope.
    """
    scope = list(scope)
    phrases = _with_anchor(keywords, scope)
    texts = mentions.select(
        *scope, "mention_id",
        F.lower(F.coalesce("title", F.lit(""))).alias("_title"),
        F.lower(F.coalesce("content_teaser", F.lit(""))).alias("_teaser"),
    )
    # Only ids travel with the tokens; the text is joined to the candidates once.
    tokens = texts.select(*scope, "mention_id", F.explode(text.words(F.concat_ws(" ", "_title", "_teaser"))).alias("_token"))
    by_token = tokens.join(phrases.filter(F.col("_token").isNotNull()), [*scope, "_token"]).drop("_token").distinct()
    by_scope = texts.join(phrases.filter(F.col("_token").isNull()), scope).drop("_token")
    candidates = texts.join(by_token, [*scope, "mention_id"]).unionByName(by_scope)
    found = once(
        candidates, _in_title=F.rlike("_title", F.col("_pattern")), _in_teaser=F.rlike("_teaser", F.col("_pattern"))
    )
    where = (
        F.when(F.col("_in_title") & F.col("_in_teaser"), F.lit("both"))
        .when(F.col("_in_title"), F.lit("title"))
        .otherwise(F.lit("teaser"))
    )
    return found.filter(F.col("_in_title") | F.col("_in_teaser")).select(
        *scope, "mention_id", "topic_id", "keyword_id", "keyword",
        where.alias("matched_in"), F.lit(1).alias("score"),
    )


def _with_anchor(keywords: DataFrame, scope: list[str]) -> DataFrame:
    """Keywords with their boundary regex and longest word token."""
    sized = F.transform(
        text.words(text.sanitize("keyword")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))
    )
    return (
        keywords.select(*scope, "topic_id", "keyword_id", "keyword")
        .withColumn("_pattern", text.phrase_pattern(F.lower("keyword")))
        .filter(F.col("_pattern").isNotNull())
        .withColumn("_token", F.array_max(sized)["w"])
    )


def best_topics(matches: DataFrame, min_matches: int = settings.MIN_KEYWORD_MATCHES) -> DataFrame:
    """Topic with most distinct keywords per mention; ties go to the lowest topic id."""
    scores = matches.groupBy("mention_id", "topic_id").agg(F.count_distinct("keyword_id").alias("score"))
    best = top_per_key(scores, ["mention_id"], [F.desc("score"), "topic_id"], 1)
    return best.filter(F.col("score") >= min_matches)


def primary_keywords(matches: DataFrame, topics: DataFrame) -> DataFrame:
    """Longest matched keyword of the chosen topic; ties go to the lowest keyword id."""
    chosen = matches.join(topics.select("mention_id", "topic_id"), ["mention_id", "topic_id"], "left_semi")
    first = top_per_key(
        chosen, ["mention_id"], [F.length("keyword").desc(), "keyword_id"], 1
    )
    return first.select("mention_id", F.col("keyword_id").alias("primary_keyword_id"))


def keyword_score(df: DataFrame, patterns: DataFrame, key: str, body: str, per_group: bool = False) -> DataFrame:
    """Matched keywords per row; ``per_group`` caps each one-phrase group at 1, as a maximum."""
    hits = phrase_matches(
        df.select(F.lit(1).alias("brand_id"), F.col(key).alias("mention_id"), F.col(body).alias("title"), F.lit("").alias("content_teaser")),
        patterns.select(F.lit(1).alias("brand_id"), F.lit(1).alias("topic_id"), "keyword_id", "keyword"),
    )
    counted = hits.groupBy("mention_id").agg(F.count_distinct("keyword_id").alias("term_matches"))
    if per_group:
        counted = counted.withColumn("term_matches", F.least("term_matches", F.lit(1)))
    return df.join(counted.withColumnRenamed("mention_id", key), key, "left").withColumn(
        "term_matches", F.coalesce("term_matches", F.lit(0))
    )
