"""Digest messages of unsent mentions.

A brand may own most of the mentions, so a digest is not one value: it is a set of block rows
(header, one heading per topic, bullet blocks of bounded size, footer) with a sort position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.plans.reports import numbered_mentions

BULLETS_PER_BLOCK = 20


def unsent(mentions: DataFrame) -> DataFrame:
    return mentions.filter(~F.coalesce("notified_status", F.lit(False))).withColumn(
        "topic", F.coalesce("topic", F.lit("Uncategorized"))
    )


def topic_counts(mentions: DataFrame) -> DataFrame:
    return unsent(mentions).groupBy("brand_id", "topic").agg(
        F.count("*").alias("mentions"), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created")
    )


def bullet(caption: str = "caption", link: str = "post_link", platform: str = "platform"):
    title = F.coalesce(caption, F.lit("No title"))
    place = F.coalesce(platform, F.lit("Unknown"))
    linked = F.concat(F.lit("• <"), F.col(link), F.lit("|"), title, F.lit("> ("), place, F.lit(")"))
    plain = F.concat(F.lit("• "), title, F.lit(" ("), place, F.lit(")"))
    return F.when(F.coalesce(link, F.lit("")) != "", linked).otherwise(plain)


def bullet_blocks(mentions: DataFrame, size: int = BULLETS_PER_BLOCK) -> DataFrame:
    """Bullets per topic in creation order, ``size`` to a block."""
    numbered = numbered_mentions(unsent(mentions), ["brand_id", "topic"])
    block = F.floor((F.col("position") - 1) / size).alias("block")
    grouped = numbered.withColumn("bullet", bullet()).groupBy("brand_id", "topic", block)
    lines = F.array_sort(F.collect_list(F.struct("position", "bullet")))
    return grouped.agg(
        F.count("*").alias("bullets"), F.array_join(F.transform(lines, lambda b: b["bullet"]), "\n").alias("text")
    )


def _section(markdown):
    body = F.struct(F.lit("mrkdwn").alias("type"), markdown.alias("text"))
    return F.to_json(F.struct(F.lit("section").alias("type"), body.alias("text")))


def digest_blocks(mentions: DataFrame, brands: DataFrame, footer: str) -> DataFrame:
    """All message blocks as (brand_id, part, topic, block, json), sortable in that order."""
    topics = topic_counts(mentions)
    totals = topics.groupBy("brand_id").agg(F.sum("mentions").alias("total"))
    named = totals.join(brands.select(F.col("id").alias("brand_id"), "name"), "brand_id")
    key = lambda part, topic, block: [
        F.lit(part).alias("part"), topic.alias("topic"), block.cast("long").alias("block")
    ]
    header = named.select(
        "brand_id", *key(0, F.lit(""), F.lit(0)),
        _section(F.format_string("🔔 *New Media Mentions for %s*\n_%d new mentions found_", "name", "total")).alias("json"),
    )
    divider = named.select("brand_id", *key(1, F.lit(""), F.lit(0)), F.to_json(F.struct(F.lit("divider").alias("type"))).alias("json"))
    headings = topics.select(
        "brand_id", *key(2, F.col("topic"), F.lit(-1)),
        _section(F.format_string("*📂 %s* (%d mentions)", "topic", "mentions")).alias("json"),
    )
    bullets = bullet_blocks(mentions).select("brand_id", *key(2, F.col("topic"), F.col("block")), _section(F.col("text")).alias("json"))
    note = F.struct(F.lit("mrkdwn").alias("type"), F.lit(footer).alias("text"))
    end = named.select(
        "brand_id", *key(3, F.lit(""), F.lit(0)),
        F.to_json(F.struct(F.lit("context").alias("type"), F.array(note).alias("elements"))).alias("json"),
    )
    return header.unionByName(divider).unionByName(headings).unionByName(bullets).unionByName(end)
