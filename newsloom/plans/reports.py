"""Mention queries and report aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsloom.functions import dates, text
from newsloom.functions.queries import clamp
from newsloom.operators import filters, joins
from newsloom.operators.ordered import row_numbers, top_per_key

REPORT_TYPES = ("weekly", "crisis", "summary", "custom")


def mention_page(
    mentions: DataFrame, brands: DataFrame, topics: DataFrame, platforms: DataFrame, profile_id,
    skip: int = 0, limit: int = 100, start=None, end=None, admin: bool = False, **equal,
) -> DataFrame:
    """One page of the user's mentions, newest first, with brand, topic and platform embedded.

    The page is cut before the embedding joins, so they touch at most ``limit`` rows.
    """
    rows = joins.owned_by(mentions, brands, profile_id, admin)
    rows = filters.published_between(filters.where_given(rows, **equal), start, end)
    newest = [F.desc("created_at"), F.desc("id")]
    page = rows.orderBy(*newest).offset(skip).limit(clamp(limit, 1, 1000))
    return joins.embed_mention(page, brands, topics, platforms).orderBy(*newest)


def topic_breakdown(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions and unread mentions per group, largest group first."""
    counts = mentions.groupBy(*keys).agg(
        F.count("*").alias("mentions"), F.count_if(~F.coalesce("read_status", F.lit(False))).alias("unread")
    )
    return counts.orderBy(F.desc("mentions"), *keys)


def distribution(mentions: DataFrame, column: str, default: str = "N/A") -> DataFrame:
    named = F.coalesce(F.col(column), F.lit(default)).alias(column)
    return mentions.groupBy(named).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), column)


def daily_activity(mentions: DataFrame, days: int = 7, column: str = "published_at") -> DataFrame:
    """Mentions per date, latest dates first."""
    daily = mentions.filter(F.col(column).isNotNull()).groupBy(F.date_format(column, "yyyy-MM-dd").alias("day"))
    return daily.agg(F.count("*").alias("mentions")).orderBy(F.desc("day")).limit(days)


def grouped_report(mentions: DataFrame) -> DataFrame:
    """Topic, platform and day breakdowns from one scan (grouping sets)."""
    rows = mentions.select(
        F.coalesce("topic", F.lit("N/A")).alias("topic"),
        F.coalesce("platform", F.lit("N/A")).alias("platform"),
        F.date_format("published_at", "yyyy-MM-dd").alias("day"),
        (~F.coalesce("read_status", F.lit(False))).alias("unread"),
    )
    grouped = rows.groupingSets(
        [[F.col("topic")], [F.col("platform")], [F.col("day")]], F.col("topic"), F.col("platform"), F.col("day")
    ).agg(F.grouping_id().alias("_set"), F.count("*").alias("mentions"), F.count_if("unread").alias("unread"))
    kind = F.when(F.col("_set") == 3, F.lit("topic")).when(F.col("_set") == 5, F.lit("platform")).otherwise(F.lit("day"))
    named = grouped.select(
        kind.alias("kind"), F.coalesce("topic", "platform", "day").alias("name"), "mentions", "unread"
    )
    return named.filter(F.col("name").isNotNull())


def brand_profile(mentions: DataFrame) -> DataFrame:
    """Per brand: its total and unread row, then its topics and platforms with counts."""
    sets = [[F.col("brand_id")], [F.col("brand_id"), F.col("topic")], [F.col("brand_id"), F.col("platform")]]
    grouped = mentions.groupingSets(sets, F.col("brand_id"), F.col("topic"), F.col("platform")).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("mentions"), F.count_if(~F.col("read_status")).alias("unread")
    )
    kind = F.when(F.col("_set") == 3, F.lit("brand")).when(F.col("_set") == 1, F.lit("topic")).otherwise(F.lit("platform"))
    return grouped.select(
        "brand_id", kind.alias("kind"), F.coalesce("topic", "platform", F.lit("")).alias("name"), "mentions", "unread"
    )


def samples(mentions: DataFrame, per_brand: int = 3) -> DataFrame:
    """First mentions of every brand, newest first, with their display text."""
    newest = [F.desc("created_at"), F.desc("id")]
    return top_per_key(mentions, ["brand_id"], newest, per_brand, name="rank")


def share_of_attention(mentions: DataFrame, key: str = "brand_id") -> DataFrame:
    """Volume and share per brand; the total is a scalar subquery over the grouped counts."""
    volume = mentions.groupBy(key).agg(F.count("*").alias("mentions"))
    total = volume.agg(F.sum("mentions")).scalar()
    return volume.select(key, "mentions", F.round(F.col("mentions") / total, 4).alias("share"))


def attempt_plan(days: int, limit: int = 50) -> list[tuple[int, int]]:
    """Window and row limit of the three retrieval attempts."""
    days, limit = clamp(days, 1), clamp(limit, 10)
    return [(days, limit), (days, min(120, 2 * limit)), (min(180, 2 * days), min(200, 3 * limit))]


def adaptive_window(mentions: DataFrame, as_of, days: int, limit: int = 50, wanted: int = 20, key: str = "brand_id") -> DataFrame:
    """Effective window per brand: the first attempt with enough rows, else the largest.

    One scan at the widest window counts every attempt's rows.
    """
    plan = attempt_plan(days, limit)
    widest = filters.recent(mentions, as_of, max(d for d, _ in plan))
    counts = widest.groupBy(key).agg(
        *[
            F.least(F.count_if(F.col("created_at") >= dates.days_before(as_of, d)), F.lit(cap)).alias(f"_n{i}")
            for i, (d, cap) in enumerate(plan)
        ]
    )
    pick = lambda i: F.struct(
        F.lit(plan[i][0]).alias("effective_days"), F.lit(plan[i][1]).alias("effective_limit"), F.col(f"_n{i}").alias("rows")
    )
    n0, n1, n2 = (F.col(f"_n{i}") for i in range(3))
    # Later attempts only replace earlier ones by returning more rows.
    second = F.when(n1 > n0, pick(1)).otherwise(pick(0))
    third = F.when(n2 > F.greatest(n0, n1), pick(2)).otherwise(second)
    chosen = F.when(n0 >= wanted, pick(0)).when(n1 >= wanted, second).otherwise(third)
    return counts.select(key, chosen.alias("_c")).select(key, "_c.*")


def adaptive_rows(mentions: DataFrame, as_of, days: int, limit: int = 50, wanted: int = 20) -> DataFrame:
    """The mentions each brand's effective window returns, newest first."""
    plan = adaptive_window(mentions, as_of, days, limit, wanted)
    widest = filters.recent(mentions, as_of, max(d for d, _ in attempt_plan(days, limit)))
    in_window = widest.join(plan, "brand_id").filter(
        F.col("created_at") >= dates.days_before(as_of, F.col("effective_days"))
    )
    largest = max(cap for _, cap in attempt_plan(days, limit))
    ranked = top_per_key(in_window, ["brand_id"], [F.desc("created_at"), F.desc("id")], largest, name="rank")
    return ranked.filter(F.col("rank") <= F.col("effective_limit"))


def compare_brands(mentions: DataFrame, brands: DataFrame, names: list[str], as_of, days: int = 7) -> DataFrame:
    """Volume and share of the named brands in their effective windows, uncapped, and how many rows the attempt shows."""
    wanted = brands.filter(F.lower(F.trim("name")).isin(*[n.strip().lower() for n in names]))
    rows = mentions.join(wanted.select(F.col("id").alias("brand_id"), "name"), "brand_id")
    window = adaptive_window(rows, as_of, days)
    inside = rows.join(window, "brand_id").filter(F.col("created_at") >= dates.days_before(as_of, F.col("effective_days")))
    volume = inside.groupBy("name", "effective_days", "effective_limit", F.col("rows").alias("shown")).agg(F.count("*").alias("mentions"))
    total = volume.agg(F.sum("mentions")).scalar()
    return volume.select(
        "name", "effective_days", "effective_limit", "shown", "mentions", F.round(F.col("mentions") / total, 4).alias("share")
    )


def trend(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Daily mention series with its unread part."""
    return mentions.groupBy(*keys, F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("mentions"), F.count_if(~F.col("read_status")).alias("unread")
    )


def monitoring_status(mentions: DataFrame) -> DataFrame:
    return mentions.agg(
        F.count("*").alias("total"), F.count_if(~F.col("read_status")).alias("unread"),
        F.count_distinct("brand_id").alias("brands"),
    )


def mention_lines(mentions: DataFrame) -> DataFrame:
    """One text line pair per mention, as shown to analysts."""
    when = F.coalesce(F.date_format(F.coalesce("published_at", "created_at"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("N/A"))
    line = F.concat(
        F.lit("- Mention #"), F.col("id").cast("string"), F.lit(" | "), when, F.lit(" | Topic: "),
        F.coalesce("topic", F.lit("N/A")), F.lit(" | Platform: "), F.coalesce("platform", F.lit("N/A")),
        F.lit("\n  Text: "), text.mention_display("caption", "content_teaser"),
    )
    return mentions.withColumn("line", line)


def report_lines(mentions: DataFrame, days: int = 7, sample_rows: int = 15) -> DataFrame:
    """Report body as ordered rows (section, position, line); the text stays in rows, so a report
    over any volume is never one value."""
    # Only grouped rows (topics, platforms, days) and the samples are numbered, never mentions.
    numbered = lambda df, section, order, line: df.select(
        F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("position"), line.alias("line")
    )
    by_topic = numbered(
        topic_breakdown(mentions, ["topic"]), "1 topics", [F.desc("mentions"), "topic"],
        F.format_string("  • %s: %d mentions (%d unread)", "topic", "mentions", "unread"),
    )
    by_platform = numbered(
        distribution(mentions, "platform"), "2 platforms", [F.desc("mentions"), "platform"],
        F.format_string("  • %s: %d mentions", "platform", "mentions"),
    )
    by_day = numbered(
        daily_activity(mentions, days), "3 days", [F.desc("day")], F.format_string("  • %s: %d mentions", "day", "mentions")
    )
    newest = mentions.orderBy(F.desc("created_at"), F.desc("id")).limit(sample_rows)
    shown = numbered(
        newest, "4 samples", [F.desc("created_at"), F.desc("id")],
        F.format_string(
            "[%s] %s - %s %s...", "topic", "platform", F.date_format("published_at", "yyyy-MM-dd"),
            F.left(F.coalesce("caption", F.lit("")), F.lit(150)),
        ),
    )
    return by_topic.unionByName(by_platform).unionByName(by_day).unionByName(shown)


def valid_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports with an allowed type, and the rejected ones."""
    ok = F.coalesce(F.col("report_type").isin(*REPORT_TYPES), F.lit(False))
    return reports.filter(ok), reports.filter(~ok)


def tools_used(messages: DataFrame) -> DataFrame:
    """Distinct tool names per run in first-use order (the tool set is small and fixed)."""
    firsts = messages.filter(F.coalesce("tool_name", F.lit("")) != "").groupBy("run_id", "tool_name").agg(F.min("seq").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "tool_name")))
    return firsts.groupBy("run_id").agg(F.transform(ordered, lambda t: t["tool_name"]).alias("tools"))


def run_rollup(runs: DataFrame, user: str) -> DataFrame:
    """Per user: found and saved sums, failed brands and error count. Error texts stay rows."""
    failed = F.col("status").isin("error", "not_found")
    return runs.groupBy(user).agg(
        F.count("*").alias("runs"), F.count_if(failed).alias("failed"),
        F.sum("found").alias("found"), F.sum("saved").alias("saved"),
        F.count("error").alias("errors"),
    )


def scheduler_summary(runs: DataFrame) -> DataFrame:
    bad = F.col("status").isin("error", "not_found")
    return runs.agg(
        F.count_if(~bad).alias("successful"), F.count_if(bad).alias("failed"),
        F.coalesce(F.sum(F.when(~bad, F.col("saved"))), F.lit(0)).alias("saved"),
    )


def last_turns(messages: DataFrame, turns: int = 6) -> DataFrame:
    return top_per_key(messages, ["chat_id"], [F.desc("turn")], turns)


def numbered_mentions(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions numbered per group in creation order. A batch shares one creation time, so time is
    no bucket here; rows are range-partitioned instead."""
    return row_numbers(mentions, keys, ["created_at", "id"], None, "position")
