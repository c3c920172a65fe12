"""Streaming ingestion: landed mentions, stateful URL dedup, idempotent micro-batch writes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from newsloom import settings
from newsloom.functions import url
from newsloom.functions.fuzzy import Peer, Tile, first_kept
from newsloom.operators import dedup
from newsloom.schemas import MENTION, MENTION_KEYWORD
from newsloom.sinks import keyed, tables


def landed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start_marks(brands: DataFrame, as_of: Column) -> DataFrame:
    """Cutoff per brand: its high-water mark, or a first backfill of its lookback days."""
    days = F.coalesce(F.nullif("initial_lookback_days", F.lit(0)), F.lit(1)).cast("int")
    return brands.select(
        F.col("id").alias("brand_id"),
        F.coalesce("last_scraped_at", as_of - F.make_dt_interval(days=days)).alias("cutoff"),
    )


def advance_marks(brands: DataFrame, finished: DataFrame, run_start: Column) -> DataFrame:
    """Moves the mark of every finished brand to the run *start*, also for empty runs."""
    return tables.update_by_keys(brands, finished, "id", last_scraped_at=run_start)


def since_marks(mentions: DataFrame, marks: DataFrame) -> DataFrame:
    """Late and old rows go: a mention must be dated and not before its brand's cutoff."""
    return mentions.join(marks, "brand_id").filter(F.col("published_at") >= F.col("cutoff")).drop("cutoff")


SINCE_REASONS = ("unknown_brand", "missing_date", "before_cutoff")


def since_marks_observed(mentions: DataFrame, marks: DataFrame, name: str = "since_marks") -> DataFrame:
    """``since_marks`` that counts, in the same pass, the rows seen and the rows dropped for each of ``SINCE_REASONS``.

    The counts are observed metrics called ``name``: a stream reports them with every micro-batch (``dropped_rows``).
    """
    judged = mentions.join(marks, "brand_id", "left")
    reason = (
        F.when(F.col("cutoff").isNull(), F.lit("unknown_brand"))
        .when(F.col("published_at").isNull(), F.lit("missing_date"))
        .when(F.col("published_at") < F.col("cutoff"), F.lit("before_cutoff"))
    )
    counts = [F.count_if(F.coalesce(reason == r, F.lit(False))).alias(r) for r in SINCE_REASONS]
    return judged.observe(name, F.count(F.lit(1)).alias("rows"), *counts).filter(reason.isNull()).drop("cutoff")


class DroppedRows(StreamingQueryListener):
    """Adds up the observed counts ``name`` of all micro-batches of the streams of a session (``spark.streams.addListener``)."""

    def __init__(self, name: str = "since_marks"):
        self.name, self.totals = name, dict.fromkeys(("rows", *SINCE_REASONS), 0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if (seen := event.progress.observedMetrics.get(self.name)) is not None:
            for key in self.totals:
                self.totals[key] += seen[key]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def dropped_rows(query: StreamingQuery, name: str = "since_marks") -> dict[str, int]:
    """Sums of the observed counts over the micro-batches a query still reports (by default the last hundred)."""
    seen = [p.observedMetrics[name] for p in query.recentProgress if name in p.observedMetrics]
    return {key: sum(s[key] for s in seen) for key in ("rows", *SINCE_REASONS)}


def unique_links(stream: DataFrame, horizon: str = "3 days") -> DataFrame:
    """Stateful exact dedup on (brand, normalised URL); state older than the horizon is dropped."""
    keyed = stream.withColumn("norm_url", url.normalize_url("link")).withWatermark("published_at", horizon)
    return keyed.dropDuplicatesWithinWatermark(["brand_id", "norm_url"])


def write_mentions(
    stream: DataFrame, path: str, checkpoint: str, prepare=None, available_now: bool = True, link_path: str | None = None,
) -> StreamingQuery:
    """Insert-ignore per micro-batch, reading only the key buckets it touches. ``prepare`` maps a batch to (mention rows, keyword links or
    None); a replayed batch finds its keys stored and writes nothing."""

    stream_id = hashlib.md5(checkpoint.encode()).hexdigest()

    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows, links = prepare(batch) if prepare else (batch, None)
        keyed.insert_ignore(
            spark, rows, path, MENTION, ["post_link", "topic_id"], F.current_timestamp(), "created_date", token=f"{stream_id}-{epoch}"
        )
        if links is not None and link_path:
            write_links(spark, links, path, link_path)

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_links(spark: SparkSession, links: DataFrame, mention_path: str, link_path: str) -> int:
    """Keyword links of stored mentions, insert-ignore on (mention_id, keyword_id)."""
    named = links.withColumns({name: F.col(name).cast(MENTION[name].dataType) for name in ("post_link", "topic_id")})
    rows = keyed.ids_of(spark, mention_path, named, ["post_link", "topic_id"]).withColumnRenamed("id", "mention_id").withColumn("seq", F.lit(0))
    return keyed.insert_ignore(spark, rows, link_path, MENTION_KEYWORD, ["mention_id", "keyword_id"], F.current_timestamp())


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which ``unique_stories`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_STORY = {"seq": T.LongType(), "text": T.StringType(), "at": T.LongType(), "domain": T.StringType(), "wrapper": T.BooleanType(), "seen_us": T.LongType()}
STORY = T.StructType([T.StructField(name, kind) for name, kind in _STORY.items()])


class RecentStories(StatefulProcessor):
    """Keeps the stories of one block (scope and signature) for ``horizon_us`` after they were seen, and lets through rows that
    resemble none of them and no earlier row of their batch that was let through.

    Rows of a key that arrive together are taken in ``seq`` order. A timer forgets what is older than the horizon.
    """

    def __init__(self, key_names: list[str], threshold: float, window_us: int, horizon_us: int):
        self.key_names, self.threshold, self.window_us, self.horizon_us = key_names, threshold, window_us, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stories = handle.getListState("stories", STORY)

    def _remember(self, stories: list[tuple]) -> None:
        if stories:
            self.stories.put(stories)
        else:
            self.stories.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stories:
            self._forget_after(stories)

    def _forget_after(self, stories: list[tuple]) -> None:
        self.handle.registerTimer((min(s[-1] for s in stories) + self.horizon_us) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Rows alike in all that is compared share the fate of the first, so only that is held.
        first: dict[tuple, tuple] = {}
        for r in rows:
            row = tuple(r[name] for name in _STORY)
            if (other := first.get(row[1:5])) is None or row[0] < other[0]:
                first[row[1:5]] = row
        batch = sorted(first.values(), key=lambda s: s[0])
        # Every call to the state is a round trip, and most keys are new or have nothing to add.
        known = [tuple(s) for s in self.stories.get()]
        peer = lambda s: Peer.of(s[1], s[2], s[3], s[4])
        tile = Tile([peer(s) for s in batch], [s[0] for s in batch])
        kept = [batch[i] for i in first_kept(tile, self.threshold, self.window_us, [peer(s) for s in known])]
        if kept:
            self.stories.appendList(kept)
            if not known or min(s[-1] for s in kept) < min(s[-1] for s in known):
                self._forget_after(kept)
        found = Row(*self.key_names, "seq")
        yield from (found(*key, s[0]) for s in kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.horizon_us
        self._remember([tuple(s) for s in self.stories.get() if s[-1] >= oldest])
        yield from ()

    def close(self) -> None:
        pass


def unique_stories(
    stream: DataFrame, seen: str, scope: list[str] = ("brand_id",), late: str = "1 day", horizon_days: int = settings.HISTORY_DAYS,
    threshold: float = settings.FUZZY_THRESHOLD, day_window: int = settings.FUZZY_DAY_WINDOW, wrapper_hosts=settings.WRAPPER_HOSTS,
) -> DataFrame:
    """Fuzzy dedup over micro-batches: scope, signature, seq of the rows that resemble no story of the last ``horizon_days``.

    ``seen`` is the time a row arrived, on which the watermark runs; a row that comes more than ``late`` behind it goes. On batches
    cut by ``seq`` the result is that of ``dedup.near_dedup`` over all rows, as long as no story is older than the horizon. Rows
    with an empty title have no story and must be taken past this operator. State lives in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``); of one key it holds the stories of the horizon.
    """
    keyed = dedup.blocking_columns(stream.withWatermark(seen, late), list(scope), wrapper_hosts, [seen])
    rows = keyed.withColumn("seen_us", F.unix_micros(seen))
    kinds = dict(rows.dtypes)
    key = [*scope, "signature"]
    processor = RecentStories(key, max(1, min(threshold, 100)), dedup.span_us(day_window), horizon_days * dedup.DAY_US)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in key), "seq bigint"])
    return rows.groupBy(*key).transformWithState(processor, schema, outputMode="append", timeMode="EventTime")


def without_recent_stories(batch: DataFrame, path: str, as_of, spark: SparkSession) -> DataFrame:
    """Fuzzy horizon across runs: a micro-batch against the last days of the stored table."""
    table = tables.stored(spark, path, MENTION).select(
        "brand_id", F.col("id").alias("seq"), F.col("caption").alias("title"), "content_teaser",
        F.col("post_link").alias("link"), F.lit("").alias("platform"), "published_at", "created_at",
    )
    history = dedup.recent_history(table, as_of, ["brand_id"])
    return dedup.without_historical(batch, history, ["brand_id"])
