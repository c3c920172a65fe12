"""Counts that are observed while stages and streams run."""

import datetime as dt
import time

from pyspark.sql import functions as F

from newsloom.plans import ingest as plan
from newsloom.streaming import ingest

SCHEMA = "mention_id bigint, seq bigint, brand_id bigint, title string, content_teaser string, link string, platform string, published_raw string, published_at timestamp"
DAY = dt.datetime(2024, 1, 30)


def test_every_stage_is_counted_once(spark):
    row = lambda i, title, link, raw="x", at=DAY: (i, i, 1, title, "", link, "p", raw, at)
    rows = [
        row(1, "Den samme titel om en ny fond", "https://a.dk/1"), row(2, "Den samme titel om en ny fonds", "https://a.dk/2"),
        row(3, "En anden", "https://a.dk/1/"), row(4, "Uden link", None), row(5, "Heller ikke", ""), row(6, "Ingen dato", "https://a.dk/6", None, None),
        row(7, "Ulæselig dato", "https://a.dk/7", "i går?", None), row(8, "For gammel", "https://a.dk/8", "x", DAY - dt.timedelta(days=9)),
        row(9, "Noget irrelevant om vejret", "https://a.dk/9"),
    ]
    verdicts = spark.createDataFrame([(9, False), (1, True)], "mention_id bigint, relevant boolean")
    history = spark.createDataFrame([(50, 1, "Helt andre nyheder fra i går", "", "https://a.dk/h", "p", DAY, DAY)], "seq bigint, brand_id bigint, title string, content_teaser string, link string, platform string, published_at timestamp, created_at timestamp")
    stages = plan.filter_mentions(spark.createDataFrame(rows, SCHEMA), F.lit("2024-01-28").cast("timestamp"), ["brand_id"], verdicts=verdicts, history=history)
    assert [tuple(r) for r in plan.stage_removals(stages).collect()] == [
        ("dated", 9, 6, 3), ("linked", 6, 4, 2), ("unique_url", 4, 3, 1), ("unique_story", 3, 2, 1), ("in_language", 2, 2, 0), ("relevant", 2, 1, 1), ("new", 1, 1, 0),
    ]
    assert {r.reason: r.rows for r in plan.drop_reasons(stages).collect()} == {
        "missing_date": 1, "unparseable_date": 1, "before_cutoff": 1, "missing_link": 2, "url_duplicate": 1,
    }
    assert [r.seq for r in stages.new.collect()] == [1]


def test_an_empty_table_counts_nothing(spark):
    stages = plan.filter_mentions(spark.createDataFrame([], SCHEMA), F.lit("2024-01-28").cast("timestamp"), ["brand_id"])
    assert {(r.rows_in, r.rows_out, r.removed) for r in plan.stage_removals(stages).collect()} == {(0, 0, 0)}


def test_streams_report_what_they_drop(spark, tmp_path):
    schema = "brand_id bigint, published_at timestamp, event_id bigint"
    marks = spark.createDataFrame([(1, DAY)], "brand_id bigint, cutoff timestamp")
    for part in range(2):
        rows = [(1, DAY, 1), (1, DAY - dt.timedelta(hours=1), 2), (1, None, 3), (7, DAY, 4), (7, None, 5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = ingest.DroppedRows()
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        kept = ingest.since_marks_observed(stream, marks)
        sink = kept.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet")
        running = sink.option("path", f"{tmp_path}/out").start()
        running.awaitTermination()
        want = {"rows": 10, "unknown_brand": 4, "missing_date": 2, "before_cutoff": 2}
        assert ingest.dropped_rows(running) == want
        assert spark.read.schema(schema).parquet(f"{tmp_path}/out").count() == 2
        for _ in range(50):
            if seen.totals == want:
                break
            time.sleep(0.2)
        assert seen.totals == want
    finally:
        spark.streams.removeListener(seen)
