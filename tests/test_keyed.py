"""Insert-ignore through the key table: replays, hash collisions, and what a batch reads."""

import pytest
from pyspark.sql import functions as F

from newsloom.schemas import MENTION
from newsloom.sinks import keyed
from newsloom.streaming import ingest

KEYS = ["post_link", "topic_id"]


def batch(spark, rows):
    df = spark.createDataFrame(rows, "seq bigint, caption string, post_link string, topic_id bigint")
    return df.selectExpr(
        "*", "timestamp'2024-01-30' as published_at", "'' as content_teaser", "1L as platform_id", "1L as brand_id",
        "cast(null as bigint) as primary_keyword_id", "false as read_status", "false as notified_status",
    )


def save(spark, path, rows, **more):
    return keyed.insert_ignore(spark, batch(spark, rows), path, MENTION, KEYS, F.lit("2024-01-30").cast("timestamp"), "created_date", **more)


def captions(spark, path):
    return sorted(r.caption for r in spark.read.schema(MENTION).parquet(path).collect())


def test_last_row_per_unseen_key(spark, tmp_path):
    path = f"{tmp_path}/m"
    assert save(spark, path, [(1, "a", "l1", 1), (2, "b", "l1", 1), (3, "c", "l2", 1), (4, "n", None, 1)]) == 2
    assert save(spark, path, [(5, "d", "l1", 1), (6, "e", "l1", 2)]) == 1
    assert save(spark, path, [(5, "d", "l1", 1)]) == 0
    assert captions(spark, path) == ["b", "c", "e"]
    ids = keyed.ids_of(spark, path, spark.createDataFrame([("l1", 2), ("l9", 1)], "post_link string, topic_id bigint"), KEYS).collect()
    stored = {(r.post_link, r.topic_id): r.id for r in spark.read.schema(MENTION).parquet(path).collect()}
    assert [(r.post_link, r.topic_id, r.id) for r in ids] == [("l1", 2, stored["l1", 2])] and len(set(stored.values())) == 3


def test_a_batch_that_failed_half_way_is_completed(spark, tmp_path):
    """Rows were written, keys were not: the retry writes the keys and no row twice, though its rows are others by now."""
    path = f"{tmp_path}/m"
    first = [(1, "a", "l1", 1), (2, "b", "l2", 1)]
    assert save(spark, path, first, token="s-0") == 2
    rows = spark.read.schema(MENTION).parquet(path)
    spark.createDataFrame(rows.limit(1).collect(), MENTION).write.partitionBy("created_date").parquet(f"{tmp_path}/n")
    spark.read.parquet(f"{path}_keys/intents/s-0").write.parquet(f"{tmp_path}/n_keys/intents/s-0")
    assert save(spark, f"{tmp_path}/n", first, token="s-0") == 2
    assert captions(spark, f"{tmp_path}/n") == ["a", "b"]
    assert save(spark, f"{tmp_path}/n", first, token="s-1") == 0


def test_keys_with_one_hash_get_ids_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "identity", lambda keys: F.lit(64).cast("bigint"))
    path = f"{tmp_path}/m"
    assert save(spark, path, [(i, str(i), f"l{i}", 1) for i in range(5)]) == 5
    assert save(spark, path, [(i, str(i), f"l{i}", 1) for i in range(9)]) == 4
    assert sorted(r.id for r in spark.read.schema(MENTION).parquet(path).collect()) == list(range(64, 73))
    with pytest.raises(Exception, match="share one hash"):
        save(spark, path, [(i, str(i), f"l{i}", 1) for i in range(30)])


def test_only_the_batches_own_buckets_are_read(spark, tmp_path):
    path = f"{tmp_path}/m"
    save(spark, path, [(i, str(i), f"l{i}", 1) for i in range(400)])
    rows = keyed._with_bucket(batch(spark, [(1, "a", "l1", 1), (2, "b", "x", 1)]), KEYS, keyed.BUCKETS)
    known = keyed.known_keys(spark, path, rows, KEYS)
    buckets = {r.bucket for r in rows.collect()}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and all(str(b) in plan.split("PartitionFilters: [")[1].split("]")[0] for b in buckets)
    read = [r[0] for r in known.select(F.input_file_name()).distinct().collect()]
    assert len(read) <= len(buckets) < len(spark.read.parquet(f"{path}_keys/rows").inputFiles())
    keyed.compact_keys(spark, path, KEYS, MENTION, sorted(buckets))
    assert save(spark, path, [(1, "a", "l1", 1)]) == 0 and spark.read.parquet(f"{path}_keys/rows").count() == 400


def test_links_read_the_key_table_only(spark, tmp_path):
    path = f"{tmp_path}/m"
    save(spark, path, [(1, "a", "l1", 1)])
    links = spark.createDataFrame([("l1", 1, 7, "title", 1), ("l1", 1, 8, "both", 1), ("l2", 1, 7, "title", 1)], "post_link string, topic_id int, keyword_id bigint, matched_in string, score int")
    assert ingest.write_links(spark, links, path, f"{tmp_path}/l") == 2
    assert ingest.write_links(spark, links, path, f"{tmp_path}/l") == 0
