"""Fuzzy dedup over micro-batches against the batch operator, and what the state forgets."""

import datetime as dt

from newsloom import catalog
from newsloom.streaming import ingest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "seq bigint, brand_id bigint, title string, content_teaser string, link string, platform string, published_at timestamp, seen_at timestamp"
BASE = dt.datetime(2024, 1, 10)


def test_five_batches_equal_near_dedup(spark):
    rows = lambda name: sorted(r.mention_id for r in catalog.queries()[name](spark, FOLDER).select("mention_id").collect())
    want = rows("near_dedup")
    assert rows("stream_unique_stories") == want and 0 < len(want)


def run(spark, tmp_path, batches):
    schema = spark.createDataFrame([], SCHEMA).schema
    kept = []
    with ingest.rocksdb_state(spark):
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
            stories = ingest.unique_stories(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "seen_at", late="1 hour")
            sink = stories.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet")
            sink.option("path", f"{tmp_path}/out").start().awaitTermination()
            kept.append(sorted(r.seq for r in spark.read.schema(stories.schema).parquet(f"{tmp_path}/out").collect()))
    return kept


def test_batches_horizon_and_order(spark, tmp_path):
    day = dt.timedelta(days=1)
    row = lambda seq, title, seen, at=None, host="a.dk": (seq, 1, title, "", f"https://{host}/{seq}", "", at, BASE + seen * day)
    same = "Samme titel om den nye fond"
    batches = [
        [row(2, same, 0), row(1, same + "s", 0), row(3, "En helt anden historie om vejret", 0), row(4, same, 0, host="b.dk")],
        [row(5, same, 1), row(6, "En helt anden historie om vejret i dag og i morgen", 1, host="news.google.com")],
        # A story of another key moves the watermark past the horizon of the first.
        [row(7, "Noget nyt som ingen har set endnu", 6)],
        [row(8, same, 6), row(9, same, 6)],
    ]
    kept = run(spark, tmp_path, batches)
    # 2 resembles 1, which stands before it; 4 is another domain's; 5 and 6 are known.
    assert kept[0] == [1, 3, 4] and kept[1] == [1, 3, 4] and kept[2] == [1, 3, 4, 7]
    # The state of the first story was dropped when the watermark passed its horizon.
    assert kept[3] == [1, 3, 4, 7, 8]
