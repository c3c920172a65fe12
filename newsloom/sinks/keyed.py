"""Insert-ignore through a key table in hash buckets, so that a micro-batch reads only the buckets of its own keys.

Beside a table at ``path`` lies ``<path>_keys``: the keys and ids of its rows, partitioned by a hash of the key. An id is that
hash with its low bits free; keys whose hashes agree in all other bits lie in one bucket and take different low bits, so
ids are unique without a counter, and the same key always finds the same bucket.

Rows are written before their keys. A batch that failed in between has left an intent (its token and date); when it is run again
with that token, rows of its ids that are already there, looked for on that date only, are not written again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from newsloom.operators.dedup import last_in_batch
from newsloom.session import cut_lineage
from newsloom.sinks import tables

#: Buckets of a key table; every call on one table must name the same number.
BUCKETS = 64
#: Keys that may share all hash bits but the low ones; a sixteenth raises an error.
SLOT_BITS = 4


def identity(keys: list[str]) -> Column:
    """Hash of a key with its low bits cleared."""
    return F.shiftleft(F.shiftright(F.xxhash64(*keys), SLOT_BITS), SLOT_BITS)


def bucket_of(identity: Column, buckets: int) -> Column:
    return F.pmod(F.shiftright(identity, SLOT_BITS), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written yet
        return None


def _with_bucket(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    named = rows.withColumn("identity", identity(keys))
    return named.withColumn("bucket", bucket_of(F.col("identity"), buckets))


def known_keys(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, identity, id, bucket of the stored keys in the buckets of ``rows`` (with ``bucket``); other buckets are not read."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [*[T.StructField(k, kinds[k]) for k in keys], T.StructField("identity", T.LongType()), T.StructField("id", T.LongType())]
    schema = T.StructType([*fields, T.StructField("bucket", T.IntegerType())])
    stored = _stored(spark, f"{path}_keys/rows", schema)
    if stored is None:
        return spark.createDataFrame([], schema)
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    return stored.filter(F.col("bucket").isin(touched))


def unseen(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (one per key, with ``identity`` and ``bucket``) whose key is not known, with their ids."""
    fresh = rows.join(known.select("bucket", *keys), ["bucket", *keys], "left_anti")
    taken = known.groupBy("bucket", "identity").agg(F.max(F.col("id") - F.col("identity") + 1).alias("_taken"))
    place = F.row_number().over(Window.partitionBy("bucket", "identity").orderBy(*keys)) - 1
    slot = F.coalesce("_taken", F.lit(0)) + F.col("_place")
    full = F.raise_error(F.lit("too many keys share one hash"))
    numbered = fresh.withColumn("_place", place).join(taken, ["bucket", "identity"], "left")
    return numbered.withColumn("id", F.when(slot < (1 << SLOT_BITS), F.col("identity") + slot).otherwise(full.cast("bigint"))).drop("_place", "_taken")


def insert_ignore(
    spark: SparkSession, batch: DataFrame, path: str, schema: T.StructType, keys: list[str], created_at: Column | None = None,
    partition_by: str | None = None, order: str = "seq", token: str | None = None, buckets: int = BUCKETS,
) -> int:
    """Appends the last row of every unseen key; returns how many rows were saved.

    Running the same batch again saves nothing. ``token`` names the batch across retries; with it a batch that failed half-way is completed.
    """
    latest = cut_lineage(_with_bucket(last_in_batch(batch, keys, order), keys, buckets))
    fresh = unseen(latest, known_keys(spark, path, latest, keys), keys)
    if created_at is not None:
        fresh = fresh.withColumn("created_at", created_at)
    if partition_by == "created_date":
        fresh = fresh.withColumn("created_date", F.to_date("created_at"))
    fresh = cut_lineage(fresh)
    saved = fresh.count()
    if saved == 0:
        return 0
    rows = fresh
    if token is not None and "id" in schema.fieldNames():
        rows = _unwritten(spark, fresh, path, schema, partition_by, token)
    shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    writer = shaped.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    listed = fresh.select(*keys, "identity", "id", "bucket").repartition("bucket")
    listed.write.mode("append").partitionBy("bucket").parquet(f"{path}_keys/rows")
    return saved


def _unwritten(spark: SparkSession, fresh: DataFrame, path: str, schema: T.StructType, partition_by: str | None, token: str) -> DataFrame:
    intents = f"{path}_keys/intents/{token}"
    kind = schema[partition_by].dataType if partition_by else T.StringType()
    before = _stored(spark, intents, T.StructType([T.StructField("part", kind)]))
    if before is None:
        part = F.col(partition_by) if partition_by else F.lit(None).cast("string")
        fresh.select(part.alias("part")).distinct().write.parquet(intents)
        return fresh
    there = _stored(spark, path, schema)
    if there is None:
        return fresh
    if partition_by:
        there = there.filter(F.col(partition_by).isin([r["part"] for r in before.distinct().collect()]))
    return fresh.join(there.select("id"), "id", "left_anti")


def ids_of(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with the id of their stored key; rows whose key is not stored go. Only their buckets are read."""
    asked = cut_lineage(_with_bucket(rows, keys, buckets))
    known = known_keys(spark, path, asked, keys).select("bucket", *keys, "id")
    return asked.join(known, ["bucket", *keys]).drop("bucket", "identity")


def compact_keys(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, buckets: list[int]) -> None:
    """Rewrites the named buckets of the key table with one file each; micro-batches leave a file per bucket they touch."""
    kinds = [T.StructField(k, schema[k].dataType) for k in keys]
    listed = T.StructType([*kinds, T.StructField("identity", T.LongType()), T.StructField("id", T.LongType()), T.StructField("bucket", T.IntegerType())])
    some = spark.read.schema(listed).parquet(f"{path}_keys/rows").filter(F.col("bucket").isin(buckets))
    tables.overwrite(some.repartition("bucket"), f"{path}_keys/rows", "bucket")
