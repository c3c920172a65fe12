"""Running totals, ranks and lags that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a hot key into one task. Here the caller names a bucket
expression that grows with the order (an hour, a range of sequence numbers): rows are ranked
inside (key, bucket), and each bucket starts from the total of the buckets before it. Without a
natural bucket (``None``) the rows are range-partitioned by key and order, and the partition number
is the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.session import cut_lineage


def _bucketed(df: DataFrame, keys: list[str], order: list, bucket: Column | None) -> DataFrame:
    if bucket is not None:
        return df.withColumn("_bucket", bucket)
    # Stored once, because a partition number only means something for one execution.
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_bucket", F.spark_partition_id()))


def running_totals(
    df: DataFrame, keys: list[str], order: list, values: dict[str, Column], bucket: Column | None,
    exclusive: bool = False,
) -> DataFrame:
    """Adds per name the sum of its value over the rows up to (or strictly before) each row."""
    rows = _bucketed(df, keys, order, bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_part_{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    or_zero = lambda c: F.coalesce(c, F.lit(0))
    starts = totals.select(
        *keys, "_bucket", *[or_zero(F.sum(f"_part_{n}").over(before)).alias(f"_start_{n}") for n in values]
    )
    inner = rows.withColumns({f"_inner_{n}": or_zero(F.sum(v).over(inside)) for n, v in values.items()})
    summed = inner.join(starts, [*keys, "_bucket"]).withColumns(
        {n: F.col(f"_inner_{n}") + F.col(f"_start_{n}") for n in values}
    )
    return summed.drop("_bucket", *[f"_inner_{n}" for n in values], *[f"_start_{n}" for n in values])


def running_total(
    df: DataFrame, keys: list[str], order: list, value: Column, bucket: Column | None, name: str,
    exclusive: bool = False,
) -> DataFrame:
    return running_totals(df, keys, order, {name: value}, bucket, exclusive)


def row_numbers(df: DataFrame, keys: list[str], order: list, bucket: Column | None, name: str) -> DataFrame:
    """Row number per key, starting at 1."""
    return running_total(df, keys, order, F.lit(1), bucket, name)


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column | None, name: str
) -> DataFrame:
    """Adds ``name`` = ``value`` of the row before (null for the first row of a key)."""
    rows = _bucketed(df, keys, order, bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    lasts = rows.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = lasts.select(
        *keys, "_bucket",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"),
    )
    return (
        rows.withColumn("_lag", F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(carried, [*keys, "_bucket"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_lag", "_first", "_carry", "_bucket")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, name: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark cuts every map task's output to ``k`` rows per key before
    the shuffle, so a hot key costs no more than ``k`` rows per task."""
    rank = name or "_rank"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(rank) <= k)
    return kept if name else kept.drop(rank)
