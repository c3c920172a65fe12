"""Writing and maintaining mention tables as Parquet folders (one writer per table).

Appends never rewrite stored rows. Updates rewrite only the partitions they touch; the new content
is materialised first, because Spark cannot overwrite a folder it is still reading.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom.functions.url import clean_domain_entry
from newsloom.operators.dedup import last_in_batch
from newsloom.session import cut_lineage

CLEARABLE = ("search_url_pattern", "rss_urls", "sitemap_url", "discovery_type")


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """Table content; an absent folder is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def with_ids(df: DataFrame, start: int, name: str = "id") -> DataFrame:
    """Consecutive ids from ``start + 1`` without a global sort: rows are numbered inside their
    partition and shifted by the sizes of the partitions before (one small row per partition)."""
    placed = cut_lineage(df.withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*df.columns[:1])))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return local.join(offsets, "_part").withColumn(name, F.col("_n") + F.col("_offset") + start).drop("_part", "_n", "_offset")


def next_start(table: DataFrame, name: str = "id") -> int:
    return table.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"]


def new_rows(batch: DataFrame, table: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Insert-ignore: last row per key of the batch whose key is not stored yet.

    Stored keys are first reduced to those the batch mentions. With a small batch that join is a
    broadcast of the batch, so the stored table is scanned but never shuffled.
    """
    latest = last_in_batch(batch, keys, order)
    known = table.select(*keys).join(batch.select(*keys).distinct(), keys, "left_semi")
    return latest.join(known, keys, "left_anti")


def insert_ignore(
    spark: SparkSession, batch: DataFrame, path: str, schema, keys: list[str], created_at: Column | None = None,
    partition_by: str | None = None, order: str = "seq",
) -> int:
    """Appends unseen keys with fresh ids; returns how many rows were saved.

    Running the same batch again saves nothing, which makes it safe to retry a micro-batch.
    """
    table = stored(spark, path, schema)
    fresh = cut_lineage(new_rows(batch, table, keys, order))
    if created_at is not None:
        fresh = fresh.withColumn("created_at", created_at)
    if partition_by == "created_date":
        fresh = fresh.withColumn("created_date", F.to_date("created_at"))
    saved = fresh.count()
    if saved == 0:
        return 0
    if "id" in schema.fieldNames() and "id" not in fresh.columns:
        fresh = with_ids(fresh, next_start(table))
    rows = fresh.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return saved


def merge_source_configs(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by domain: given values win, unset ones keep the stored value, except the discovery
    fields, which an update may clear. Of incoming rows with one cleaned domain the last by ``seq`` counts, or
    the greatest where there is no such column."""
    new = incoming.withColumn("domain", clean_domain_entry("domain"))
    order = F.struct("seq") if "seq" in new.columns else F.struct(*[F.col(c).cast("string") for c in new.columns])
    last = new.groupBy("domain").agg(F.max_by(F.struct(*new.columns), order).alias("_last")).select("_last.*")
    new = last.withColumn("_new", F.lit(True))
    both = current.alias("o").join(new.alias("n"), "domain", "full_outer")
    fields = []
    for c in current.columns:
        if c == "domain":
            continue
        merged = F.coalesce(f"n.{c}", f"o.{c}")
        if c in CLEARABLE:
            merged = F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        fields.append(merged.alias(c))
    return both.select("domain", *fields)


def overwrite(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replaces the table, or only the partitions present in ``df``."""
    ready = cut_lineage(df)
    writer = ready.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


def update_by_keys(df: DataFrame, keys: DataFrame, key: str, **values) -> DataFrame:
    """Sets columns of the rows whose key is listed; other rows and unset columns stay."""
    hit = df.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    for column, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        hit = hit.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)))
    return hit.drop("_hit").select(*df.columns)


def update_partitions(spark: SparkSession, path: str, schema, keys: DataFrame, key: str, partition: str, **values) -> None:
    """``update_by_keys`` on a stored table, rewriting only partitions that hold a listed key."""
    table = stored(spark, path, schema)
    touched = table.join(keys.select(key).distinct(), key, "left_semi").select(partition).distinct()
    overwrite(update_by_keys(table.join(touched, partition, "left_semi"), keys, key, **values), path, partition)


def cascade(tables: dict[str, DataFrame], root: str, doomed: DataFrame, links: list[tuple[str, str, str, str]]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Delete down the foreign-key chain: remaining rows and deleted rows per table.

    ``links`` = (child, child column, parent, parent column), parents before children. A dry run
    counts the deleted part and writes nothing.
    """
    gone = {root: tables[root].join(doomed, doomed.columns, "left_semi")}
    left = {root: tables[root].join(doomed, doomed.columns, "left_anti")}
    for child, column, parent, parent_column in links:
        keys = gone[parent].select(F.col(parent_column).alias(column)).distinct()
        rows = tables[child].join(keys, column, "left_semi")
        rest = left.get(child, tables[child]).join(keys, column, "left_anti")
        gone[child] = gone[child].unionByName(rows).distinct() if child in gone else rows
        left[child] = rest
    return left, gone


def deletion_counts(gone: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in gone.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def missing_dimension_rows(wanted: DataFrame, column: str, dim: DataFrame, name: str) -> DataFrame:
    """Distinct texts not yet in the dimension."""
    texts = wanted.select(F.trim(column).alias(name)).filter(F.col(name) != "").distinct()
    return texts.join(dim.select(name), name, "left_anti")


def get_or_create(dim: DataFrame, wanted: DataFrame, column: str, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(rows to append, complete dimension) so that every wanted text has an id."""
    fresh = with_ids(missing_dimension_rows(wanted, column, dim, name), next_start(dim)).select("id", name)
    return fresh, dim.select("id", name).unionByName(fresh)
