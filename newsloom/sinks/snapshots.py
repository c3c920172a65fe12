"""Run artifacts: stage snapshots and run metadata as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom import settings


def snapshot(mentions: DataFrame, run_id: str, stage: str, order: list, limit: int = settings.SNAPSHOT_MENTIONS) -> tuple[DataFrame, DataFrame]:
    """(exported rows, one summary row) of a stage; the export is a top-k by design."""
    stamp = lambda df: df.withColumn("run_id", F.lit(run_id)).withColumn("stage", F.lit(stage))
    exported = stamp(mentions.orderBy(*order).limit(limit))
    total = mentions.agg(F.count("*").alias("total_mentions"))
    summary = stamp(total).select(
        "run_id", "stage", "total_mentions",
        F.least("total_mentions", F.lit(limit)).alias("exported_mentions"),
        (F.col("total_mentions") > limit).alias("truncated"),
        F.lit(limit).alias("max_mentions"),
    )
    return exported, summary


def write_snapshot(mentions: DataFrame, path: str, run_id: str, stage: str, order: list) -> None:
    exported, summary = snapshot(mentions, run_id, stage, order)
    exported.write.mode("append").partitionBy("run_id", "stage").json(f"{path}/mentions")
    summary.write.mode("append").partitionBy("run_id", "stage").json(f"{path}/summary")


def write_run_metadata(spark, path: str, run_id: str, metadata: dict) -> None:
    pairs = [x for k, v in metadata.items() for x in (F.lit(str(k)), F.lit(None if v is None else str(v)))]
    row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.create_map(*pairs).alias("metadata"))
    row.write.mode("append").partitionBy("run_id").json(path)
