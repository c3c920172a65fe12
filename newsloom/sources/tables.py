"""Parquet tables with column projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.session import prepare


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = prepare(spark).read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
