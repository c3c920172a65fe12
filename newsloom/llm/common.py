"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.sources.tables import read_table

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = dedent(sql).strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, name, list(columns))


def unused_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def finite(vector: Column) -> Column:
    """Not null, every component a finite number."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & inside, F.lit(False))


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches held to 4 MB in its session: what a Python worker holds must not grow with the rows' size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def release() -> None:
    """Gives back what Arrow keeps for later; Python workers outlive their tasks and stages."""
    pa.default_memory_pool().release_unused()
