"""Evaluating a costly expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters and projections reuse instead of recomputing.

    The optimizer replaces a column used in a filter by its expression, so parsing a payload and
    then filtering on five of its fields would parse it five times. A one-row generator is a
    boundary the filter does not cross.
    """
    kept = df.drop(*columns)
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*[F.col(f"`{c}`") for c in kept.columns], F.inline(packed))
