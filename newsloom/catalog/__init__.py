"""Registered queries and their SQL twins."""

from newsloom.catalog import common, content, metrics, relational, stories  # noqa: F401


def queries():
    return dict(common.QUERIES)


def oracle_sql():
    return dict(common.ORACLE)
