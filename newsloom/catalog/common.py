"""Registry of named queries and the role views that map the given tables onto mention data.

Every role exists twice: as a DataFrame function for the engine, and as SQL for the checker.
"""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.sources.tables import read_table

AS_OF = "2024-01-31 00:00:00"
AS_OF_ORDERS = "2001-08-01 00:00:00"
KEYWORDS = ("the", "with", "that", "and", "les", "und", "para")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = dedent(sql).strip()
        return fn

    return register


ROLE_SQL = {
    "brands": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS VARCHAR) AS profile_id, n_name AS name,
               n_nationkey % 7 <> 0 AS is_active,
               CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 168 END AS scrape_frequency_hours,
               1 + n_nationkey % 3 AS initial_lookback_days,
               CASE WHEN n_nationkey % 5 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-31' - to_hours(2 * n_nationkey) END AS last_scraped_at,
               n_nationkey % 3 = 1 AS scrape_in_progress,
               TIMESTAMP '2024-01-31' - to_minutes(20 * n_nationkey) AS scrape_started_at
        FROM nation""",
    "profiles": """
        SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, lower(r_name) || '@example.com' AS email,
               CASE WHEN r_regionkey % 2 = 0 THEN ' Press@' || r_name || '.example.com ' END AS contact_email
        FROM region""",
    "mentions": """
        SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS brand_id,
               CAST(left(o_orderpriority, 1) AS BIGINT) AS topic_id, o_orderpriority AS topic,
               CAST(ascii(o_orderstatus) AS BIGINT) AS platform_id, o_orderstatus AS platform,
               o_orderdate AS created_at, o_orderdate AS published_at,
               o_orderkey % 3 = 0 AS read_status, o_orderkey % 4 = 0 AS notified_status,
               'Order ' || o_orderkey AS caption, c_mktsegment AS content_teaser,
               'https://www.site' || (o_custkey % 50) || '.dk/orders/' || o_orderkey AS post_link
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "topics": """
        SELECT DISTINCT CAST(left(o_orderpriority, 1) AS BIGINT) AS id, o_orderpriority AS name FROM orders""",
    "platforms": """
        SELECT DISTINCT CAST(ascii(o_orderstatus) AS BIGINT) AS id, o_orderstatus AS name FROM orders""",
    "em": """
        SELECT event_id AS id, user_id % 25 AS brand_id, event_type AS topic,
               CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'p' || (user_id % 7) END AS platform,
               ts AS created_at, ts AS published_at, event_id % 3 = 0 AS read_status, event_id % 4 = 0 AS notified_status,
               event_type || ' #' || event_id AS caption,
               CASE WHEN event_id % 5 = 0 THEN upper(event_type || ' #' || event_id) ELSE 'user ' || user_id END AS content_teaser,
               'https://www.site' || (user_id % 7) || '.dk/' || event_type || '/' || event_id AS post_link
        FROM events""",
    "taxonomy_topics": """
        SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS id,
               CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 25 AS brand_id, p_brand AS name,
               CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 6 <> 0 AS is_active
        FROM part""",
    "keywords": "SELECT p_partkey AS id, p_name AS text FROM part",
    "topic_keywords": """
        SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS topic_id, p_partkey AS keyword_id FROM part""",
    "mention_keywords": """
        SELECT l_orderkey AS mention_id, l_partkey AS keyword_id,
               CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'N' THEN 'teaser' ELSE 'both' END AS matched_in,
               1 AS score
        FROM lineitem""",
    "raw": r"""
        SELECT doc_id AS mention_id, doc_id AS seq, CAST(1 AS BIGINT) AS brand_id,
               split_part(text, chr(10), 1) AS title, text AS content_teaser,
               'https://www.' || source || '.example.dk/' || lang || '/' || (doc_id - doc_id % 10 % 3) || '/' AS link,
               CASE WHEN doc_id % 13 = 0 THEN '' ELSE source END AS platform,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-28' + to_days(CAST(doc_id % 3 AS INTEGER)) END AS published_at,
               lang
        FROM documents""",
    "chats": """
        SELECT conv_id AS id, left(text, 30) AS title FROM conversations WHERE turn = 0""",
    "samples": """
        SELECT ts, event_type AS provider, 'd' || (user_id % 10) AS domain, user_id, event_id, value,
               event_type = 'error' AS failed
        FROM events""",
}


def sql_with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({dedent(ROLE_SQL[n])})" for n in names) + "\n"


class Roles:
    """DataFrame twins of ``ROLE_SQL`` over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, self.folder, name, list(columns) or None)

    def _select(self, source: DataFrame, *exprs: str) -> DataFrame:
        return source.selectExpr(*exprs)

    @property
    def brands(self) -> DataFrame:
        return self._select(
            self.table("nation"),
            "cast(n_nationkey as bigint) as id", "cast(n_regionkey as string) as profile_id", "n_name as name",
            "n_nationkey % 7 <> 0 as is_active",
            "case n_nationkey % 4 when 0 then 1 when 1 then 4 when 2 then 0 else 168 end as scrape_frequency_hours",
            "1 + n_nationkey % 3 as initial_lookback_days",
            f"case when n_nationkey % 5 = 0 then null else timestamp'{AS_OF}' - make_interval(0,0,0,0,2 * n_nationkey) end as last_scraped_at",
            "n_nationkey % 3 = 1 as scrape_in_progress",
            f"timestamp'{AS_OF}' - make_interval(0,0,0,0,0,20 * n_nationkey) as scrape_started_at",
        )

    @property
    def profiles(self) -> DataFrame:
        return self._select(
            self.table("region"),
            "cast(r_regionkey as string) as id", "r_name as name", "lower(r_name) || '@example.com' as email",
            "case when r_regionkey % 2 = 0 then ' Press@' || r_name || '.example.com ' end as contact_email",
        )

    @property
    def mentions(self) -> DataFrame:
        orders = self.table("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        customers = self.table("customer", "c_custkey", "c_nationkey", "c_mktsegment")
        return self._select(
            orders.join(customers, F.col("o_custkey") == F.col("c_custkey")),
            "o_orderkey as id", "cast(c_nationkey as bigint) as brand_id",
            "cast(left(o_orderpriority, 1) as bigint) as topic_id", "o_orderpriority as topic",
            "cast(ascii(o_orderstatus) as bigint) as platform_id", "o_orderstatus as platform",
            "o_orderdate as created_at", "o_orderdate as published_at",
            "o_orderkey % 3 = 0 as read_status", "o_orderkey % 4 = 0 as notified_status",
            "'Order ' || o_orderkey as caption", "c_mktsegment as content_teaser",
            "'https://www.site' || (o_custkey % 50) || '.dk/orders/' || o_orderkey as post_link",
        )

    @property
    def topics(self) -> DataFrame:
        named = self.table("orders", "o_orderpriority").distinct()
        return self._select(named, "cast(left(o_orderpriority, 1) as bigint) as id", "o_orderpriority as name")

    @property
    def platforms(self) -> DataFrame:
        named = self.table("orders", "o_orderstatus").distinct()
        return self._select(named, "cast(ascii(o_orderstatus) as bigint) as id", "o_orderstatus as name")

    @property
    def em(self) -> DataFrame:
        return self._select(
            self.table("events", "event_id", "user_id", "event_type", "ts"),
            "event_id as id", "user_id % 25 as brand_id", "event_type as topic",
            "case when user_id % 9 = 0 then null else 'p' || (user_id % 7) end as platform",
            "ts as created_at", "ts as published_at", "event_id % 3 = 0 as read_status",
            "event_id % 4 = 0 as notified_status", "event_type || ' #' || event_id as caption",
            "case when event_id % 5 = 0 then upper(event_type || ' #' || event_id) else 'user ' || user_id end as content_teaser",
            "'https://www.site' || (user_id % 7) || '.dk/' || event_type || '/' || event_id as post_link",
        )

    @property
    def taxonomy_topics(self) -> DataFrame:
        named = self.table("part", "p_brand").distinct()
        key = "cast(replace(p_brand, 'Brand#', '') as bigint)"
        return self._select(named, f"{key} as id", f"{key} % 25 as brand_id", "p_brand as name", f"{key} % 6 <> 0 as is_active")

    @property
    def keywords(self) -> DataFrame:
        return self._select(self.table("part", "p_partkey", "p_name"), "p_partkey as id", "p_name as text")

    @property
    def topic_keywords(self) -> DataFrame:
        return self._select(
            self.table("part", "p_partkey", "p_brand"),
            "cast(replace(p_brand, 'Brand#', '') as bigint) as topic_id", "p_partkey as keyword_id",
        )

    @property
    def mention_keywords(self) -> DataFrame:
        return self._select(
            self.table("lineitem", "l_orderkey", "l_partkey", "l_returnflag"),
            "l_orderkey as mention_id", "l_partkey as keyword_id",
            "case l_returnflag when 'A' then 'title' when 'N' then 'teaser' else 'both' end as matched_in", "1 as score",
        )

    @property
    def raw(self) -> DataFrame:
        """Documents as raw mentions: the whole first line is the title, the whole text the teaser."""
        return self._select(
            self.table("documents", "doc_id", "text", "source", "lang"),
            "doc_id as mention_id", "doc_id as seq", "cast(1 as bigint) as brand_id",
            "split_part(text, '\n', 1) as title", "text as content_teaser",
            "'https://www.' || source || '.example.dk/' || lang || '/' || (doc_id - doc_id % 10 % 3) || '/' as link",
            "case when doc_id % 13 = 0 then '' else source end as platform",
            "case when doc_id % 11 = 0 then null else timestamp'2024-01-28 00:00:00' + make_dt_interval(cast(doc_id % 3 as int)) end as published_at",
            "lang",
        )

    @property
    def messages(self) -> DataFrame:
        return self.table("conversations").withColumnRenamed("conv_id", "chat_id")

    @property
    def chats(self) -> DataFrame:
        return self._select(self.table("conversations").filter("turn = 0"), "conv_id as id", "left(text, 30) as title")

    @property
    def samples(self) -> DataFrame:
        return self._select(
            self.table("events", "event_id", "user_id", "event_type", "ts", "value"),
            "ts", "event_type as provider", "'d' || (user_id % 10) as domain", "user_id", "event_id", "value",
            "event_type = 'error' as failed",
        )
