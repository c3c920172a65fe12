"""Registrable domains by public-suffix rules.

Rules are read from a landed list, one a line: plain (``co.uk``), wildcard (``*.ck``: every name below it is a suffix) and exception
(``!www.ck``: not a suffix after all). Of the rules that match a host an exception prevails, else the one with most labels; a
host that none matches has its last label as suffix. The registrable domain is the suffix and one label more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions.url import full_host_of


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``rules`` of a list that landed as text."""
    return rules(spark.read.text(path))


def rules(lines: DataFrame) -> DataFrame:
    """name, kind (plain, wildcard, exception), labels of each line (column ``value``); comments and blank lines go, a line ends at its first blank."""
    line = F.lower(F.regexp_extract(F.trim("value"), r"^\S+", 0))
    named = lines.select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("//"))
    kind = F.when(F.col("line").startswith("!"), F.lit("exception")).when(F.col("line").startswith("*."), F.lit("wildcard")).otherwise(F.lit("plain"))
    name = F.regexp_replace("line", r"^(?:!|\*\.|\.)", "")
    return named.select(name.alias("name"), kind.alias("kind"), F.size(F.split(name, r"\.")).alias("labels")).distinct()


def with_registrable(df: DataFrame, link: str, rules: DataFrame, suffix: str = "public_suffix", domain: str = "registrable") -> DataFrame:
    """``df`` with the public suffix and the registrable domain of the host in column ``link`` (a URL or a bare host).

    A host that is itself a suffix, or an address of numbers, has no registrable domain (null); nor has an empty one, whose suffix is null too.
    Hosts are taken once each and joined to the rules by name, for every ending they have; wildcards by the ending one label shorter.
    """
    hosts = df.select(full_host_of(link).alias("_host")).filter("_host <> ''").distinct()
    parted = hosts.withColumn("_labels", F.split("_host", r"\.")).withColumn("_n", F.size("_labels"))
    endings = parted.select("_host", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"), "_labels")
    endings = endings.select("_host", "_n", "_k", F.array_join(F.slice("_labels", F.col("_n") - F.col("_k") + 1, F.col("_k")), ".").alias("name"))
    # How many labels of the host a rule makes its suffix, and whether it is an exception.
    length = F.when(F.col("kind") == "exception", F.col("labels") - 1).when(F.col("kind") == "wildcard", F.col("labels") + 1).otherwise(F.col("labels"))
    matched = endings.join(rules, "name").withColumn("length", length).filter(F.col("length") <= F.col("_n"))
    best = matched.groupBy("_host").agg(F.max(F.struct((F.col("kind") == "exception").alias("exception"), "length")).alias("best"))
    sized = parted.join(best, "_host", "left").withColumn("_length", F.coalesce(F.col("best.length"), F.lit(1)))
    tail = lambda n: F.array_join(F.slice("_labels", F.col("_n") - n + 1, n), ".")
    numbers = F.col("_host").rlike(r"^[0-9.]+$")
    named = sized.select(
        "_host", F.when(~numbers, tail(F.col("_length"))).alias(suffix),
        F.when(~numbers & (F.col("_n") > F.col("_length")), tail(F.least(F.col("_length") + 1, F.col("_n")))).alias(domain),
    )
    return df.withColumn("_host", full_host_of(link)).join(named, "_host", "left").drop("_host")
