"""The corpus pipeline: documents in, tokenised training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.llm import byte_bpe, exact_dedup, language_id, mixing, ngram_join
from newsloom.llm.common import unused_name
from newsloom.session import cut_lineage

#: Language identification and the join have no SQL form.
ORACLE_SQL = None
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; null texts and texts without letters go."""
    name = unused_name(docs, "language")
    found = docs.withColumn(name, language_id.predicted(F.col("text"), language_id.fit(docs)))
    return found.filter(~F.col(name)["rejected"]).drop(name)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``kept``, a null id like any other."""
    name = unused_name(docs, "kept")
    ids = kept.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the one with the largest doc_id."""
    return _only(docs, exact_dedup.exact_dedup(docs).filter("kept"))


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of documents connected by similar shingle sets the one with the smallest doc_id."""
    found = ngram_join.jaccard_components(docs)
    return _only(docs, found.filter("doc_id <=> component_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources reach their target weights."""
    copies, name = unused_name(docs, "copies"), unused_name(docs, "id")
    taken = mixing.mix(docs).filter("copies > 0").groupBy(F.col("doc_id").alias(name)).agg(F.max("copies").cast("int").alias(copies))
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(name))).drop(name)
    number = unused_name(docs, "number")
    return joined.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(number, copies)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every document left, a row per copy."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", identified),
    ("exact_dedup", unrepeated),
    ("ngram_join", dissimilar),
    ("mix_sources", mixed),
    ("byte_bpe", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
