"""Exact dedup by composable polynomial fingerprints, with a chunkwise comparison of what they group.

A text is its UTF-8 bytes, cut into chunks. Each chunk has a polynomial hash, and two neighbouring
pieces combine to the hash of their concatenation by shifting the left one by the length of the right
one (``joined``). The combination is associative, so the chunks of a huge document hash in parallel and
in any grouping. Rows with one fingerprint are then compared chunk by chunk: of every (fingerprint, chunk
number) Spark keeps the distinct chunks, which collapse before the shuffle and never hold two whole texts
side by side. A fingerprint with two different chunks anywhere is a collision and is split by SHA-256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import bounded_batches, query, release, table
from newsloom.session import cut_lineage

#: Bytes hashed at a time. A chunk's products add up to less than 2**53, so the sums in doubles are exact.
CHUNK_BYTES = 4096
#: (modulus, base) of the two hashes.
MODULI = ((2147483629, 1181783497), (2147483587, 1500450271))
#: Bytes compared at a time.
COMPARED_BYTES = 65536

PRINT = "struct<size: bigint, first: bigint, second: bigint>"


def joined(left: tuple, right: tuple, moduli=MODULI) -> tuple:
    """Fingerprint of two pieces in a row; each is (size, hash, hash)."""
    return (left[0] + right[0], *((a * pow(base, right[0], p) + b) % p for a, b, (p, base) in zip(left[1:], right[1:], moduli)))


def _powers(moduli) -> np.ndarray:
    powers = np.ones((CHUNK_BYTES, len(moduli)))
    for k, (p, base) in enumerate(moduli):
        power = 1
        for i in range(CHUNK_BYTES - 1, -1, -1):
            powers[i, k] = power
            power = power * base % p
    return powers


def fingerprint_of(data: np.ndarray, powers: np.ndarray, moduli=MODULI) -> tuple:
    """(size, hash, hash) of an array of bytes: all full chunks at once, then joined left to right."""
    full = len(data) // CHUNK_BYTES
    whole = data[: full * CHUNK_BYTES].reshape(full, CHUNK_BYTES)
    result = (0, *[0] * len(moduli))
    for start in range(0, full, 256):
        for sums in (whole[start : start + 256] + 1.0) @ powers:
            result = joined(result, (CHUNK_BYTES, *(int(s) % p for s, (p, _) in zip(sums, moduli))), moduli)
    rest = data[full * CHUNK_BYTES :]
    if len(rest):
        sums = (rest + 1.0) @ powers[CHUNK_BYTES - len(rest) :]
        result = joined(result, (len(rest), *(int(s) % p for s, (p, _) in zip(sums, moduli))), moduli)
    return result


def fingerprint(text: Column, moduli=MODULI) -> Column:
    """Column of (size in bytes, two hashes); a null text counts as empty."""

    @F.arrow_udf(PRINT)
    def prints(texts: pa.Array) -> pa.Array:
        powers = _powers(moduli)
        rows = []
        for value in texts.cast(pa.binary()):
            data = value.as_buffer()
            rows.append(fingerprint_of(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), powers, moduli))
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        release()
        return pa.StructArray.from_arrays(columns, ["size", "first", "second"])

    return prints(text)


KEY = ["size", "first", "second"]


def collisions(docs: DataFrame, repeated: DataFrame, moduli=MODULI, compared_bytes: int = COMPARED_BYTES) -> DataFrame:
    """Of the ``repeated`` fingerprints those whose texts differ in some chunk."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.withColumn("print", fingerprint(F.col("text"), moduli)).select("text", "print.*")
    data = F.col("text").cast("binary")
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / compared_bytes).cast("int"))
    chunks = (
        rows.join(repeated, KEY, "left_semi")
        .select(*KEY, data.alias("data"), F.explode(numbers).alias("number"))
        .select(*KEY, "number", F.substr("data", F.col("number") * compared_bytes + 1, F.lit(compared_bytes)).alias("chunk"))
    )
    return chunks.distinct().groupBy(*KEY, "number").count().filter("count > 1").select(*KEY).distinct()


def exact_dedup(docs: DataFrame, moduli=MODULI, compared_bytes: int = COMPARED_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when their bytes are; null
    counts as empty. The largest doc_id of a group stays; a null id is smaller than any other, and stays
    only if all ids of its group are null. Rows that repeat a doc_id within a group count one each in
    group_size and are kept or dropped together. An empty table gives no rows.
    """
    texts = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = cut_lineage(
        texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), fingerprint(F.col("text"), moduli).alias("print"))
        .select("doc_id", "text_sha256", "print.*")
    )
    repeated = prints.groupBy(*KEY).count().filter("count > 1").select(*KEY)
    collided = cut_lineage(collisions(docs, repeated, moduli, compared_bytes))
    split = prints.join(collided.withColumn("collided", F.lit(True)), KEY, "left").withColumn(
        "part", F.when(F.col("collided"), F.col("text_sha256")).otherwise("")
    )
    groups = split.groupBy(*KEY, "part").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return split.join(groups, [*KEY, "part"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


@query(
    "op1_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op1_exact_dedup(spark, folder):
    return exact_dedup(table(spark, folder, "documents", "doc_id", "text"))
