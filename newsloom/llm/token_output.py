"""Token ids as packed files.

A shard is a byte string: a header, the documents' ids and first tokens, an offset per block, and the
token ids, each in the fewest bits that hold the vocabulary. Blocks of ``BLOCK`` ids start on byte boundaries, so any
block, and any document, is read without the rest of the shard, and numpy unpacks it whole.

Documents are range-partitioned by doc_id before they are encoded, so a shard holds a run of neighbouring
ids and the shards in order hold all documents in order. Spark writes the shards as rows of a Parquet table:
that works on any store Spark writes to, and a lost task is written again whole.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from newsloom.llm.common import bounded_batches, query, release, table
from newsloom.llm.pieces import PieceCoder
from newsloom.session import shared_folder

MAGIC = b"PACKIDS1"
#: Ids in a block.
BLOCK = 4096
#: Ids in a shard, unless one document has more.
SHARD_IDS = 1 << 20
#: Bytes of batches that are encoded together.
JOINED_BYTES = 6 << 20
_NO_ID = -(2**63)


def packed(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits of every id, most significant first, padded to whole bytes."""
    spread = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(spread.reshape(-1)).tobytes()


def unpacked(data: bytes, count: int, bits: int) -> np.ndarray:
    spread = np.zeros((count, 32), np.uint8)
    spread[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return np.packbits(spread, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def write_shard(doc_ids: list, ids: list[np.ndarray], bits: int) -> bytes:
    """A shard of documents (a null doc_id is allowed) and their token ids."""
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
    ends = np.cumsum([0, *map(len, ids)]).astype("<i8")
    blocks = [packed(flat[a : a + BLOCK], bits) for a in range(0, len(flat), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<i8")
    head = np.array([bits, BLOCK, len(doc_ids), len(flat), len(blocks)], "<i8").tobytes()
    names = np.array([_NO_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    return b"".join([MAGIC, head, names, ends.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reads a shard; documents are fetched by place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.bits, self.block, self.docs, self.count, blocks = np.frombuffer(data, "<i8", 5, 8).tolist()
        at = 48
        self.doc_ids = [None if d == _NO_ID else d for d in np.frombuffer(data, "<i8", self.docs, at).tolist()]
        self.ends = np.frombuffer(data, "<i8", self.docs + 1, at := at + 8 * self.docs)
        self.offsets = np.frombuffer(data, "<i8", blocks + 1, at := at + 8 * (self.docs + 1))
        self.body = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Token ids from ``start`` to before ``end``; only the blocks that hold them are unpacked."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [
            unpacked(self.body[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.count - b * self.block), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.ends[place]), int(self.ends[place + 1]))


@functools.lru_cache(2)
def _coder(path: str) -> tuple[Callable[[pa.Array | list[str]], list[bytes]], int]:
    """Encodes texts to ids as bytes, as the library does; and the bits of an id."""
    tokenizer = Tokenizer.from_file(path)
    coder = PieceCoder(tokenizer)

    def encode(texts: pa.Array | list[str]) -> list[bytes]:
        return coder.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))

    return encode, max(1, (tokenizer.get_vocab_size() - 1).bit_length())


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one of about ``JOINED_BYTES``: the more text at a time, the fewer runs are looked up again."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= JOINED_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


SHARDS = "sequence bigint, n_ids bigint, shard binary"


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> None:
    """Write the token ids of ``docs`` (doc_id, text; other columns are ignored) to ``folder`` as shards.

    Documents are in ascending order of doc_id, nulls first, equal ids by text; ``end_id`` follows each. A null
    text counts as empty, so it has the end id only. The tokenizer's own special tokens in a text are those tokens, as the library has it. An empty table writes no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bits = _coder(path)
        end, number, names, held, count = np.array([end_id], np.uint32), 0, [], [], 0
        here = TaskContext.get().partitionId()

        def shard():
            columns = [pa.array([here << 32 | number], pa.int64()), pa.array([count], pa.int64()), pa.array([write_shard(names, held, bits)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["sequence", "n_ids", "shard"])

        for batch in joined(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = np.concatenate([np.frombuffer(ids, "<u4"), end])
                if names and count + len(ids) > SHARD_IDS:
                    yield shard()
                    number, names, held, count = number + 1, [], [], 0
                names.append(doc_id)
                held.append(ids)
                count += len(ids)
        if names:
            yield shard()
        release()

    ordered = bounded_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the shards in ``folder``: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sequence, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_buffer().to_pybytes())
                # Shards of many small documents are read in one go; the ends cut them apart.
                flat = shard.ids(0, shard.count).astype("<u4").data.cast("B")
                ends = (shard.ends * 4).tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.doc_ids, pa.int64()),
                    "sequence": pa.array([sequence] * shard.docs, pa.int64()),
                    "offset": pa.array(shard.ends[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(shard.ends), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.int64()),
                })

    shards = spark.read.schema(SHARDS).parquet(folder)
    before = lambda *keys: Window.partitionBy(*keys).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    counts = shards.select("sequence", "n_ids", (F.col("sequence").bitwiseAND(F.lit(~0 << 32))).alias("task"))
    # A running sum over a task's shards, then over the tasks, of which there are as many as partitions.
    tasks = counts.groupBy("task").agg(F.sum("n_ids").alias("n_ids")).select(
        "task", F.coalesce(F.sum("n_ids").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")
    )
    starts = counts.withColumn("inside", F.coalesce(F.sum("n_ids").over(before("task")), F.lit(0))).join(tasks, "task").select(
        "sequence", (F.col("inside") + F.col("earlier")).alias("first")
    )
    docs = shards.select("sequence", "shard").mapInArrow(run, "doc_id bigint, sequence bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, "sequence").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


@query("op9_token_output")
def op9_token_output(spark, folder):
    out = shared_folder(spark)
    write_ids(table(spark, folder, "documents", "doc_id", "text"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, out)
