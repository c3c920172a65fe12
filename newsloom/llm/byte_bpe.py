"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece of text is a row of byte positions. Leaf i of its tree holds the rank of the pair that begins at
position i, and every node the least (rank, position) below it, so the root names the leftmost pair of
least rank. A merge joins two live neighbours and changes three leaves: the pair that begins here, the one
that ended here, and the one that is gone; each change walks up the tree, a logarithm of the length.
Short pieces of about one length are merged together, one row each, by numpy; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import functools
import itertools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import bounded_batches, query, release, table
from newsloom.llm.units import RunCoder, steps

NONE = np.int64(1) << 62
#: Byte positions of one numpy step.
POSITIONS = 1 << 19
#: Runs a worker remembers in each of its two generations.
REMEMBERED = 60_000
#: Bytes of the longest piece that shares a numpy step.
SHORT = 128


@functools.cache
def later_characters() -> dict[int, str]:
    """Letters and digits that the pattern library knows and the tokenizer library, with older tables, takes for symbols.

    A piece of two characters shows a class: it is one token of a vocabulary made for the question.
    """
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    found = {}
    for kind, before in (("L", "a"), ("N", "1")):
        doubtful = [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c) == "Cn"]
        ranks = {bytes([b]): b for b in range(256)} | {(before + c).encode(): 256 + i for i, c in enumerate(doubtful)}
        asked = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        found |= {ord(c): "$" for c in doubtful if len(asked.encode_ordinary(before + c)) > 1}
    return found


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.later = later_characters()
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

        self.pair = dict(zip(self.pairs.tolist(), self.merged.tolist()))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.merged[at], NONE) if len(self.pairs) else np.full(len(left), NONE)

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, a power of two, as little-endian 32-bit integers."""
        rows, bits = len(pieces), width.bit_length() - 1
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        # Column ``width`` stands for "no neighbour" on either side.
        token = np.zeros((rows, width + 1), np.int64)
        token[:, :width] = self.single[data]
        place = np.arange(width + 1)
        after = np.where(place[None, :] + 1 < sizes[:, None], place[None, :] + 1, width)
        before = np.broadcast_to(np.where(place > 0, place - 1, width), (rows, width + 1)).copy()
        live = place[None, :width] < sizes[:, None]
        value = lambda rank, at: np.where(rank < NONE, rank << bits | at, NONE)
        tree = np.full((rows, 2 * width), NONE)
        r, i = np.nonzero(after[:, :width] < width)
        tree[r, width + i] = value(self._rank(token[r, i], token[r, i + 1]), i)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        r = np.nonzero(tree[:, 1] < NONE)[0]
        while len(r):
            top = tree[r, 1]
            i = top & (width - 1)
            j = after[r, i]
            k, h = after[r, j], before[r, i]
            token[r, i] = top >> bits
            after[r, i] = k
            before[r, k] = i
            live[r, j] = False
            tree[r, width + j] = NONE
            tree[r, width + i] = np.where(k < width, value(self._rank(token[r, i], token[r, k]), i), NONE)
            left = h < width
            tree[r[left], width + h[left]] = value(self._rank(token[r[left], h[left]], token[r[left], i[left]]), h[left])
            nodes = [width + j, width + i, width + np.where(left, h, i)]
            for _ in range(bits):
                nodes = [n >> 1 for n in nodes]
                for n in nodes:
                    tree[r, n] = np.minimum(tree[r, 2 * n], tree[r, 2 * n + 1])
            r = r[tree[r, 1] < NONE]
        ids = token[:, :width][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length; the tree and the neighbours are lists."""
        size = len(piece)
        width = 1 << (size - 1).bit_length()
        bits, none, pair = width.bit_length() - 1, int(NONE), self.pair
        token = [self.ranks[piece[i : i + 1]] for i in range(size)]
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))

        def leaf(i: int) -> int:
            if i < 0 or after[i] >= size:
                return none
            rank = pair.get(token[i] << 32 | token[after[i]])
            return none if rank is None else rank << bits | i

        tree = [none] * width + [leaf(i) for i in range(size)] + [none] * (width - size)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            i = tree[1] & (width - 1)
            token[i], j = tree[1] >> bits, after[i]
            k = after[i] = after[j]
            if k < size:
                before[k] = i
            token[j] = -1
            tree[width + j] = none
            for at in (j, i, before[i]):
                if at < 0:
                    continue
                node = width + at
                if at != j:
                    tree[node] = leaf(at)
                while node > 1:
                    node >>= 1
                    least = min(tree[2 * node], tree[2 * node + 1])
                    tree[node] = least
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; a piece that is a token is that token."""
        result: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                result[at] = rank.to_bytes(4, "little")
            elif len(piece) > SHORT:
                result[at] = self._merge_long(piece)
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(at)
        for width, places in by_width.items():
            step = max(1, POSITIONS // width)
            for start in range(0, len(places), step):
                some = places[start : start + step]
                for at, ids in zip(some, self._merge([pieces[p] for p in some], width)):
                    result[at] = ids
        return result

    def split(self, run: str) -> list[str]:
        """Matches of the pattern, with symbols in place of ``later_characters``."""
        pieces = self.find(run.translate(self.later))
        ends = itertools.accumulate(map(len, pieces))
        return [run[end - len(piece) : end] for piece, end in zip(pieces, ends)]

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        split = list(map(self.find if self.later.keys().isdisjoint(map(ord, set("".join(runs)))) else self.split, runs))
        distinct = list(set().union(*split))
        coded = dict(zip(distinct, self.encode_pieces([d.encode() for d in distinct])))
        return [b"".join(map(coded.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def coder(path: str, pattern: str) -> tuple[ByteBpe, RunCoder]:
    """The coder of a rank file (base64 token and rank per line), read once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    bpe = ByteBpe(ranks, pattern)
    return bpe, RunCoder(bpe.encode_runs, REMEMBERED)


def encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit; left out unless ``keep_ids``), ids_sha256 and
    decoded_sha256 of the bytes decoded from the ids. A null or empty text has no ids. Special tokens are ordinary
    text. Rows that repeat count one each. ``path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, runs = coder(path, pattern)
        for batch in batches:
            for start, texts in steps(batch.column(1)):
                ids = runs.encode(texts)
                columns = {
                    "doc_id": batch.column(0).slice(start, len(texts)),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]),
                }
                if not keep_ids:
                    del columns["ids"]
                yield pa.RecordBatch.from_pydict(columns)
        runs.forget()
        release()

    ids = "ids binary, " if keep_ids else ""
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id bigint, n_tokens bigint, {ids}ids_sha256 string, decoded_sha256 string")


@query("op7_byte_bpe")
def op7_byte_bpe(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_ids=False)
