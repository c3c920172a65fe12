"""Hard negatives by Strassen multiplication of anchor and candidate tiles.

Scores are inner products of whole numbers. Anchors and candidates are dealt into cells (a part of the anchors, a part of the
candidates); a task holds the anchors of its cell, lets the candidates pass in tiles, and multiplies tiles by
Strassen's recursion over int64, padded with zeros to even sides. Additions and multiplications of int64 are exact modulo 2**64,
so every score that fits into int64 is exact.

Best rows are kept in bounded heaps, sorted arrays of at most k (score, id) per anchor that merge with those of other tiles and
cells. A first pass makes the heaps of positives from candidates of the anchors' labels. Every positive's score then opens a window of
scores, and a second pass makes one heap per window from candidates of other labels. A cell emits its heaps once, so what is
shuffled grows with anchors and cells, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import bounded_batches, finite, query, table
from newsloom.operators.ordered import top_per_key
from newsloom.session import cut_lineage

#: Rows of a tile, of anchors as of candidates.
TILE = 1024
#: Below this side the recursion multiplies directly.
LEAF = 32
#: Bytes of anchors in a cell.
ANCHOR_BYTES = 1 << 24
#: Candidates in a cell, unless that would make more parts of them than Spark makes of a shuffle.
CELL_ROWS = 4096
ORDER = ["size", "tile", "part", "candidate", "label", "vec_id", "key"]
LOWEST = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, exact modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j], out[:i, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :j], out[i:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """For each of n rows the best ``k`` (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids, self.filled = np.full((n, k), LOWEST), np.full((n, k), LAST), np.zeros((n, k), bool)

    def merge(self, rows: slice, scores: np.ndarray, ids: np.ndarray, filled: np.ndarray) -> None:
        scores, ids, filled = (np.concatenate(x, 1) for x in ((self.scores[rows], scores), (self.ids[rows], ids), (self.filled[rows], filled)))
        best = np.lexsort((ids, -1 - scores, ~filled), axis=1)[:, : self.k]
        at = np.arange(len(best))[:, None]
        self.scores[rows], self.ids[rows], self.filled[rows] = scores[at, best], ids[at, best], filled[at, best]

    def push(self, rows: slice, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Offers a tile of scores, a column for each of ``ids`` (ascending)."""
        # Only what would enter a full heap is looked at; equal scores may have the smaller id.
        allowed = allowed & (scores >= np.where(self.filled[rows].all(1), self.scores[rows][:, -1], LOWEST)[:, None])
        some = np.flatnonzero(allowed.any(0))
        if not len(some):
            return
        scores, ids, allowed = scores[:, some], ids[some], allowed[:, some]
        k = min(self.k, len(some))
        shown = np.where(allowed, scores, LOWEST)
        least = np.partition(shown, len(some) - k, axis=1)[:, [len(some) - k]]
        over = allowed & (shown > least)
        level = allowed & (shown == least)
        taken = over | (level & (np.cumsum(level, axis=1) <= k - over.sum(1, keepdims=True)))
        at, column = np.nonzero(taken)
        slot = np.arange(len(at)) - np.searchsorted(at, at)
        best, named, filled = np.full((len(scores), k), LOWEST), np.full((len(scores), k), LAST), np.zeros((len(scores), k), bool)
        best[at, slot], named[at, slot], filled[at, slot] = scores[at, column], ids[column], True
        self.merge(rows, best, named, filled)


def prepared(vectors: DataFrame, scale: float) -> DataFrame:
    """key, vec_id, label, size and x (whole numbers) of the rows that take part. A key names a row."""
    # An entry beyond long becomes the nearest long.
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(F.lit(scale) * c.cast("double"), F.lit(9e18)), F.lit(-9e18))))
    rows = vectors.select("vec_id", "embedding", "label").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    rows = rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", F.size("embedding").alias("size"), whole.alias("x"))
    return cut_lineage(bounded_batches(rows))


def no_bounds() -> Column:
    return F.lit(None).cast("array<bigint>")


def cells(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows dealt to cells (size, tile, part): of each the anchors first, then the candidates, by label and id.

    ``anchors`` are rows of ``points`` with ``bounds``: low and high of each of their windows.
    """
    asked = anchors.agg(F.sum(F.col("size").cast("bigint") * 8)).first()[0] or 0
    tiles = 1 + asked // ANCHOR_BYTES
    parts = max(1, min(-(-points.count() // CELL_ROWS), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    copied = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"candidate": F.lit(False), "tile": dealt(tiles)}).withColumn("part", copied(parts))
    right = points.withColumns({"bounds": no_bounds(), "candidate": F.lit(True), "part": dealt(parts)}).withColumn("tile", copied(tiles))
    rows = left.select(*ORDER, "bounds", "x").unionByName(right.select(*ORDER, "bounds", "x"))
    return rows.repartition("size", "tile", "part").sortWithinPartitions(*ORDER)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, bool, pa.Table]]:
    """(cell, candidates or not, rows) of runs of rows: all anchors of a cell, or at most ``most`` candidates."""
    held, now, count = [], None, 0
    for batch in batches:
        keys = np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in ORDER[:4]])
        start = 0
        for end in (*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)):
            while start < end:
                key = tuple(keys[start].tolist())
                if held and (key != now or key[3] and count >= most):
                    yield now[:3], bool(now[3]), pa.Table.from_batches(held)
                    held, count = [], 0
                now, step = key, min(end - start, most - count) if key[3] else end - start
                held.append(batch.slice(start, step))
                count, start = count + step, start + step
    if held:
        yield now[:3], bool(now[3]), pa.Table.from_batches(held)


class _Rows:
    """Rows of one side of a cell as arrays, in the order they came in or by id."""

    def __init__(self, rows: pa.Table, by_id: bool = False):
        if by_id:
            rows = rows.take(pa.array(np.argsort(np.asarray(rows.column("vec_id")), kind="stable")))
        self.ids, self.keys = np.asarray(rows.column("vec_id")), np.asarray(rows.column("key"))
        self.labels, self.bounds = rows.column("label").to_pylist(), rows.column("bounds")
        self.x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(len(rows), -1 if rows.column("size")[0].as_py() else 0)


def heaps_of(points: DataFrame, anchors: DataFrame, same: bool, k: int, width: int) -> DataFrame:
    """key, anchor_id, window, score, vec_id: of every cell the best ``k`` candidates of each anchor in each window.

    ``same``: candidates are the other rows of the anchor's label, whatever their score; else rows of other labels whose
    scores lie in one of up to ``width`` windows.
    """

    def emitted(anchors: _Rows | None, heaps: list[Heaps]) -> Iterator[pa.RecordBatch]:
        for window, heap in enumerate(heaps):
            at, slot = np.nonzero(heap.filled)
            columns = [anchors.keys[at], anchors.ids[at], np.full(len(at), window, np.int32), heap.scores[at, slot], heap.ids[at, slot]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "anchor_id", "window", "score", "vec_id"])

    def offer(anchors: _Rows, found: _Rows, heaps: list[Heaps], lows: np.ndarray, highs: np.ndarray) -> None:
        place: dict = {}
        labels = np.array([place.setdefault(label, len(place)) for label in found.labels])
        own = np.array([place.get(label, -1) for label in anchors.labels])
        # Both sides came in by label, so the anchors that share a label with this tile stand together.
        wanted = np.flatnonzero(own >= 0) if same else np.arange(len(own))
        for start in range(wanted[0], wanted[-1] + 1, TILE) if len(wanted) else ():
            rows = slice(start, min(start + TILE, wanted[-1] + 1))
            equal = own[rows, None] == labels
            if not same and equal.all():
                continue
            scores = strassen(anchors.x[rows], found.x.T)
            for window, heap in enumerate(heaps):
                allowed = equal & (anchors.keys[rows, None] != found.keys) if same else ~equal & (scores >= lows[rows, [window]]) & (scores <= highs[rows, [window]])
                heap.push(rows, scores, found.ids, allowed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, cell, heaps = None, None, []
        for here, candidates, rows in _runs(batches, TILE):
            if not candidates:
                yield from emitted(anchors, heaps)
                anchors, cell = _Rows(rows), here
                heaps = [Heaps(len(rows), k) for _ in range(width)]
                # Windows that are not there are empty.
                lows, highs = np.ones((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
                for i, bounds in enumerate(anchors.bounds.to_pylist()):
                    for window in range(len(bounds or []) // 2):
                        lows[i, window], highs[i, window] = bounds[2 * window : 2 * window + 2]
            elif here == cell:
                offer(anchors, _Rows(rows, by_id=True), heaps, lows, highs)
        yield from emitted(anchors, heaps)

    return cells(points, anchors).mapInArrow(search, "key bigint, anchor_id bigint, window int, score bigint, vec_id bigint")


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: float = 256.0
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows of ``vectors`` (vec_id, embedding, label).

    Every component becomes floor(scale * x). The positives of a row for which ``anchor`` (a condition on vec_id) holds are the
    best ``positives`` other rows of its label; of each, the best ``negatives`` rows of other labels are returned whose score is at most
    the positive's and at least ``least_percent`` of it, ranked from 1. Higher scores are better, then smaller vec_ids.

    A row with a null vec_id or label, or a vector that is null or has a null or non-finite component, takes no part. Only vectors of
    one length are compared; without components every score is 0. Rows that repeat a vec_id are rows of their own: each is an
    anchor, and a positive or negative, as often as it is there. Scores are exact while they fit into a long and wrap beyond.
    Other columns are ignored. An anchor without positives, or a positive without negatives, gives no row, nor does an empty table.
    """
    points = prepared(vectors, scale)
    anchors = points.filter(anchor)
    best = [F.col("score").desc(), "vec_id"]
    found = heaps_of(points, anchors.withColumn("bounds", no_bounds()), True, positives, 1)
    chosen = cut_lineage(top_per_key(found, ["key"], best, positives, "window").select(
        "key", (F.col("window") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    # The least whole number that is no less than the given percentage.
    low = F.ceil(F.col("positive_score").cast("decimal(20,0)") * least_percent / 100).cast("bigint")
    windows = chosen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("window", low.alias("low"), F.col("positive_score").alias("high")))).alias("bounds"))
    windows = windows.select("key", F.flatten(F.transform("bounds", lambda b: F.array(b["low"], b["high"]))).alias("bounds"))
    other = heaps_of(points, anchors.join(windows, "key"), False, negatives, positives)
    ranked = top_per_key(other, ["key", "window"], best, negatives, "rank")
    return ranked.join(chosen, ["key", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


@query(
    "op12_hard_negatives",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    p AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(e, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM v),
    s AS (SELECT a.k, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
          FROM p a JOIN p b ON a.vec_id % 100 = 0 AND a.k <> b.k AND len(a.x) = len(b.x)),
    q AS (SELECT k, vec_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS place FROM s WHERE same
          QUALIFY place <= 5),
    n AS (SELECT anchor_id, q.vec_id AS positive_id, s.vec_id AS negative_id, q.score AS positive_score, s.score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY q.k, q.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
          FROM q JOIN s ON s.k = q.k AND NOT s.same AND 80 * q.score <= 100 * s.score AND s.score <= q.score)
    SELECT * FROM n WHERE rank <= 5""",
)
def op12_hard_negatives(spark, folder):
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
