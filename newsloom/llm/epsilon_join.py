"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors whose cosine is at least c are at most eps = sqrt(2 - 2c) apart. The vectors of a group are rotated to
their principal axes and sorted by their grid cells of width eps on the leading axes, so that neighbours in the
sequence are near in space. The sequence is cut into blocks of bounded size, and intervals of the sequence are joined
recursively: two intervals whose bounding boxes on the leading axes are more than eps apart are skipped with all that is in them, any
other two are split into their parts. Spark does so down to pairs of blocks, one join per level; a task goes on inside
a pair, and multiplies what is left in double precision.

Equal vectors are one point with a weight. A pair of blocks yields link counts per point and a spanning
forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsloom.llm.common import bounded_batches, query, table
from newsloom.llm.components import components
from newsloom.session import cut_lineage

#: Leading axes of the grid and of the bounding boxes.
AXES = 8
#: Bytes of vectors in a block.
BLOCK_BYTES = 1 << 18
#: Parts that an interval of the sequence is split into, level by level.
FAN = 16
#: Points of the smallest interval inside a block.
LEAF = 64
#: Allowance for rounding in distances.
SLACK = 1e-9

GROUP = ["label", "size"]


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: pa.Array, size: int) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _by_size(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch by the length of their vectors."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def principal_axes(points: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the leading principal axes of all points, from sums over all of them: size**2 numbers."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, rows in _by_size(batch.column(0)):
                units = np.hstack([_units(batch.column(0).take(pa.array(rows)), size), np.ones((len(rows), 1))])
                sums[size] = sums.get(size, 0) + units.T @ units
        columns = [pa.array(list(sums), pa.int32()), pa.array([s.reshape(-1) for s in sums.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["size", "sums"])

    rows = points.select("embedding").mapInArrow(moments, "size int, sums array<double>")
    summed = rows.select("size", F.posexplode("sums")).groupBy("size", "pos").agg(F.sum("col").alias("sum")).collect()
    flat: dict[int, np.ndarray] = {}
    for r in summed:
        flat.setdefault(r["size"], np.zeros((r["size"] + 1) ** 2))[r["pos"]] = r["sum"]
    axes = {}
    for size, sums in flat.items():
        square = sums.reshape(size + 1, size + 1)
        count = max(square[-1, -1], 1.0)
        mean = square[-1, :-1] / count
        _, vectors = np.linalg.eigh(square[:-1, :-1] / count - np.outer(mean, mean))
        axes[size] = vectors[:, ::-1][:, :AXES].copy()
    return axes


def _cells(k: int) -> list[str]:
    return [f"c{i}" for i in range(k)]


def placed(points: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """a, label, size, copies, unit and axis coordinates as bytes, and the grid cells on the leading axes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows in _by_size(batch.column(3)):
                part = batch.take(pa.array(rows))
                units = _units(part.column(3), size)
                leading = np.zeros((len(rows), AXES))
                leading[:, : axes[size].shape[1]] = units @ axes[size]
                cells = np.floor(leading / eps).astype(np.int32)
                columns = [part.column(0), part.column(1), pa.array(np.full(len(rows), size, np.int32)), part.column(2)]
                columns += [pa.array([row.tobytes() for row in x], pa.binary()) for x in (units, leading)]
                columns += [pa.array(np.ascontiguousarray(cells[:, i])) for i in range(AXES)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "label", "size", "copies", "unit", "leading", *_cells(AXES)])

    kind = dict(points.dtypes)["label"]
    schema = f"a bigint, label {kind}, size int, copies bigint, unit binary, leading binary, " + ", ".join(f"{c} int" for c in _cells(AXES))
    return points.select("a", "label", "copies", "embedding").mapInArrow(place, schema)


BOX = [f"{side}{i}" for side in ("low", "high") for i in range(AXES)]


def blocks_of(points: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs of the grid order: block, label, size, ids, copies, units, leading, and the box on the leading axes."""
    kind = dict(points.dtypes)["label"]
    names = f"block bigint, label {kind}, size int, ids array<bigint>, copies array<bigint>, units binary, leading binary, " + ", ".join(f"{b} double" for b in BOX)
    schema = to_arrow_schema(StructType.fromDDL(names))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, held, group = TaskContext.get().partitionId(), 0, [], None

        def block():
            leading = np.frombuffer(b"".join(h[3] for h in held)).reshape(-1, AXES)
            row = {
                "block": here << 32 | number, "label": group[0], "size": group[1], "ids": [h[0] for h in held], "copies": [h[1] for h in held],
                "units": b"".join(h[2] for h in held), "leading": leading.tobytes(),
            }
            return pa.RecordBatch.from_pylist([row | dict(zip(BOX, (*leading.min(0).tolist(), *leading.max(0).tolist())))], schema)

        for batch in batches:
            for a, label, size, copies, unit, leading in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if held and (group != (label, size) or len(held) * size * 8 >= block_bytes):
                    yield block()
                    number, held = number + 1, []
                group = (label, size)
                held.append((a, copies, unit, leading))
        if held:
            yield block()

    order = [*GROUP, *_cells(AXES), "a"]
    sorted_points = points.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_points.select("a", "label", "size", "copies", "unit", "leading").mapInArrow(cut, names)


def _apart(x: str, y: str) -> Column:
    """Squared distance of two boxes."""
    gaps = [F.greatest(F.col(f"{x}.low{i}") - F.col(f"{y}.high{i}"), F.col(f"{y}.low{i}") - F.col(f"{x}.high{i}"), F.lit(0.0)) for i in range(AXES)]
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return total


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """i, j: pairs of blocks of one group, i <= j, that are not provably more than eps apart."""
    sequence = Window.partitionBy(*GROUP).orderBy("block")
    level = cut_lineage(blocks.select("block", *GROUP, *BOX).withColumn("node", (F.row_number().over(sequence) - 1).cast("bigint")))
    boxes = [level]
    most = level.agg(F.max("node")).first()[0] or 0
    while most:
        most //= FAN
        grown = [(F.min if b.startswith("low") else F.max)(b).alias(b) for b in BOX]
        boxes.append(boxes[-1].groupBy(*GROUP, F.floor(F.col("node") / FAN).alias("node")).agg(*grown))
    pairs = boxes[-1].select(*GROUP, F.col("node").alias("x"), F.col("node").alias("y"))
    for boxed in boxes[-2::-1]:
        up = F.floor(F.col("node") / FAN)
        left, right = boxed.withColumn("x", up).alias("l"), boxed.withColumn("y", up).alias("r")
        found = pairs.join(left, [*GROUP, "x"]).join(right, [*GROUP, "y"])
        found = found.filter((F.col("l.node") <= F.col("r.node")) & (_apart("l", "r") <= eps * eps + SLACK))
        pairs = cut_lineage(found.select(*GROUP, F.col("l.node").alias("x"), F.col("r.node").alias("y")))
    names = level.select(*GROUP, "node", "block")
    return (
        pairs.join(names.select(*GROUP, F.col("node").alias("x"), F.col("block").alias("i")), [*GROUP, "x"])
        .join(names.select(*GROUP, F.col("node").alias("y"), F.col("block").alias("j")), [*GROUP, "y"])
        .select("i", "j")
    )


def _boxes(leading: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    part = leading[start:end]
    return part.min(0), part.max(0)


def join_intervals(x: tuple, y: tuple, same: bool, least: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places (in x, in y) of two sequences, each (units, leading); within one sequence each pair once."""
    stack = [(0, len(x[0]), 0, len(y[0]))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c >= b and a == d:
            continue
        (low, high), (low2, high2) = _boxes(x[1], a, b), _boxes(y[1], c, d)
        gap = np.maximum(np.maximum(low - high2, low2 - high), 0)
        if gap @ gap > eps * eps + SLACK:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            linked = x[0][a:b] @ y[0][c:d].T >= least
            if same:
                linked &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
            left, right = np.nonzero(linked)
            if len(left):
                yield left + a, right + c
            continue
        first = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        second = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        stack += [(*p, *q) for p in first for q in second if not same or p[0] < q[1]]


def _forest(size: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    above = list(range(size))
    for p, q in zip(left.tolist(), right.tolist()):
        while above[p] != p:
            above[p] = above[above[p]]
            p = above[p]
        while above[q] != q:
            above[q] = above[above[q]]
            q = above[q]
        if p != q:
            above[p] = q
            yield p, q


def links_of(blocks: DataFrame, pairs: DataFrame, least: float, eps: float) -> DataFrame:
    """Rows (a, links, b): a number of links of point a found in one pair of blocks, or (links 0) a link that connects a and b."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, size, *sides in zip(*(batch.column(k).to_pylist() for k in range(11))):
                ids, copies, parts = [], [], []
                for at in (0, 4):
                    ids.append(np.array(sides[at]))
                    copies.append(np.array(sides[at + 1]))
                    parts.append((np.frombuffer(sides[at + 2]).reshape(-1, size), np.frombuffer(sides[at + 3]).reshape(-1, AXES)))
                same, n = i == j, len(ids[0])
                counts = [np.zeros(len(x), np.int64) for x in ids]
                edges = set()
                for left, right in join_intervals(*parts, same, least, eps):
                    np.add.at(counts[0], left, copies[1][right])
                    np.add.at(counts[1], right, copies[0][left])
                    edges.update(_forest(n + len(ids[1]), left, right if same else right + n))
                every = ids[0] if same else np.concatenate(ids)
                total = counts[0] + counts[1] if same else np.concatenate(counts)
                some = np.flatnonzero(total)
                joined = list(_forest(len(every), *np.array(sorted(edges), np.int64).reshape(-1, 2).T))
                columns = [
                    np.concatenate([every[some], every[[e[0] for e in joined]]]) if joined else every[some],
                    np.concatenate([total[some], np.zeros(len(joined), np.int64)]),
                    pa.array([None] * len(some) + [int(every[e[1]]) for e in joined], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), columns[2]], ["a", "links", "b"])

    parts = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("ids", "copies", "units", "leading")]
    left = blocks.select(F.col("block").alias("i"), "size", *parts("i"))
    right = blocks.select(F.col("block").alias("j"), *parts("j"))
    rows = pairs.join(left, "i").join(right, "j").select(
        "i", "j", "size", *[f"{c}_{s}" for s in "ij" for c in ("ids", "copies", "units", "leading")]
    )
    return rows.mapInArrow(search, "a bigint, links bigint, b bigint")


def near_embeddings(vectors: DataFrame, least: float = 0.93, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label; other columns are ignored): vec_id, n_links, component_id, kept.

    Vectors of one label (not null) and one length link when their cosine, in double precision, is at least ``least``
    (over 0). A vector that is null, empty or zero or has a null or non-finite component links with nothing, nor does a row
    with a null vec_id (its component is null, and it is not kept). Equal vectors link with each other. Rows that repeat a vec_id count
    one each in others' n_links; with different vectors their own links add up. An empty table gives no rows.
    """
    eps = float(np.sqrt(2 - 2 * least))
    rows = bounded_batches(vectors).select("vec_id", "embedding", "label")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    points = cut_lineage(rows.filter(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("a"), F.count("*").alias("copies")))
    axes = principal_axes(points)
    blocks = cut_lineage(blocks_of(placed(points, axes, eps), block_bytes))
    found = cut_lineage(links_of(blocks, near_blocks(blocks, eps), least, eps))
    nodes = components(found.filter("b IS NOT NULL").select("a", "b"))
    linked = found.filter("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    known = points.join(linked, "a", "left").join(nodes.withColumnRenamed("node", "a"), "a", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "a").alias("component_id")
    )
    out = lambda df: df.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    rest = rows.filter(~fit).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out(rows.filter(fit).join(known, ["label", "embedding"])).unionByName(out(rest))


@query(
    "op2_near_embeddings",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
    r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
)
def op2_near_embeddings(spark, folder):
    return near_embeddings(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))
