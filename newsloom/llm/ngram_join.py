"""Jaccard join of documents on word n-grams by T-occurrence search with DivideSkip.

Two documents of sizes m <= n that link share at least ceil(3n/4) shingles, so a document that holds fewer
shingles that others hold as well links with nothing. That test comes first, twice: on the first part of every document's
shingles in hash order, where a link must show a certain number of common ones, and then, for what is left, on whole sets.

What remains is searched. An inverted list is a shingle's documents. With the lists of a document ordered
by length, the T - 1 longest are left aside: a partner has to be in one of the others, the short ones.
Documents are clustered by the short lists they share, clusters are cut into blocks of bounded size, and each pair of
blocks is one search: a document's short lists are merged with a heap, and only for what the merge finds its long
lists are probed by binary search, until the required overlap is reached or cannot be. A found link joins
two local components, and members of one component are not compared again, so a group of
near copies costs little more than its size and yields a spanning forest of its links.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.llm.common import bounded_batches, query, release, table
from newsloom.llm.components import components
from newsloom.operators.ordered import running_totals
from newsloom.session import cut_lineage

SHINGLE_WORDS = 5
SEGMENT_BYTES = 1 << 18

_random = np.random.default_rng(20241)
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_UP, _DOWN = _powers(_BASE, SEGMENT_BYTES), _powers(_INVERSE, SEGMENT_BYTES)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every word; a word's bytes count by their place in the word."""
    up, down = (_UP, _DOWN) if len(data) <= SEGMENT_BYTES else (_powers(_BASE, len(data)), _powers(_INVERSE, len(data)))
    edges = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) <= SEGMENT_BYTES:
        return _word_hashes(data)
    parts, start = [], 0
    while start < len(data):
        end = start + SEGMENT_BYTES
        while end < len(data) and not _SPACE[data[end]]:  # never inside a word
            step = data[end : end + 4096]
            found = np.flatnonzero(_SPACE[step])
            end += int(found[0]) if len(found) else len(step)
        parts.append(_word_hashes(data[start:end]))
        start = end
    return np.concatenate(parts)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, as signed integers."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return np.zeros(0, np.int64)
    length = min(SHINGLE_WORDS, len(words))
    count = len(words) - length + 1
    hashes = np.full(count, length, np.uint64)
    for i in range(length):
        hashes = hashes * np.uint64(_BASE) + words[i : i + count]
    return np.unique(_mixed(hashes).view(np.int64))


def required(size):
    """Least overlap of a set of this size with one it links with: 3/4 of it, rounded up."""
    return -(-3 * size // 4)


def shown(size):
    """Common shingles that a link must show among the first shingles of either set."""
    return 1 + size // 12


def first_part(size):
    """How many shingles in hash order are sure to hold ``shown`` common ones, if there are that many."""
    return size - required(size) + shown(size)


PRINTS = "doc_id bigint, n bigint, a bigint, b bigint"


def _print(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    bits = hashes.view(np.uint64)
    sums = [int(_mixed(bits ^ np.uint64(salt)).sum(dtype=np.uint64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return tuple(s - 2**64 if s >= 2**63 else s for s in sums)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(1)]
        names = [_print(s) for s in sets]
        columns = [[len(s) for s in sets], [a for a, _ in names], [b for _, b in names]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n", "a", "b"])
    release()


def _first_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, a, hits) of the first shingles: a posting (hits 0) under its shingle; of a shingle that several sets of
    this batch hold only one witness (hits -1), and per set, under any slot, how many such shingles it has (hits > 0).
    """
    seen: set[int] = set()
    for batch in batches:
        names, keys = [], []
        for text in batch.column(0):
            found = shingles(text.as_py())
            if len(found) and (name := _print(found)[0]) not in seen:
                seen.add(name)
                names.append(name)
                keys.append(found[: first_part(len(found))])
        if len(seen) > 1_000_000:  # repeats after this are told apart by their names later
            seen.clear()
        if not names:
            continue
        own = np.repeat(np.array(names, np.int64), [len(k) for k in keys])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        flat, own = flat[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        lengths = np.diff(np.append(starts, len(flat)))
        several = lengths > 1
        shared, hits = np.unique(own[np.repeat(several, lengths)], return_counts=True)
        columns = [np.concatenate([flat[starts], shared]), np.concatenate([own[starts], shared]), np.concatenate([-several.astype(np.int64), hits])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "a", "hits"])
    release()


def survivors(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """a, n, doc_id of the distinct sets whose first shingles are held by others often enough for a link."""
    rows = docs.select("text").mapInArrow(_first_postings, "slot bigint, a bigint, hits bigint")
    # The batches have merged their common shingles, so a slot has at most a few rows per batch.
    slot = Window.partitionBy("slot")
    seen = rows.withColumns({"low": F.min("a").over(slot), "high": F.max("a").over(slot)})
    counted = seen.filter("hits > 0 OR (hits = 0 AND low <> high)").groupBy("a").agg(F.sum(F.greatest("hits", F.lit(1))).alias("hits"))
    sets = prints.filter("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("doc_id")).drop("b")
    need = 1 + F.floor(F.ceil(3 * F.col("n") / 4) / 12)
    return sets.join(counted, "a").filter(F.col("hits") >= need).select("a", "n", "doc_id")


#: Bits of the filter that finds the texts of a set of documents before they are shuffled: 8 MB, whatever the input.
FILTER_BITS = 1 << 26


def _texts_of(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, Broadcast]:
    """doc_id, text of the documents in ``kept`` and of a few others, by a bitmap over hashed ids, which is to be destroyed after use."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = kept.select(F.shiftright(bit, 15).alias("page"), F.bitmap_bit_position(bit.bitwiseAND(F.lit(32767)) + 1).alias("at"))
    pages = bits.groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    # At most 2048 pages of 4 KB.
    bitmap = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for page in pages:
        bitmap[page["page"]] = np.frombuffer(page["bits"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))

    @F.arrow_udf("boolean")
    def maybe(at: pa.Array) -> pa.Array:
        number = at.to_numpy(zero_copy_only=False)
        return pa.array(held.value[number >> 3] >> (number & 7) & 1 == 1)

    return docs.select("doc_id", "text").filter(maybe(bit)), held


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(0)]
        columns = [pa.array([_print(s)[0] for s in sets], pa.int64()), batch.column(1), pa.array(sets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["made", "a", "keys"])
    release()


def alive(sets: DataFrame) -> DataFrame:
    """a, n, short, keys: of sets (a, n, keys) those that hold enough shared shingles. ``keys`` are the shared ones, sorted;
    ``short`` those whose inverted lists are left when the longest required - 1 are put aside.
    """
    postings = sets.select("a", "n", F.explode("keys").alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("length")).filter("length > 1")
    least = F.ceil(3 * F.col("n") / 4)
    held = postings.join(lists, "key").groupBy("a", "n").agg(F.array_sort(F.collect_list(F.struct("length", "key"))).alias("lists"))
    held = held.filter(F.size("lists") >= least).withColumn("all", F.transform("lists", lambda x: x["key"]))
    return held.select(
        "a", "n", F.slice("all", F.lit(1), (F.size("all") - least + 1).cast("int")).alias("short"), F.array_sort("all").alias("keys")
    )


def clustered(found: DataFrame) -> DataFrame:
    """a, cluster: sets that share a short list, directly or through others."""
    short = found.select("a", F.explode("short").alias("key"))
    heads = short.groupBy("key").agg(F.min("a").alias("head"), F.max("a").alias("last")).filter("head <> last").drop("last")
    links = short.join(heads, "key").filter("a <> head").select("a", F.col("head").alias("b")).distinct()
    return components(links).withColumnsRenamed({"node": "a", "component": "cluster"})


#: Shingles in a block of a cluster, but for one set.
BLOCK_SHINGLES = 1 << 19


def searches(found: DataFrame, clusters: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (cluster, i, j, side, a, n, short, keys): the two blocks of every search. Blocks run along set size, and two
    blocks are searched only if their sizes leave room for a link.
    """
    sized = found.join(clusters, "a").select("cluster", "a", "n")
    blocked = cut_lineage(
        running_totals(sized, ["cluster"], ["n", "a"], {"before": F.col("n")}, None, exclusive=True)
        .select("cluster", "a", F.floor(F.col("before") / block_shingles).alias("block"), "n")
    )
    spans = blocked.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left = spans.select("cluster", F.col("block").alias("i"), F.col("most").alias("top"))
    right = spans.select("cluster", F.col("block").alias("j"), "least")
    pairs = left.join(right, "cluster").filter("i <= j AND 3 * least <= 4 * top").select("cluster", "i", "j")
    sides = pairs.select("cluster", "i", "j", F.inline(F.array(
        F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))
    ))).filter("side = 0 OR i < j")
    placed = blocked.select("cluster", "block", "a").join(sides, ["cluster", "block"]).drop("block")
    return found.join(placed, "a").select("cluster", "i", "j", "side", "a", "n", "short", "keys")


def divide_skip(short: list, long: np.ndarray, needed, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(place, overlap) of the sets that hold enough of a query's keys.

    ``short``: sorted lists of places, merged with a heap. ``long``: the query's other keys, probed in the set that a merge
    found by binary search. ``needed(place)`` is the overlap that links with a place.
    """
    for place, group in itertools.groupby(heapq.merge(*short)):
        count, least = sum(1 for _ in group), needed(place)
        if count + len(long) >= least:
            keys = sets[place]
            at = np.minimum(np.searchsorted(keys, long), len(keys) - 1)
            count += int((keys[at] == long).sum())
            if count >= least:
                yield place, count


class Search:
    """Links between the sets of two blocks, or within one; gives a spanning forest of them."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: (r[0], r[2], r[1]))  # side, size, name
        self.one = rows[-1][0] == 0
        self.queries = range(len(rows)) if self.one else [p for p, r in enumerate(rows) if r[0] == 1]
        self.names, self.sizes = [r[1] for r in rows], [r[2] for r in rows]
        self.short, self.keys = [r[3] for r in rows], [r[4] for r in rows]
        self.joined = np.arange(len(rows))
        # Inverted lists of the keys that some query merges.
        merged = np.unique(np.concatenate([self.short[q] for q in self.queries]))
        index: dict[int, list[int]] = {}
        for p, r in enumerate(rows):
            if r[0] == 0:
                at = np.minimum(np.searchsorted(merged, r[4]), len(merged) - 1)
                for key in r[4][merged[at] == r[4]].tolist():
                    index.setdefault(key, []).append(p)
        self.lists = {k: np.array(v) for k, v in index.items()}

    def links(self) -> Iterator[tuple[int, int]]:
        for query in self.queries:
            size, lists = self.sizes[query], []
            for key in self.short[query].tolist():
                places = self.lists.get(key)
                if places is not None:
                    places = places[self.joined[places] != self.joined[query]]
                    if self.one:
                        places = places[: np.searchsorted(places, query)]
                    if len(places):
                        lists.append(places.tolist())
            if not lists:
                continue
            long = np.setdiff1d(self.keys[query], self.short[query], assume_unique=True)
            needed = lambda p: -(-3 * (size + self.sizes[p]) // 7)
            for place, _ in divide_skip(lists, long, needed, self.keys):
                if self.joined[place] != self.joined[query]:
                    yield self.names[query], self.names[place]
                    self.joined[self.joined == self.joined[query]] = self.joined[place]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows):
        links = list(Search(rows).links())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    at, rows = None, []
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in range(6))))
        for row, name in enumerate(names):
            if at != name[:3] and rows:
                yield done(rows)
                rows = []
            at = name[:3]
            arrays = [np.array(batch.column(k)[row].values) for k in (6, 7)]
            rows.append((*name[3:], *arrays))
    if rows:
        yield done(rows)


def jaccard_links(docs: DataFrame, prints: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: links between distinct sets, enough of them to connect all that are connected."""
    kept = cut_lineage(survivors(docs, prints))
    some, bitmap = _texts_of(docs, kept)
    texts = some.join(kept, "doc_id").select("text", "a", "n")
    sets = cut_lineage(
        texts.select("text", "a").mapInArrow(_whole_sets, "made bigint, a bigint, keys array<bigint>")
        .filter("made = a").dropDuplicates(["a"])  # a repeated row is one set
        .select("a", F.size("keys").cast("bigint").alias("n"), "keys")
    )
    bitmap.destroy()
    found = cut_lineage(alive(sets))
    rows = searches(found, clustered(found), block_shingles)
    ordered = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return ordered.mapInArrow(_search, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z in lower case; the set of a document is its distinct five-word
    shingles, or all its words as one if it has fewer. Sets link when 100 * overlap >= 75 * union; component_id is the
    smallest doc_id reachable. A text that is null or has no word has an empty set and links with nothing. A null doc_id
    is no document: it gets its size and a null component. Rows that repeat a doc_id are texts of one document, so they
    connect what they link with. Shingles are compared by 64-bit hashes. An empty table gives no rows.
    """
    prints = cut_lineage(bounded_batches(docs).select("doc_id", "text").mapInArrow(_prints, PRINTS))
    named = prints.filter("doc_id IS NOT NULL")
    links = cut_lineage(jaccard_links(docs.filter("doc_id IS NOT NULL"), named, block_shingles))
    # Sets are nodes; a doc_id with several sets ties them together.
    several = named.filter("n > 0").groupBy("doc_id").agg(F.min("a").alias("a"), F.max("a").alias("b")).filter("a <> b")
    ties = named.filter("n > 0").join(several.select("doc_id", F.col("a").alias("head")), "doc_id").filter("a <> head").select("a", F.col("head").alias("b"))
    nodes = components(links.unionByName(ties))
    of_set = named.filter("n > 0").groupBy("a").agg(F.min("doc_id").alias("first")).join(nodes.withColumnRenamed("node", "a"), "a", "left")
    of_set = of_set.withColumn("component", F.coalesce("component", "a"))
    firsts = of_set.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = of_set.join(firsts, "component").select("a", "component_id")
    full = prints.filter("n > 0 AND doc_id IS NOT NULL").join(classes, "a").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = prints.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(rest)


@query(
    "op5_ngram_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
    g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
    l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT s.doc_id, len(grams) AS n_shingles, c.component_id
    FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON s.doc_id = c.a""",
)
def op5_ngram_join(spark, folder):
    return jaccard_components(table(spark, folder, "documents", "doc_id", "text"))
