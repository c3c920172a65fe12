"""Exact, near and historical duplicate removal.

Near duplicates follow the sequential rule: in ``seq`` order a row goes when an earlier *kept* row
of the same block resembles it. After exact copies have been collapsed by an aggregation, a small block is
decided in one go. Of a large one the first rows are, and those that stay meet all others, which ends most blocks of
copies in a few passes over their rows. What is left is cut into tiles by day and hash; only tiles whose days can
match meet, and tell for every row the first few earlier rows it resembles. That is a graph of bounded degree, and rounds over
it keep a row when every earlier row it resembles is gone, and drop it when one is kept. Blocks of different titles have
no links and end in one round; a row with more links than were told asks again, without the rows that are gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsloom import settings
from newsloom.functions import text, url
from newsloom.functions.fuzzy import Peer, Tile, first_kept, links, resembling
from newsloom.operators.once import once
from newsloom.operators.ordered import top_per_key
from newsloom.session import cut_lineage

#: Rows of a block that is decided in one go.
SMALL_BLOCK = 256
#: Rows of a tile of a larger one.
TILE_ROWS = 1024
#: Characters of a block decided in one go, and of a tile.
TILE_CHARS = 1 << 21
#: Earlier rows that are told of a row at a time.
FIRST_LINKS = 8
DAY_US = 86_400_000_000


def url_dedup(df: DataFrame, scope: list[str] = (), order: str = "seq") -> DataFrame:
    """First row per normalised URL; rows without a link go, a missing platform is filled in."""
    linked = df.filter(F.coalesce(F.col("link"), F.lit("")) != "")
    keyed = once(linked, norm_url=url.normalize_url("link"))
    first = top_per_key(keyed, [*scope, "norm_url"], [order], 1)
    platform = F.coalesce(F.nullif("platform", F.lit("")), url.platform_from_url("link"))
    return first.withColumn("platform", platform)


def last_in_batch(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Last row per key; rows missing a key value go."""
    present = df.dropna(subset=keys)
    for k, kind in present.select(*keys).dtypes:
        if kind == "string":
            present = present.filter(F.col(k) != "")
    return top_per_key(present, keys, [F.col(order).desc()], 1)


def blocking_columns(df: DataFrame, scope: list[str], wrapper_hosts, more: list[str] = ()) -> DataFrame:
    """What pair tests need of every row with a title: scope, seq, text, at, domain, wrapper, signature and the columns ``more``."""
    linked = F.coalesce(F.nullif("link", F.lit("")), F.nullif("platform", F.lit("")), F.lit(""))
    normalized = text.normalize_title(text.comparison_text("title", "content_teaser"))
    host = F.regexp_replace(url.netloc("link"), r"^www\.", "")
    keyed = df.select(
        *scope,
        *more,
        "seq",
        normalized.alias("text"),
        F.unix_micros("published_at").alias("at"),
        url.etld_plus_one(linked).alias("domain"),
        F.coalesce(host.isin(*wrapper_hosts), F.lit(False)).alias("wrapper"),
    )
    keyed = once(keyed, text=F.col("text"))
    return keyed.filter(F.col("text") != "").withColumn("signature", text.title_signature("text"))


def span_us(days: int) -> int:
    return max(0, int(days)) * 86_400_000_000


def _tile(rows: list[dict]) -> Tile:
    return Tile([Peer.of(r["text"], r["at"], r["domain"], r["wrapper"]) for r in rows], [r["seq"] for r in rows])


def _keep_first(threshold: float, window_us: int):
    @F.arrow_udf("array<bigint>")
    def keep(blocks: pa.Array) -> pa.Array:
        tiles = (_tile(b.as_py()) for b in blocks)
        return pa.array([t.seqs[first_kept(t, threshold, window_us)].tolist() for t in tiles], pa.list_(pa.int64()))

    return keep


def _as_peer() -> Column:
    return F.struct("seq", "text", "at", "domain", "wrapper")


def _tiles(rows: DataFrame, block: list[str]) -> DataFrame:
    """block, day, tile and the packed rows: rows of one day of a block (null: undated), at most about ``TILE_ROWS``."""
    dated = rows.withColumn("day", F.floor(F.col("at") / DAY_US))
    # A null day groups like any other, but does not join.
    day = F.coalesce("day", F.lit(-(2**40))).alias("_day")
    parts = F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum(F.length("text")) / TILE_CHARS))
    sizes = dated.groupBy(*block, day).agg(parts.cast("int").alias("_tiles"))
    numbered = dated.withColumn("_day", day).join(sizes, [*block, "_day"])
    tile = F.pmod(F.xxhash64("seq"), F.col("_tiles")).cast("int")
    return numbered.groupBy(*block, "day", tile.alias("tile")).agg(F.collect_list(_as_peer()).alias("rows"))


def _tile_pairs(left: DataFrame, right: DataFrame, block: list[str], window_us: int) -> DataFrame:
    """Tiles (day, tile) of ``left`` and (other_day, other_tile) of ``right`` of one block whose days are close enough, or unknown."""
    reach = -(-window_us // DAY_US)
    mine = left.select(*block, "day", "tile")
    theirs = right.select(*block, F.col("day").alias("other_day"), F.col("tile").alias("other_tile"))
    near = theirs.filter("other_day IS NOT NULL").withColumn("day", F.explode(F.sequence(F.col("other_day") - reach, F.col("other_day") + reach)))
    dated = mine.join(near, [*block, "day"])
    undated = mine.filter("day IS NULL").join(theirs, block)
    unknown = mine.filter("day IS NOT NULL").join(theirs.filter("other_day IS NULL"), block)
    return dated.select(*block, "day", "tile", "other_day", "other_tile").unionByName(undated).unionByName(unknown)


def _dealt(work: DataFrame, *by) -> DataFrame:
    """Rows of few bytes but much work over all tasks; a fixed partition count keeps them from being coalesced."""
    return work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _meet(pairs: DataFrame, left: DataFrame, right: DataFrame, block: list[str], found, schema: str) -> DataFrame:
    """Rows that ``found`` (packed rows, the other's packed rows, whether both are one tile) gives for each pair of tiles."""
    theirs = right.select(*block, F.col("day").alias("other_day"), F.col("tile").alias("other_tile"), F.col("rows").alias("others"))
    same = lambda *names: [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*block, *names)]
    joined = pairs.alias("p").join(left.alias("t"), same("day", "tile")).select("p.*", "t.rows")
    joined = joined.alias("p").join(theirs.alias("t"), same("other_day", "other_tile")).select("p.*", "t.others")
    one = F.lit(left is right) & F.col("day").eqNullSafe(F.col("other_day")) & (F.col("tile") == F.col("other_tile"))
    names = [field.split()[0] for field in schema.split(", ")]
    scope = names[: -2 if len(names) > 1 and names[-1] == "earlier" else -1]
    return _searched(joined.select(*scope, "rows", "others", one.alias("one")), found, schema)


def _searched(pairs: DataFrame, found, schema: str) -> DataFrame:
    """Rows that ``found`` gives for each row of ``pairs`` (scope, rows, others, one), dealt over all tasks."""
    scope = pairs.columns[:-3]
    names = [field.split()[0] for field in schema.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                of = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
                head = [of(c) for c in scope]
                rows += [(*head, *link) for link in found(of("rows"), of("others"), of("one"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    types = [f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))]
    dealt = _dealt(pairs, F.get("rows", F.lit(0))["seq"], F.get("others", F.lit(0))["seq"])
    return dealt.mapInArrow(search, schema)


def _links(rows: DataFrame, peers: DataFrame | None, scope: list[str], block: list[str], threshold: float, window_us: int) -> DataFrame:
    """(scope, seq, earlier): of every row the first ``FIRST_LINKS`` earlier rows among ``rows`` and ``peers`` that it resembles."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in scope), "seq bigint", "earlier bigint"])
    mine = cut_lineage(_tiles(rows, block))
    pairs = _tile_pairs(mine, mine, block, window_us)
    # Of a tile and another, one order is enough.
    order = lambda d, t: F.struct(F.coalesce(d, F.lit(-(2**40))), t)
    once_ = pairs.filter(order(F.col("day"), F.col("tile")) <= order(F.col("other_day"), F.col("other_tile")))

    def inside(left: list, right: list, one: bool) -> Iterator[tuple[int, int]]:
        a = _tile(left)
        return links(a, a if one else _tile(right), threshold, window_us, FIRST_LINKS)

    found = _meet(once_, mine, mine, block, inside, schema)
    if peers is not None:
        others = cut_lineage(_tiles(peers, block))

        def across(left: list, right: list, one: bool) -> Iterator[tuple[int, int]]:
            own = {r["seq"] for r in left}
            return (x for x in links(_tile(left), _tile(right), threshold, window_us, FIRST_LINKS) if x[0] in own)

        found = found.unionByName(_meet(_tile_pairs(mine, others, block, window_us), mine, others, block, across, schema))
    return cut_lineage(top_per_key(found, [*scope, "seq"], ["earlier"], FIRST_LINKS))


def _resembling(threshold: float, window_us: int):
    """Seqs of the packed rows that resemble one of the others."""

    def hits(left: list, right: list, one: bool) -> Iterator[tuple[int]]:
        return ((seq,) for seq in resembling(_tile(left), _tile(right), threshold, window_us))

    return hits


def _key_schema(rows: DataFrame, scope: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([*(f"{c} {kinds[c]}" for c in scope), "seq bigint"])


def _leading(rows: DataFrame, block: list[str], order: list) -> DataFrame:
    """The first rows of every block, at most ``SMALL_BLOCK`` and about ``TILE_CHARS``."""
    first = top_per_key(rows, block, order, SMALL_BLOCK)
    earlier = F.sum(F.length("text")).over(Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("_before", earlier).filter("coalesce(_before, 0) < " + str(TILE_CHARS)).drop("_before")


def _meet_leaders(rows: DataFrame, leaders: DataFrame, scope: list[str], block: list[str], threshold: float, window_us: int) -> DataFrame:
    """Keys (scope, seq) of ``rows`` that resemble one of their block's ``leaders`` (block, packed others)."""
    pairs = _tiles(rows, block).join(leaders, block).select(*scope, "rows", "others", F.lit(False).alias("one"))
    return _searched(pairs, _resembling(threshold, window_us), _key_schema(rows, scope))


def _large_losers(rows: DataFrame, scope: list[str], block: list[str], threshold: float, window_us: int) -> DataFrame:
    """Keys (scope, seq) of the rows of large blocks that go.

    The first rows of a block are decided among themselves, and those that stay meet all later ones. A block that loses half of its
    rows that way does so again; the others are left to the graph of links.
    """
    key, gone, apart = [*scope, "seq"], None, None
    while True:
        groups = _leading(rows, block, ["seq"]).groupBy(*block).agg(F.collect_list(_as_peer()).alias("rows"), F.max("seq").alias("_last"))
        heads = cut_lineage(_dealt(groups, "_last").withColumn("kept", _keep_first(threshold, window_us)("rows")))
        later = cut_lineage(rows.join(heads.select(*block, "_last"), block).filter("seq > _last").drop("_last"))
        leaders = heads.select(*block, F.filter("rows", lambda r: F.array_contains("kept", r["seq"])).alias("others"))
        hit = _meet_leaders(later, leaders, scope, block, threshold, window_us)
        lost = cut_lineage(heads.select(*scope, F.explode(F.array_except("rows.seq", "kept")).alias("seq")).unionByName(hit))
        gone = lost if gone is None else gone.unionByName(lost)
        open_ = cut_lineage(later.join(lost, key, "left_anti"))
        before = rows.groupBy(*block).agg(F.count("*").alias("_before"))
        sizes = open_.groupBy(*block).agg(F.count("*").alias("_left")).join(before, block)
        halved = cut_lineage(sizes.select(*block, (F.col("_left") * 2 <= F.col("_before")).alias("_halved")))
        split = open_.join(halved, block)
        rest = split.filter("not _halved").drop("_halved")
        apart = rest if apart is None else apart.unionByName(rest)
        if halved.filter("_halved").isEmpty():
            break
        rows = cut_lineage(split.filter("_halved").drop("_halved"))
    apart = cut_lineage(apart)
    return gone if apart.isEmpty() else gone.unionByName(_graph_losers(apart, scope, block, threshold, window_us))


def _graph_losers(rows: DataFrame, scope: list[str], block: list[str], threshold: float, window_us: int) -> DataFrame:
    """Keys (scope, seq) of the rows that go, by rounds over the links of the rows."""
    key = [*scope, "seq"]
    open_, kept, gone = rows, None, rows.select(*key).limit(0)
    while True:
        edges = _links(open_, kept, scope, block, threshold, window_us)
        told = edges.groupBy(*key).agg((F.count("*") >= FIRST_LINKS).alias("more"))
        # kept: true or false once decided, null before; rows kept in earlier passes are known.
        state = open_.select(*key).join(told, key, "left").select(*key, F.coalesce("more", F.lit(False)).alias("more"), F.lit(None).cast("boolean").alias("kept"))
        if kept is not None:
            state = state.unionByName(kept.select(*key, F.lit(False).alias("more"), F.lit(True).alias("kept")))
        state, left = cut_lineage(state), None
        while True:
            earlier = state.select(*scope, F.col("seq").alias("earlier"), F.col("kept").alias("above"))
            asked = edges.join(earlier, [*scope, "earlier"]).groupBy(*key).agg(
                F.bool_or(F.coalesce("above", F.lit(False))).alias("hit"), F.bool_or(F.col("above").isNull()).alias("waits")
            )
            none = lambda c: F.coalesce(c, F.lit(False))
            verdict = F.when(none("hit"), F.lit(False)).when(none("waits") | F.col("more"), F.lit(None)).otherwise(F.lit(True))
            state = cut_lineage(state.join(asked, key, "left").select(*key, "more", F.coalesce("kept", verdict).alias("kept")))
            before, left = left, state.agg(F.count_if(F.col("kept").isNull())).first()[0]
            # What is still open waits for a row that must ask again, or must itself.
            if not left or left == before:
                break
        gone = gone.unionByName(state.filter("kept = false").select(*key))
        if not left:
            return gone
        again = state.filter("kept IS NULL").select(*key)
        survivors = state.filter("kept").select(*key)
        kept = cut_lineage(rows.join(survivors, key, "left_semi"))
        open_ = cut_lineage(rows.join(again, key, "left_semi"))


def near_dedup(
    df: DataFrame,
    scope: list[str] = (),
    threshold: float = settings.FUZZY_THRESHOLD,
    day_window: int = settings.FUZZY_DAY_WINDOW,
    wrapper_hosts=settings.WRAPPER_HOSTS,
) -> DataFrame:
    """Rows left after near-duplicate removal. ``seq`` must be unique within ``scope``."""
    scope = list(scope)
    threshold = max(1, min(threshold, 100))
    rows = cut_lineage(blocking_columns(df, scope, wrapper_hosts))

    # A title seen behind a wrapper host is compared across domains; others stay in their domain.
    wrapped = rows.filter("wrapper").select(*scope, "signature").distinct().withColumn("_wrapped", F.lit(True))
    block = [*scope, "signature", "home"]
    rows = rows.join(wrapped, [*scope, "signature"], "left").withColumn(
        "home", F.when(F.col("_wrapped"), F.lit("")).otherwise(F.col("domain"))
    )

    # A later row with the same text, domain and date shares every neighbour of the first.
    first = cut_lineage(rows.groupBy(*block, "domain", "wrapper", "text", "at").agg(F.min("seq").alias("seq")))
    window_us = span_us(day_window)
    small = (F.count("*") <= SMALL_BLOCK) & (F.sum(F.length("text")) <= TILE_CHARS)
    sizes = cut_lineage(first.groupBy(*block).agg(F.count("*").alias("_size"), small.alias("_small")).filter("_size > 1").drop("_size"))
    few = sizes.filter("_small").drop("_small")
    groups = first.join(few, block, "left_semi").groupBy(*block).agg(F.collect_list(_as_peer()).alias("rows"))
    decided = _dealt(groups, *block).select(*scope, F.col("rows.seq").alias("seqs"), _keep_first(threshold, window_us)("rows").alias("kept"))
    dropped = decided.select(*scope, F.explode(F.array_except("seqs", "kept")).alias("seq"))
    many = sizes.filter("not _small").drop("_small")
    if not many.isEmpty():
        large = cut_lineage(first.join(many, block, "left_semi"))
        dropped = dropped.unionByName(_large_losers(large, scope, block, threshold, window_us))
    # What goes: later copies of an identical row, and representatives that lost.
    kept = first.select(*scope, "seq").join(dropped, [*scope, "seq"], "left_anti")
    gone = rows.select(*scope, "seq").join(kept, [*scope, "seq"], "left_anti")
    return df.join(gone, [*scope, "seq"], "left_anti")


def recent_history(
    mentions: DataFrame, as_of, scope: list[str],
    days: int = settings.HISTORY_DAYS, limit: int | None = None,
) -> DataFrame:
    """Stored mentions new rows are compared with: the last days, and of those the newest
    ``limit`` per scope (``settings.HISTORY_LIMIT`` is the usual one) where a limit is given."""
    from newsloom.operators.filters import recent

    window = recent(mentions, as_of, days)
    if limit is None:
        return window
    return top_per_key(window, scope, [F.col("created_at").desc(), F.col("seq").desc()], max(1, limit))


def _known(new: DataFrame, old: DataFrame, scope: list[str], block: list[str], threshold: float, window_us: int) -> DataFrame:
    """Keys (scope, seq) of the new rows that resemble an old one: first one of a few old ones, then one of all.

    In a block of copies a few old rows hit nearly all new ones. While they hit half of a block's rows, other ones meet what is left
    of it; in the end tiles of what is left meet tiles of all old rows.
    """
    key, hash_ = [*scope, "seq"], [F.xxhash64("seq"), "seq"]
    # Only blocks too large for a single pair of tiles are worth a pass.
    large = cut_lineage(
        new.groupBy(*block).agg(F.count("*").alias("_new")).join(old.groupBy(*block).agg(F.count("*").alias("_stored")), block)
        .filter((F.col("_new") > SMALL_BLOCK) & (F.col("_stored") > SMALL_BLOCK)).select(*block)
    )
    hit = None
    busy, unmet = new.join(large, block, "left_semi"), old
    while not large.isEmpty():
        few = cut_lineage(_leading(unmet.join(large, block, "left_semi"), block, hash_))
        leaders = few.groupBy(*block).agg(F.collect_list(_as_peer()).alias("others"))
        found = cut_lineage(_meet_leaders(busy, leaders, scope, block, threshold, window_us))
        hit = found if hit is None else hit.unionByName(found)
        left = cut_lineage(busy.join(found, key, "left_anti"))
        before = busy.groupBy(*block).agg(F.count("*").alias("_before"))
        sizes = left.groupBy(*block).agg(F.count("*").alias("_left")).join(before, block)
        large = cut_lineage(sizes.filter((F.col("_left") * 2 <= F.col("_before")) & (F.col("_left") > SMALL_BLOCK)).select(*block))
        unmet = unmet.join(few.select(*key), key, "left_anti")
        busy = left.join(large, block, "left_semi")
    rest = new if hit is None else new.join(hit, key, "left_anti")
    mine = cut_lineage(_tiles(rest, block))
    theirs = cut_lineage(_tiles(old.join(rest.select(*block).distinct(), block, "left_semi"), block))
    pairs = _tile_pairs(mine, theirs, block, window_us)
    found = _meet(pairs, mine, theirs, block, _resembling(threshold, window_us), _key_schema(new, scope))
    return (found if hit is None else found.unionByName(hit)).distinct()


def without_historical(
    df: DataFrame,
    history: DataFrame,
    scope: list[str] = (),
    threshold: float = settings.FUZZY_THRESHOLD,
    day_window: int = settings.FUZZY_DAY_WINDOW,
    wrapper_hosts=settings.WRAPPER_HOSTS,
) -> DataFrame:
    """Fuzzy anti-join of new rows against stored ones: tiles of new rows meet tiles of stored rows of their block and days."""
    scope = list(scope)
    block = [*scope, "signature"]
    # Rows of one text, domain and date share their fate, and stored ones their effect.
    same = [*block, "text", "at", "domain", "wrapper"]
    new = cut_lineage(blocking_columns(df, scope, wrapper_hosts))
    old = blocking_columns(history, scope, wrapper_hosts).join(new.select(*block).distinct(), block, "left_semi")
    both = new.withColumn("_old", F.lit(False)).unionByName(old.withColumn("_old", F.lit(True)))
    first = cut_lineage(both.groupBy("_old", *same).agg(F.min("seq").alias("seq")))
    threshold, window_us = max(1, min(threshold, 100)), span_us(day_window)
    hit = _known(first.filter("not _old").drop("_old"), first.filter("_old").drop("_old"), scope, block, threshold, window_us)
    # From the first row of a text, domain and date back to all of them.
    lost = cut_lineage(first.filter("not _old").join(hit, [*scope, "seq"], "left_semi").drop("seq"))
    copies = new.alias("n").join(lost.alias("l"), [F.col(f"n.{c}").eqNullSafe(F.col(f"l.{c}")) for c in same]).select(*[f"n.{c}" for c in [*scope, "seq"]])
    return df.join(copies, [*scope, "seq"], "left_anti")
