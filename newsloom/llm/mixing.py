"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Every document of source s is taken at the rate min(most, exp(lambda_s * size)), the rates closest in entropy to
taking each document once under the constraint that the source's words add up to its target. The one
multiplier per source solves a convex dual; Newton steps find it for all sources at once, each step one
aggregation over the table of (source, size) counts. The rates are then rounded to whole copies: in order of
size, the running sum of the fractions gets a copy each time it passes a whole number, so neighbours of nearly the same
size make up for each other and a source ends within about one document of its target.

Sums are taken over whole numbers (counts, and contributions in units of 2**-20 words), so no order of
addition changes the result and reruns agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window, functions as F

from newsloom.llm.common import WORD, query, table
from newsloom.operators.ordered import row_numbers, running_totals
from newsloom.session import cut_lineage

UNIT = float(2**20)
FRACTION = float(2**30)


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """source, number, source_size, target of every source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all words; no target exceeds ``most``
    times its source, and what is cut off is shared again by weight. That is one water level for all
    uncapped sources, found by walking the sources in order of cap over weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = row_numbers(
        totals.withColumn("last", F.col("source").isNull().cast("int")).withColumn("all", F.lit(0)),
        ["all"], ["last", "source"], None, "number",
    )
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight).withColumn("full", F.col("source_size") / F.col("weight"))
    ranked = running_totals(
        capped, ["all"], ["full", "number"], {"words": F.col("source_size"), "weights": F.col("weight")}, None, exclusive=True
    )
    ends = ranked.groupBy("all").agg(F.sum("source_size").alias("every_word"), F.sum("weight").alias("every_weight"))
    # With the sources before this one at their caps, the level of this one and the rest.
    level = (F.col("every_word") - most * F.col("words")) / (F.col("every_weight") - F.col("weights"))
    walked = ranked.join(ends, "all").withColumn("level", level.cast("double"))
    first = walked.filter(F.col("level") <= most * F.col("full")).groupBy("all").agg(
        F.min(F.struct("full", "number", "level")).getField("level").alias("water")
    )
    cap = (most * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(F.col("water") * F.col("weight"), cap))
    return walked.join(first, "all", "left").select("source", "number", "source_size", target.alias("target"))


def _rate(factor, size, most):
    return F.least(F.lit(float(most)), F.exp(factor * size))


def balance(counts: DataFrame, targets: DataFrame, most: int = 3, steps: int = 60, close: float = 1e-7) -> DataFrame:
    """number, factor of every source: the multiplier whose rates give the target.

    ``counts``: number, size, docs. Newton steps on the dual, kept inside a bracket that shrinks by at least half whenever a
    step would leave it; a source is settled when its words are within ``close`` of the target, or at least ``0.01`` words.
    """
    # At log(most) / smallest size every document is at its cap; far below, hardly a word is left.
    smallest = counts.filter("size > 0").groupBy("number").agg(F.min("size").alias("smallest"))
    state = cut_lineage(
        targets.join(smallest, "number").select(
            "number", "target", F.lit(0.0).alias("factor"), (F.lit(-60.0) / F.col("smallest")).alias("low"),
            (F.log(F.lit(float(most))) / F.col("smallest")).alias("high"), F.lit(False).alias("settled"),
        )
    )
    for _ in range(steps):
        open_ = state.filter("not settled")
        rate = _rate(F.col("factor"), F.col("size"), most)
        words = F.col("docs") * F.round(F.col("size") * rate * UNIT).cast("decimal(38,0)")
        bend = F.when(rate < most, F.col("docs") * F.round(F.col("size") * F.col("size") * rate * UNIT).cast("decimal(38,0)")).otherwise(0)
        sums = counts.join(open_.select("number", "factor"), "number").groupBy("number").agg(
            (F.sum(words).cast("double") / UNIT).alias("words"), (F.sum(bend).cast("double") / UNIT).alias("bend")
        )
        over = F.col("words") - F.col("target")
        low, high = F.when(over < 0, F.col("factor")).otherwise(F.col("low")), F.when(over > 0, F.col("factor")).otherwise(F.col("high"))
        step = F.col("factor") - over / F.nullif(F.col("bend"), F.lit(0.0))
        settled = (F.abs(over) <= F.greatest(F.col("target") * close, F.lit(0.01))) | (F.col("high") - F.col("low") < 1e-15)
        still = lambda name, new: F.when(F.col("settled"), F.col(name)).otherwise(new)
        # A settled source has no sums and stays as it is.
        stepped = state.join(sums, "number", "left").withColumns(
            {"low": still("low", low), "high": still("high", high), "was": F.col("factor"), "settled": F.col("settled") | settled}
        ).withColumn(
            "factor",
            F.when(F.col("settled"), F.col("was")).when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2),
        )
        # Counted while it is written: a step is one job.
        seen = Observation(f"balance_{uuid.uuid4().hex}")
        state = cut_lineage(stepped.select(*state.columns).observe(seen, F.count_if(~F.col("settled")).alias("open")))
        if not seen.get.get("open"):
            break
    return state.select("number", "factor")


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; other columns are ignored).

    Returns doc_id, source, size, source_size, target, rate, copies (0 to ``most``) and taken = copies * size.
    A document's size is its number of words, null text 0. Null is a source of its own, the last. Rows
    that repeat a doc_id are documents of their own; which of equal rows gets a copy makes no difference
    to their sum. Sources without words have target 0 and copies 0 or more of nothing. An empty table gives no rows.
    """
    sizes = cut_lineage(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    )
    targets = cut_lineage(source_targets(sizes, weights, most))
    numbered = cut_lineage(
        sizes.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "d.source", "size", "number", "source_size", "target")
    )
    counts = cut_lineage(numbered.groupBy("number", "size").agg(F.count("*").alias("docs")))
    factors = balance(counts, targets.select("number", "target"), most)
    return _copies(numbered, counts, factors, most)


def _copies(numbered: DataFrame, counts: DataFrame, factors: DataFrame, most: int) -> DataFrame:
    """Rates to whole copies. The running sums go over (source, size) counts first, so that a document
    only needs its place among the documents of its own source and size."""
    rate = F.coalesce(_rate(F.col("factor"), F.col("size"), most), F.lit(0.0))
    rated = counts.join(factors, "number", "left").withColumn("rate", rate)
    units = F.floor((F.col("rate") - F.floor("rate")) * FRACTION)
    parts = rated.withColumn("units", units.cast("long"))
    summed = running_totals(
        parts, ["number"], ["size"], {"before": (F.col("docs") * F.col("units")).cast("decimal(38,0)")}, None, exclusive=True
    )
    # Of the documents of one source and size, hashed into parts, the number before each part.
    spread = numbered.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4096)))
    inside = spread.groupBy("number", "size", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("number", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = inside.withColumn("start", before).drop("rows")
    place = F.row_number().over(Window.partitionBy("number", "size", "part").orderBy("doc_id")) - 1
    placed = spread.withColumn("place", place).join(starts, ["number", "size", "part"]).join(
        summed.select("number", "size", "rate", "units", "before"), ["number", "size"]
    )
    passed = lambda k: F.floor((F.col("before") + (F.col("start") + F.col("place") + k) * F.col("units")) / FRACTION + 0.5)
    rounded = cut_lineage(placed.withColumn("copies", (F.floor("rate") + passed(1) - passed(0)).cast("long")).drop("units", "before", "start"))
    return _last_document(rounded, most).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _last_document(rounded: DataFrame, most: int) -> DataFrame:
    """Gives one document per source a copy more or less: the one that leaves the least gap to the target."""
    gaps = rounded.groupBy("number").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    change = F.when((F.col("gap") > 0) & (F.col("copies") < most), 1).when((F.col("gap") < 0) & (F.col("copies") > 0), -1)
    left = F.abs(F.col("gap") - change * F.col("size"))
    found = rounded.join(gaps, "number").withColumns({"change": change, "left": left}).filter(F.col("left") < F.abs("gap"))
    best = found.groupBy("number").agg(F.min(F.struct("left", "size", "part", "place", "change")).alias("best")).select("number", "best.*").drop("left")
    keys = ["number", "size", "part", "place"]
    return rounded.join(best, keys, "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))


@query("op6_mix_sources")
def op6_mix_sources(spark, folder):
    return mix(table(spark, folder, "documents", "doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )
