"""Streaming metrics: sliding rates, tumbling activity, sustained alerts and circuit breakers."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom import settings
from newsloom.operators import guardrails
from newsloom.session import cut_lineage
from newsloom.sinks import tables


def sliding_rates(samples: DataFrame, keys: list[str], window: str, slide: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Per-second rate of counter increases (column ``value``) per sliding window."""
    grouped = samples.withWatermark("ts", late).groupBy(F.window("ts", window, slide), *keys)
    sums = grouped.agg(F.sum("value").alias("increase"))
    return sums.select(
        *keys, F.unix_seconds("window.end").alias("window_end"), F.col("increase"),
        (F.col("increase") / F.lit(float(seconds))).alias("rate"),
    )


def tumbling_activity(samples: DataFrame, keys: list[str], window: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    grouped = samples.withWatermark("ts", late).groupBy(F.window("ts", window), *keys)
    return grouped.agg(F.count("*").alias("n")).select(*keys, F.unix_seconds("window.start").alias("window_start"), "n")


def sustained(evaluations: DataFrame, keys: list[str], key_types: str, step_s: int, hold_s: int, severity: str) -> DataFrame:
    """One row when a condition has held for ``hold_s``: keyed state keeps when it became true.

    ``evaluations``: keys, ``window_end`` (epoch seconds), ``firing``. Evaluations of one batch are
    few per key (one per slide), and are taken in time order.
    """
    output = f"{key_types}, pending_since bigint, firing_since bigint, severity string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last, told = state.get if state.exists else (-1, -1, False)
        alerts = []
        for at, firing in sorted((r.window_end, r.firing) for f in frames for r in f.itertuples(index=False)):
            if not firing:
                since, last, told = -1, -1, False
                continue
            if since < 0 or at - last > step_s:
                since, told = at, False
            last = at
            if not told and at - since >= hold_s:
                told = True
                alerts.append((*key, since, since + hold_s, severity))
        state.update((int(since), int(last), bool(told)))
        if alerts:
            yield pd.DataFrame(alerts, columns=[*keys, "pending_since", "firing_since", "severity"])

    return evaluations.groupBy(*keys).applyInPandasWithState(
        step, output, "since bigint, last bigint, told boolean", "append", GroupStateTimeout.NoTimeout
    )


def breakers(extractions: DataFrame) -> DataFrame:
    """Breaker verdict per extraction (domain, seq, blind, failed) as a stream, with counts kept per domain: domain, seq, breaker.

    Rows of a domain must come in ``seq`` order across batches; inside a batch they come in any order and in any number of Arrow
    frames. One worker holds a number for each of a domain's rows in a batch; ``judge_extractions`` splits a hot domain instead.
    """
    output = "domain string, seq bigint, breaker string"

    def last_run(flagged: list[np.ndarray], before: int, limit: int) -> float:
        """The ``seq`` of the row that fills the limit: rows behind it are skipped."""
        seqs, left = np.concatenate([*flagged, np.zeros(0, np.int64)]), limit - before
        if left <= 0:
            return -np.inf
        return np.partition(seqs, left - 1)[left - 1] if len(seqs) >= left else np.inf

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = state.get if state.exists else (0, 0)
        parts, blind, failed = [], [], []
        for frame in frames:
            seq = frame["seq"].to_numpy()
            parts.append(seq)
            for name, flagged in (("blind", blind), ("failed", failed)):
                flagged.append(seq[(frame[name] == True).to_numpy()])  # noqa: E712
        last_blind = last_run(blind, counts[0], settings.BLIND_DOMAIN_THRESHOLD)
        last_failed = last_run(failed, counts[1], settings.FAILED_DOMAIN_THRESHOLD)
        state.update((counts[0] + sum(map(len, blind)), counts[1] + sum(map(len, failed))))
        for seq in parts:
            verdict = np.where(seq > last_failed, "circuit_open_skip", np.where(seq > last_blind, "blind_circuit_skip", None))
            yield pd.DataFrame({"domain": key[0], "seq": seq, "breaker": verdict})

    return extractions.groupBy("domain").applyInPandasWithState(
        step, output, "blind bigint, failed bigint", "append", GroupStateTimeout.NoTimeout
    )


COUNTS = "domain string, blind bigint, failed bigint, epoch bigint"


def judge_extractions(extractions: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Breaker verdict per extraction (domain, seq, blind, failed) of a stream, written to ``<path>/rows``: domain, seq, breaker.

    Every micro-batch is judged by running totals that split a hot domain, on top of the counts stored after the batch before. Rows
    of a domain must come in ``seq`` order across batches; inside a batch they may come in any. Verdicts and counts of a batch
    lie in folders of its number, so a batch that is run again replaces what it had written.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        spark, none = batch.sparkSession, lambda c: F.coalesce(c, F.lit(0))
        before = tables.stored(spark, f"{path}/counts", COUNTS).filter(F.col("epoch") == epoch - 1)
        rows = cut_lineage(batch.select("domain", "seq", "blind", "failed"))
        judged = guardrails.with_breaker(rows, ["domain"], ["seq"], None, F.col("blind"), F.col("failed"), before)
        judged.select("domain", "seq", "breaker").write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        here = rows.groupBy("domain").agg(F.count_if("blind").alias("more_blind"), F.count_if("failed").alias("more_failed"))
        now = before.drop("epoch").join(here, "domain", "full_outer")
        now.select(
            "domain", (none(F.col("blind")) + none(F.col("more_blind"))).alias("blind"), (none(F.col("failed")) + none(F.col("more_failed"))).alias("failed")
        ).write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")

    writer = extractions.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def is_firing(rate: Column, above: float) -> Column:
    return F.coalesce(rate > above, F.lit(False))
