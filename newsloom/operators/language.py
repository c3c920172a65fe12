"""Language filter from character trigram profiles trained by a Spark aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom import settings
from newsloom.operators.ordered import top_per_key
from newsloom.session import cut_lineage

GRAMS_PER_LANGUAGE = 300
#: Characters whose trigrams are counted at a time, and slots of a count by number instead of by sorting.
_STEP = 1 << 20


def _words(df: DataFrame, body: Column) -> DataFrame:
    """One row per word occurrence, with the other columns of ``df``."""
    rows = df.select("*", F.explode(F.split(F.lower(body), r"[^\p{L}]+")).alias("word"))
    return rows.filter(F.col("word") != "")


def _trigrams(df: DataFrame) -> DataFrame:
    """One row per trigram of the padded ``word``."""
    rows = df.select("*", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("_i"))
    padded = F.concat(F.lit("_"), "word", F.lit("_"))
    return rows.withColumn("gram", F.substring(padded, F.col("_i"), F.lit(3))).drop("word", "_i")


def _gram_counts(body: str) -> Iterator[tuple[str, int]]:
    """Trigrams of ``body``, words with one ``_`` or more around each, that have a letter in the middle; a trigram may come twice."""
    codes = np.frombuffer(f"_{body}_".encode("utf-32-le"), np.uint32)
    for start in range(0, len(codes) - 2, _STEP):
        part = codes[start : start + _STEP + 2]
        used = np.flatnonzero(np.bincount(part))
        number = np.zeros(int(used[-1]) + 1, np.int64)
        number[used] = np.arange(len(used))
        at = number[part]
        grams = ((at[:-2] * len(used) + at[1:-1]) * len(used) + at[2:])[part[1:-1] != ord("_")]
        if len(used) ** 3 <= _STEP:
            times = np.bincount(grams)
            found = np.flatnonzero(times)
            times = times[found]
        else:
            found, times = np.unique(grams, return_counts=True)
        letters = [chr(c) for c in used.tolist()]
        for gram, n in zip(found.tolist(), times.tolist()):
            rest, last = divmod(gram, len(used))
            first, middle = divmod(rest, len(used))
            yield letters[first] + letters[middle] + letters[last], n


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, gram, n) of the rows (language, body) of every batch."""
    for batch in batches:
        bodies: dict[str | None, list[str]] = {}
        for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bodies.setdefault(language, []).append(body)
        rows = [(language, gram, n) for language, some in bodies.items() for gram, n in _gram_counts("_".join(some))]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["language", "gram", "n"])


def train_profiles(samples: DataFrame, body: str, language: str, size: int = GRAMS_PER_LANGUAGE) -> DataFrame:
    """Most frequent trigrams per language with a rank weight (``size`` for the first).

    Trigrams are counted as they are cut: of them there are few, while distinct words grow with the texts. No row is made of an
    occurrence; each Arrow batch of texts leaves its counts.
    """
    spaced = F.regexp_replace(F.lower(F.col(body)), r"[^\p{L}]+", "_")
    texts = samples.filter(F.col(body).isNotNull()).select(F.col(language).cast("string").alias("language"), spaced.alias("_body"))
    counts = texts.mapInArrow(_count_grams, "language string, gram string, n bigint")
    totals = counts.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    ranked = top_per_key(totals, ["language"], [F.desc("n"), "gram"], size, name="rank")
    return ranked.select("language", "gram", (F.lit(size + 1) - F.col("rank")).cast("long").alias("weight"))


def detect(df: DataFrame, key: str, title: str, profiles: DataFrame, least_known: float = 0.0, least_margin: float = 0.0) -> DataFrame:
    """(key, detected): language with the highest profile weight; rows without any hit are absent.

    With ``least_known`` or ``least_margin`` the set of languages is open: a row is absent, too, when less than that share of its
    trigrams is in the profile of the best language, or when the best score is less than that share ahead of the second.
    """
    # Stored, the profiles have a known size: as a small table they meet the trigrams where those are cut, and a title leaves its task
    # as one sum a language.
    words = _words(df.select(key, F.trim(title).alias("_title")), F.col("_title")).select(key, "word")
    scored = _trigrams(words).join(cut_lineage(profiles), "gram").groupBy(key, "language").agg(
        F.sum(F.col("weight")).alias("score"), F.count("*").alias("known")
    )
    order = [F.desc("score"), "language"]
    if not least_known and not least_margin:
        return top_per_key(scored, [key], order, 1).select(key, F.col("language").alias("detected"))
    ranked = top_per_key(scored, [key], order, 2, "_rank")
    best = ranked.groupBy(key).agg(
        F.min_by("language", "_rank").alias("detected"), F.min_by("known", "_rank").alias("known"), F.max("score").alias("score"),
        F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("score"))), F.lit(0)).alias("second"),
    )
    # A word has as many trigrams as letters.
    sizes = words.groupBy(key).agg(F.sum(F.length("word")).alias("grams"))
    known, margin = F.col("known") / F.col("grams"), (F.col("score") - F.col("second")) / F.col("score")
    return best.join(sizes, key).filter((known >= least_known) & (margin >= least_margin)).select(key, "detected")


def filter_by_language(
    df: DataFrame, key: str, title: str, profiles: DataFrame, allowed: Column | None = None, least_known: float = 0.0, least_margin: float = 0.0
) -> DataFrame:
    """Keeps rows with no language list, a short title, an undetected or an allowed language.

    ``least_known`` and ``least_margin`` as in ``detect``: with them titles in a language without a profile are undetected, and so kept.
    """
    if allowed is None:
        allowed = F.array(*[F.lit(code) for code in settings.DEFAULT_LANGUAGES])
    short = F.length(F.trim(F.coalesce(F.col(title), F.lit("")))) < settings.MIN_LANGUAGE_TITLE_CHARS
    free = F.coalesce(F.size(allowed), F.lit(0)) <= 0
    judged = detect(df.filter(~short & ~free), key, title, profiles, least_known, least_margin)
    return df.join(judged, key, "left").filter(
        short | free | F.col("detected").isNull() | F.array_contains(allowed, F.col("detected"))
    )
