"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text is its letters in lower case, with one blank for any run of other characters. Every run of two to
four of these characters is hashed to a bucket; each bucket has an embedding, a text is the mean of the
embeddings of its runs, and a linear softmax turns the mean into languages. Embeddings and softmax
are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows. Part of
the sample is held back to fit a temperature, so that scores are calibrated, and to set the score
below which a text is rejected. Every sampled text counts twice, as a whole and as a short piece from its
middle, because short texts are less certain.

As everything after the mean is linear, prediction adds up one row of (embedding x softmax) per run.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import bounded_batches, query, table
from newsloom.operators.ordered import top_per_key

LENGTHS = (2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
#: Labelled rows of each language that are trained on; the bound of the only sample taken.
SAMPLE_PER_LANGUAGE = 400
#: Characters of the short piece of a sampled text.
PIECE = 24
#: Of the sample, one text in so many calibrates.
HELD_BACK = 4
#: Share of well-known calibration texts that may fall under the rejection score.
LOST = 0.001
#: No text that scores this much is rejected.
SURE = 0.35
UNKNOWN = "und"
#: Bound of every weight.
LARGEST = 10.0
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
PREDICTION = "struct<lang: string, score: double, rejected: boolean>"


@functools.cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 32 for what is no letter."""
    lower = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        if (c := chr(code)).isalpha():
            lower[code] = ord(low) if len(low := c.lower()) == 1 else code
    return lower


def subwords(text: str | None) -> np.ndarray:
    """Buckets of all runs of the text; none if it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = codes != 32
    if not letter.any():
        return np.zeros(0, np.int64)
    kept = codes[letter | np.concatenate([[True], letter[:-1]])]
    blank = np.full(1, 32, np.uint32)
    kept = np.concatenate([blank, kept, blank]) if kept[-1] != 32 else np.concatenate([blank, kept])
    runs = []
    for n in LENGTHS:
        if len(kept) >= n:
            mixed = np.full(len(kept) - n + 1, n, np.uint32)
            for i in range(n):
                mixed = (mixed ^ kept[i : len(kept) - n + 1 + i]) * _MIX[i]
                mixed ^= mixed >> np.uint32(15)
            runs.append(mixed & np.uint32(BUCKETS - 1))
    return np.concatenate(runs).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (bucket, language)
    bias: np.ndarray
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        found = subwords(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0, True
        scores = _softmax(self.table[found].mean(0, dtype=np.float64) + self.bias)
        best = int(scores.argmax())
        return self.languages[best], float(scores[best]), bool(scores[best] < self.least)


def _softmax(values: np.ndarray) -> np.ndarray:
    raised = np.exp(values - values.max(-1, keepdims=True))
    return raised / raised.sum(-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 4.0, seed: int = 7) -> Model:
    """A model of (language, buckets, counts) rows, two in a row for one text. Every ``HELD_BACK``-th text calibrates."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    place = {lang: i for i, lang in enumerate(languages)}
    samples = [(i // 2 % HELD_BACK, (place[lang], at, counts / counts.sum())) for i, (lang, at, counts) in enumerate(rows) if len(at)]
    calibrate, fit = [s for part, s in samples if not part], [s for part, s in samples if part]
    random = np.random.default_rng(seed)
    embedded = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    linear, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    total = max(1, epochs * len(fit))
    for step, i in enumerate(np.concatenate([random.permutation(len(fit)) for _ in range(epochs)]).astype(int)):
        truth, at, weights = fit[i]
        pace = rate * (1 - step / total)
        mean = weights @ embedded[at]
        error = _softmax(mean @ linear + bias)
        error[truth] -= 1
        back = linear @ error
        # Weights are kept in bounds, so labels that cannot be learned do not drive them apart.
        linear = np.clip(linear - pace * np.outer(mean, error), -LARGEST, LARGEST)
        bias = np.clip(bias - 0.01 * pace * error, -LARGEST, LARGEST)
        embedded[at] = np.clip(embedded[at] - pace * weights[:, None] * back, -LARGEST, LARGEST)
    scored = embedded @ linear
    heat, least = _calibrate(calibrate, scored, bias)
    return Model(languages, (scored / heat).astype(np.float32), bias / heat, least)


def _calibrate(samples: list, scored: np.ndarray, bias: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss on held-back rows, and the score under which a text is rejected."""
    if not samples:
        return 1.0, 0.0
    logits = np.array([weights @ scored[at] + bias for _, at, weights in samples])
    truth = np.array([t for t, _, _ in samples])
    heats = np.geomspace(1, 20, 40)
    loss = [-np.log(np.maximum(_softmax(logits / h)[np.arange(len(truth)), truth], 1e-12)).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    scores = _softmax(logits / heat)
    right = scores.max(1)[scores.argmax(1) == truth]
    return heat, float(min(SURE, np.quantile(right, LOST))) if len(right) else 0.0


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on at most ``per_language`` rows of each language, taken by a hash of doc_id over all rows.

    Only labelled rows with an id and a text, outside ``held_out``, are used. Tasks turn the texts into bucket counts, so the
    driver gets at most ``BUCKETS`` numbers a row.
    """
    known = bounded_batches(docs).select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return train([])
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # Few more than needed of each language pass the hash; the sample is then cut to size.
    bound = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(2**30 * min(1.0, 1.5 * per_language / r["count"])) + 1))])
    drawn = top_per_key(known.withColumn("number", number).filter(F.col("number") < bound[F.col("lang")]), ["lang"], ["number", "doc_id", "text"], per_language)

    @F.arrow_udf("array<struct<at: binary, counts: binary>>")
    def bags(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            middle = len(text) // 2
            pairs = [np.unique(subwords(t), return_counts=True) for t in (text, text[max(0, middle - PIECE // 2) : middle + PIECE // 2])]
            rows.append([{"at": at.astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes()} for at, counts in pairs])
        return pa.array(rows, pa.list_(pa.struct({"at": pa.binary(), "counts": pa.binary()})))

    bagged = drawn.withColumn("bags", bags("text")).orderBy("number", "doc_id", "lang").select("lang", "bags").collect()
    return train([(r["lang"], np.frombuffer(b["at"], np.int32), np.frombuffer(b["counts"], np.int32)) for r in bagged for b in r["bags"]])


def predicted(text: Column, model: Model) -> Column:
    """Struct column of language, score and rejection; ``und``, 0 and rejected for a text that is null or has no letter."""

    @F.arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
        return pa.StructArray.from_arrays(columns, ["lang", "score", "rejected"])

    return predict(text)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang; other columns are ignored): doc_id, held_out, lang_pred, score, rejected.

    Without a model one is fitted to ``docs``. A null doc_id is not held out (false) and not learned from. Without any
    labelled row every text is ``und``. Repeated rows are predicted alike. An empty table gives no rows.
    """
    model = model or fit(docs)
    found = docs.select("doc_id", predicted(F.col("text"), model).alias("found"))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected"
    )


@query("op8_language_id")
def op8_language_id(spark, folder):
    return identify(table(spark, folder, "documents", "doc_id", "text", "lang"))
