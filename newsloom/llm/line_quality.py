"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. What speaks for either is a linear function of the line's own features and of those of the
lines before and after it; a chain of transition weights makes neighbours agree. Forward and backward messages are log odds
(good against bad), one number per line, so a pass over a document is linear in its lines. A document's score is the
mean of its lines' marginals for good, weighted by their lengths.

Only documents are labelled, so in fitting every line has its document's label; the transition weights, which no such
document contradicts, are held in bounds. Fitting is stochastic gradient ascent of the conditional likelihood in numpy, on a
bounded sample of labelled documents.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import bounded_batches, query, table
from newsloom.llm.units import steps
from newsloom.operators.ordered import top_per_key

#: Labelled documents of each label that are fitted to; with the next, the bound of the only sample taken.
SAMPLE_PER_LABEL = 1200
#: A document of more lines is not fitted to (it is scored like any other).
SAMPLE_LINES = 4096
#: Least score of a document that is predicted good.
LEAST = 0.3
#: Bound of the weights of transitions.
STICKY = 2.0
_KINDS = 8
_NEWLINE, _SPACE, _LOWER, _UPPER, _LETTER, _DIGIT, _MARK, _SYMBOL = range(_KINDS)
#: Marks of ordinary sentences.
_MARKS = frozenset(".,;:?'\"()-–—’“”«»¿¡")
_OWN = 16
FEATURES = 3 * _OWN
#: Characters looked at together.
_STEP = 1 << 20


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of every code point."""
    kinds = np.full(0x110000, _SYMBOL, np.uint8)
    first = {"Ll": _LOWER, "Lu": _UPPER, "Lt": _UPPER, "Lm": _LETTER, "Lo": _LETTER, "Mn": _LETTER, "Mc": _LETTER, "Nd": _DIGIT}
    for code in range(0x110000):
        c = chr(code)
        kinds[code] = _SPACE if c.isspace() else _MARK if c in _MARKS else first.get(unicodedata.category(c), _SYMBOL)
    kinds[ord("\n")] = _NEWLINE
    return kinds


def _words(line: str) -> tuple[int, int, int]:
    """Words, different words, words equal to the one before."""
    words = line.split()
    return len(words), len(set(words)), sum(map(eq, words, words[1:]))


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, and of all their lines the lengths and the features (own, of the line before, of the line after)."""
    lines = [text.split("\n") for text in texts]
    ends = np.cumsum([len(x) for x in lines])
    total = int(ends[-1]) if len(ends) else 0
    # Every text ends with a newline here, so newlines number the lines of all texts.
    joined, counts, done = "".join(f"{text}\n" for text in texts), np.zeros((total, _KINDS)), 0
    for at in range(0, len(joined), _STEP):
        kinds = _kinds()[np.frombuffer(joined[at : at + _STEP].encode("utf-32-le", "surrogatepass"), np.uint32)]
        new = kinds == _NEWLINE
        line = np.cumsum(new) - new
        here = np.bincount(line * _KINDS + kinds)
        here = np.pad(here, (0, -len(here) % _KINDS)).reshape(-1, _KINDS)
        counts[done : done + len(here)] += here
        done += int(new.sum())
    lengths = counts.sum(1) - counts[:, _NEWLINE]
    words, different, again = np.array([_words(x) for part in lines for x in part], float).reshape(total, 3).T
    letters = counts[:, _LOWER] + counts[:, _UPPER] + counts[:, _LETTER]
    share = lambda part, whole: part / np.maximum(whole, 1)
    repeated = [float(seen[x] > 1) for part, seen in zip(lines, map(_seen, lines)) for x in part]
    own = np.column_stack([
        np.ones(total), lengths == 0, np.log1p(lengths) / 5, np.log1p(words) / 5, share(letters, lengths), share(counts[:, _UPPER], letters),
        share(counts[:, _DIGIT], lengths), share(counts[:, _MARK], lengths), 4 * share(counts[:, _SYMBOL], lengths), np.minimum(share(counts[:, _SYMBOL], words), 2),
        share(counts[:, _SPACE], lengths), share(different, words), share(again, words), share(lengths - counts[:, _SPACE], words) / 10,
        repeated, share(counts[:, _UPPER], letters) > 0.5,
    ]).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    if total:
        before[np.concatenate([[0], ends[:-1]])] = 0
        after[ends - 1] = 0
    return np.array([len(x) for x in lines], np.int64), lengths, np.hstack([own, before, after])


def _seen(lines: list[str]) -> dict[str, int]:
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    return seen


@dataclass
class Chain:
    """Weights of the features, and of good and bad lines that follow good and bad ones (rows: the line before)."""

    weights: np.ndarray
    steps: np.ndarray

    def messages(self, odds: list[float]) -> tuple[list[float], list[float]]:
        """Log odds of each line from what stands up to it, and from what stands after it."""
        (gg, gb), (bg, bb) = np.exp(self.steps).tolist()

        def passed(x: float, a: float, b: float, c: float, d: float) -> float:
            # log((a e^x + b) / (c e^x + d)), the same to double precision beyond the bound.
            raised = math.exp(max(-200.0, min(200.0, x)))
            return math.log((a * raised + b) / (c * raised + d))

        ahead, x = [], 0.0
        for i, e in enumerate(odds):
            x = e + (passed(x, gg, bg, gb, bb) if i else 0.0)
            ahead.append(x)
        back, x = [0.0] * len(odds), 0.0
        for i in range(len(odds) - 2, -1, -1):
            x = passed(odds[i + 1] + x, gg, gb, bg, bb)
            back[i] = x
        return ahead, back

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability that each line of one document is good."""
        ahead, back = self.messages((features @ self.weights).tolist())
        return _logistic(np.array(ahead) + np.array(back))

    def score(self, lengths: np.ndarray, features: np.ndarray) -> float:
        weights = lengths if lengths.any() else np.ones(len(lengths))
        return float(np.clip(np.average(self.marginals(features), weights=weights), 0.0, 1.0))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _gradient(chain: Chain, features: np.ndarray, good: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood that all lines of one document are good (or bad)."""
    odds = features @ chain.weights
    ahead, back = (np.array(x) for x in chain.messages(odds.tolist()))
    apart = float(good) - _logistic(ahead + back)
    pairs = np.zeros((2, 2))
    if len(odds) > 1:
        left, right = ahead[:-1], (odds + back)[1:]
        zero = np.zeros_like(left)
        logs = np.stack([left + right, left, right, zero]) + chain.steps.reshape(4, 1)
        raised = np.exp(logs - logs.max(0))
        pairs -= (raised / raised.sum(0)).sum(1).reshape(2, 2)
        pairs[0 if good else 1, 0 if good else 1] += len(left)
    return apart @ features, pairs


def train(rows: list[tuple[bool, np.ndarray]], passes: int = 900, batch: int = 32, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Chain:
    """A chain fitted to (label, features of its lines) of documents, each document counting alike, in ``passes`` batches or a few more."""
    chain = Chain(np.zeros(FEATURES), np.zeros((2, 2)))
    random = np.random.default_rng(seed)
    size = FEATURES + 4
    first, second, step = np.zeros(size), np.zeros(size), 0
    while rows and step < passes:
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            total = np.zeros(size)
            for i in order[start : start + batch]:
                good, features = rows[i]
                weights, pairs = _gradient(chain, features, good)
                total += np.concatenate([weights, pairs.reshape(4)]) / len(features)
            now = np.concatenate([chain.weights, chain.steps.reshape(4)])
            slope = total / len(order[start : start + batch]) - decay * now
            step += 1
            # Steps scaled by the running size of each slope.
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            now += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            chain = Chain(np.clip(now[:FEATURES], -50, 50), np.clip(now[FEATURES:].reshape(2, 2), -STICKY, STICKY))
    return chain


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Chain:
    """Fit to at most ``per_label`` documents of each quality, taken by a hash of doc_id over all labels outside ``held_out``.

    A doc_id labelled both ways, or with anything but 0 and 1, is not learned from; of documents that share an id the text that is least
    counts. Tasks turn texts into features, so the driver gets at most ``per_label`` x ``SAMPLE_LINES`` lines of each label.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.filter((F.col("quality") == F.col("most")) & F.col("quality").isin(0, 1)).drop("most")
    counts = known.groupBy("quality").count().collect()
    if not counts:
        return train([])
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # Few more than needed of each label pass the hash, so they are small enough to be sent to every task.
    bound = F.create_map(*[x for r in counts for x in (F.lit(r["quality"]), F.lit(int(2**30 * min(1.0, 1.5 * per_label / r["count"])) + 1))])
    drawn = known.withColumn("number", number).filter(F.col("number") < bound[F.col("quality")])
    texts = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality", "number").agg(F.min("text").alias("text"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    taken = top_per_key(texts.filter(F.col("text").isNotNull() & (lines <= SAMPLE_LINES)), ["quality"], ["number", "doc_id"], per_label)

    @F.arrow_udf("binary")
    def featured(texts: pa.Array) -> pa.Array:
        return pa.array([line_features([t])[2].tobytes() for t in texts.to_pylist()], pa.binary())

    rows = taken.select("number", "doc_id", "quality", featured("text").alias("features")).orderBy("number", "doc_id").collect()
    return train([(r["quality"] == 1, np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES)) for r in rows])


def scored(text: Column, chain: Chain) -> Column:
    """Score of every text; null is scored as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = []
        for _, part in steps(texts):
            numbers, lengths, features = line_features(part)
            start = 0
            for n in numbers.tolist():
                found.append(chain.score(lengths[start : start + n], features[start : start + n]))
                start += n
        return pa.array(found, pa.float64())

    return score(text)


def line_quality(docs: DataFrame, labels: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, held_out, score, predicted.

    Without a chain one is fitted to ``docs`` and ``labels`` (doc_id, quality). A null text is scored like an empty one: one line
    without characters. A text of empty lines only is the plain mean of them. A null doc_id is not held out (false) and not
    learned from. Without any label every score is 0.5. Repeated rows score alike. An empty table gives no rows.
    """
    chain = chain or fit(docs, labels)
    found = bounded_batches(docs).select("doc_id", scored(F.col("text"), chain).alias("score"))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted")
    )


@query("op11_line_quality")
def op11_line_quality(spark, folder):
    return line_quality(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality"))
