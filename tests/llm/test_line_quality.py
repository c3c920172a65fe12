import itertools
import zlib

import duckdb
import numpy as np

from newsloom.llm import catalog
from newsloom.llm.line_quality import FEATURES, Chain, _gradient, fit, line_features, line_quality, train

DOCS, LABELS = "doc_id bigint, text string, score string, quality int, number string", "doc_id bigint, quality int, text string, most int"


def labelings(chain, features):
    """Every labelling of the lines (True: good) with its weight, by the definition of the chain."""
    odds = features @ chain.weights
    for ys in itertools.product([True, False], repeat=len(odds)):
        total = sum(o for o, y in zip(odds, ys) if y) + sum(chain.steps[0 if a else 1, 0 if b else 1] for a, b in zip(ys, ys[1:]))
        yield ys, np.exp(total)


def random_chain(seed):
    random = np.random.default_rng(seed)
    return Chain(random.normal(size=FEATURES) / 3, random.normal(size=(2, 2))), random


def test_marginals_are_those_of_all_labelings():
    for seed, n in enumerate((1, 2, 5, 8)):
        chain, random = random_chain(seed)
        features = random.normal(size=(n, FEATURES))
        every = list(labelings(chain, features))
        total = sum(w for _, w in every)
        want = [sum(w for ys, w in every if ys[i]) / total for i in range(n)]
        assert np.allclose(chain.marginals(features), want, atol=1e-12)
        lengths = np.arange(n, dtype=float)
        assert np.isclose(chain.score(lengths, features), np.average(want, weights=lengths if n > 1 else None))


def test_gradient_is_that_of_the_likelihood():
    chain, random = random_chain(9)
    features = random.normal(size=(4, FEATURES))

    def likelihood(c, good):
        every = list(labelings(c, features))
        return np.log(next(w for ys, w in every if all(y == good for y in ys)) / sum(w for _, w in every))

    for good in (True, False):
        weights, steps = _gradient(chain, features, good)
        for k in (0, 7, FEATURES - 1):
            up, down = chain.weights.copy(), chain.weights.copy()
            up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
            assert np.isclose(weights[k], (likelihood(Chain(up, chain.steps), good) - likelihood(Chain(down, chain.steps), good)) / 2e-5, atol=1e-6)
        for i, j in itertools.product(range(2), repeat=2):
            up, down = chain.steps.copy(), chain.steps.copy()
            up[i, j], down[i, j] = up[i, j] + 1e-5, down[i, j] - 1e-5
            assert np.isclose(steps[i, j], (likelihood(Chain(chain.weights, up), good) - likelihood(Chain(chain.weights, down), good)) / 2e-5, atol=1e-6)


def test_extreme_odds():
    chain = Chain(np.full(FEATURES, 50.0), np.array([[2.0, -2.0], [-2.0, 2.0]]))
    assert np.isfinite(chain.marginals(np.array([[100.0] * FEATURES, [-100.0] * FEATURES] * 3))).all()


def test_features_do_not_depend_on_other_texts_or_steps():
    texts = ["One line.", "", "a a a\n\nB ### 12\n", "x" * 3_000_000 + "\nend"]
    numbers, lengths, features = line_features(texts)
    assert numbers.tolist() == [1, 1, 4, 2] and lengths.tolist() == [9, 0, 5, 0, 8, 0, 3_000_000, 3]
    alone = [line_features([t])[2] for t in texts]
    assert np.array_equal(features, np.concatenate(alone))
    assert line_features([])[2].shape == (0, FEATURES)


GOOD, BAD = "A plain line of words, as people write them.", "BUY!! NOW!! ### ### ###"


def corpus():
    docs = [(i, "\n".join([GOOD if i % 2 else BAD] * (1 + i % 4)) + f" {i}", "s", 9, "n") for i in range(200)]
    labels = [(i, i % 2, "t", 1) for i in range(150)]
    return docs, labels


def test_cases(spark):
    docs, labels = corpus()
    docs += [(300, None, "s", 9, "n"), (301, "", "s", 9, "n"), (302, "\n\n", "s", 9, "n"), (None, GOOD, "s", 9, "n"), (303, (GOOD + "\n") * 20_000, "s", 9, "n")]
    docs += [(304, BAD, "s", 9, "n")] * 2 + [(304, GOOD, "s", 9, "n")]
    labels += [(1, 1, "again", 0), (2, 1, "both ways", 0), (4, None, "null", 0), (6, 7, "neither", 0), (None, 1, "no id", 0), (9999, 1, "no document", 0), (300, 1, "null text", 0)]
    got = {}
    for r in line_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(docs)
    assert all(got[i][0].predicted == i % 2 and 0 <= got[i][0].score <= 1 for i in range(200))
    assert all(got[i][0].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert got[300][0].score == got[301][0].score and 0 <= got[302][0].score <= 1
    assert got[None][0].held_out is False and got[None][0].predicted == 1 and got[303][0].predicted == 1
    assert sorted(r.predicted for r in got[304]) == [0, 0, 1]


def test_without_labels_or_rows(spark):
    docs, labels = corpus()
    df, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    assert {r.score for r in line_quality(df, none).collect()} == {0.5}
    assert line_quality(df.limit(0), none).count() == line_quality(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    one_sided = line_quality(df, spark.createDataFrame([x for x in labels if x[1]], LABELS)).collect()
    assert len(one_sided) == len(docs) and all(0 <= r.score <= 1 for r in one_sided)


def test_learns_only_outside_held_out_rows(spark):
    docs, labels = corpus()
    out = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    flipped = [(i, 1 - q if (i, q, t, m) in out else q, t, m) for i, q, t, m in labels]
    df = spark.createDataFrame(docs, DOCS)
    a, b = (fit(df, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.steps, b.steps)
    assert np.array_equal(fit(df, spark.createDataFrame(out, LABELS)).weights, train([]).weights)


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    rows = catalog.queries()["op11_line_quality"](spark, folder).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
