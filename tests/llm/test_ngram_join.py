import random
import re

import numpy as np
import pytest

from newsloom.llm import ngram_join as N
from newsloom.llm.components import components

SCHEMA = "doc_id bigint, text string, n bigint, a string, keys string"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    above = {d: d for d, _ in rows if d is not None}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, (x, _) in enumerate(rows):
        for j, (y, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if x is not None and y is not None and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(x), top(y)))
                above[b] = a
    return sorted((str(d), len(s), str(None if d is None else top(d))) for (d, _), s in zip(rows, sets))


def corpus(seed, groups):
    """Groups of edited copies, passages that many texts share, and texts of their own."""
    rand = random.Random(seed)
    word = lambda: f"w{rand.randint(0, 4000)}"
    passage, rows = [word() for _ in range(40)], []
    for size, edits in groups:
        base = [word() for _ in range(rand.randint(20, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rand.randint(0, edits)):
                copy[rand.randrange(len(copy))] = word()
            rows.append(copy)
    for _ in range(60):
        rows.append([word() for _ in range(rand.randint(5, 60))] + passage + [word() for _ in range(rand.randint(0, 60))])
    rand.shuffle(rows)
    return [(10 * k, " ".join(r)) for k, r in enumerate(rows)]


EDGES = [
    (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one"), (7, "a b c d e"), (8, "A b  c d e"), (9, "a b c d e f"),
    (11, "É b c d e"), (12, "é b c d e"), (None, "a b c d e"), (7, "a b c d e"), (13, "x " * 3000), (14, "x x x x x"), (15, "a b c d e"),
]


@pytest.mark.parametrize("block", [N.BLOCK_SHINGLES, 300])
def test_against_all_pairs(spark, block):
    rows = corpus(block, [(2, 1), (40, 6), (5, 2), (60, 3), (3, 9), (12, 4)]) + EDGES
    df = spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA).repartition(5)
    got = N.jaccard_components(df, block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == brute(rows)


def test_repeated_rows_count_once(spark):
    rows = corpus(5, [(2, 1), (8, 6), (3, 9)])
    rows = rows * 2 + [(d, t.upper()) for d, t in rows[:20]]
    df = spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA).repartition(5)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in N.jaccard_components(df).collect()) == brute(rows)


def test_empty(spark):
    assert N.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingles_of_segments(monkeypatch):
    text = " ".join(f"Word{i * i % 977}" for i in range(3000)) + "  " + "y" * 500
    whole = N.shingles(text)
    monkeypatch.setattr(N, "SEGMENT_BYTES", 64)
    assert N.shingles(text).tolist() == whole.tolist()
    assert len(whole) == len(grams(text))


def test_divide_skip():
    sets = [np.array(x) for x in ([1, 2, 3, 9], [2, 3, 4], [7, 8, 9])]
    # The query is {1, 2, 3, 9}: 1 and 2 are merged, 3 and 9 probed.
    found = dict(N.divide_skip([[0], [0, 1]], np.array([3, 9]), lambda p: 2, sets))
    assert found == {0: 4, 1: 2}
    assert dict(N.divide_skip([[0], [0, 1]], np.array([3, 9]), lambda p: 3, sets)) == {0: 4}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
