import math

import numpy as np

from newsloom.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, x int, rank string, score int, tile int"


def test_strassen_is_exact():
    random = np.random.default_rng(3)
    for m, k, n in ((1, 1, 1), (7, 5, 9), (33, 65, 40), (128, 64, 129), (5, 0, 3), (0, 4, 4)):
        a, b = random.integers(-(2**20), 2**20, (m, k)), random.integers(-(2**20), 2**20, (k, n))
        want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n))
        for leaf in (1, 4, 32):
            assert (hn.strassen(a, b, leaf) == want).all()
    # What overflows on the way wraps back.
    big = np.full((8, 8), 2**30)
    assert (hn.strassen(big, np.eye(8, dtype=np.int64) * 2**30, 1) == 2**60).all()


def test_heaps_keep_the_best_of_all_tiles():
    random = np.random.default_rng(5)
    for k in (1, 3, 8):
        scores, allowed = random.integers(-3, 4, (6, 40)), random.random((6, 40)) < 0.4
        ids = random.permutation(40)
        heaps = hn.Heaps(6, k)
        for at in np.split(np.arange(40), [3, 4, 20]):
            at = at[np.argsort(ids[at])]
            heaps.push(slice(0, 6), scores[:, at], ids[at], allowed[:, at])
        for i in range(6):
            want = sorted((-s, j) for s, j, a in zip(scores[i], ids, allowed[i]) if a)[:k]
            got = [(-s, j) for s, j, f in zip(heaps.scores[i], heaps.ids[i], heaps.filled[i]) if f]
            assert got == want


def brute(rows, anchor, k=5, percent=80):
    kept = []
    for vec_id, e, label, *_ in rows:
        if vec_id is not None and label is not None and e is not None and all(c is not None and math.isfinite(c) for c in e):
            kept.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in e], label))
    out = []
    for i, (a, x, label) in enumerate(kept):
        if not anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), b, other == label) for j, (b, y, other) in enumerate(kept) if j != i and len(y) == len(x)]
        for ps, positive, _ in sorted(s for s in scored if s[2])[:k]:
            window = sorted(s for s in scored if not s[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:k] if percent == 80 else None
            out += [(a, positive, rank, b, -ps, -ns) for rank, (ns, b, _) in enumerate(window, 1)]
    return sorted(out)


def ran(spark, rows, **more):
    df = spark.createDataFrame([(*r, "k", 1, "r", 2, 3) for r in rows], SCHEMA)
    from pyspark.sql import functions as F

    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()))


def vectors(n, size, labels, seed):
    random = np.random.default_rng(seed)
    middle = random.normal(size=size)
    return [(i, [float(np.float32(c)) for c in middle + random.normal(size=size) / 2], int(random.integers(labels))) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rows = vectors(300, 6, 3, 1) + [(1000 + i, e, label) for i, e, label in vectors(60, 4, 2, 2)]
    rows += [(2000 + 10 * i, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 1) for i in range(30)]  # ties
    rows += [(2500 + i, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 2) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 1), (3010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3020, [nan] * 6, 1), (3030, [inf] + [0.0] * 5, 1), (3040, [1.0] * 6, None), (None, [1.0] * 6, 1), (3050, [], 1), (3060, [], 1), (3070, [], 2), (3080, [0.0] * 6, 1)]
    rows += [(10, [0.5] * 6, 1), (10, [0.5] * 6, 1), (10, [0.4] * 6, 2)]  # repeated ids
    want = brute(rows, lambda a: a % 10 == 0)
    assert want and ran(spark, rows) == want
    monkeypatch.setattr(hn, "CELL_ROWS", 50)
    monkeypatch.setattr(hn, "ANCHOR_BYTES", 1000)
    assert ran(spark, rows) == want


def test_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHOR_BYTES", 1 << 24)
    rows = vectors(3500, 3, 4, 4)
    assert ran(spark, rows) == brute(rows, lambda a: a % 10 == 0)


def test_few_rows(spark):
    assert ran(spark, []) == []
    assert ran(spark, [(10, [1.0], 1)]) == []
    assert ran(spark, [(10, [1.0], 1), (11, [1.0], 1)]) == []
    assert ran(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [1.0], 2)]) == [(10, 11, 1, 12, 65536, 65536)]
