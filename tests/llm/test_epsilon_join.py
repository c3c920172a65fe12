import numpy as np
import pytest

from newsloom.llm.epsilon_join import BLOCK_BYTES, near_embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int, size int, a string, links string"


def brute(rows, least=0.93):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and d is not None and lab is not None for d, v, lab in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                linked[i, j] = linked[j, i] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least
    result = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in np.flatnonzero(linked[todo.pop()]):
                if k not in seen:
                    seen.add(int(k))
                    todo.append(int(k))
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        component = min(ids) if ids else None
        result.append((str(rows[i][0]), int(linked[i].sum()), str(component), component is not None and component == rows[i][0]))
    return sorted(result)


@pytest.mark.parametrize("block_bytes", [BLOCK_BYTES, 1500])
def test_against_all_pairs(spark, block_bytes):
    rand, rows = np.random.default_rng(3), []
    centres = rand.normal(size=(12, 12))
    for i in range(420):
        rows.append((i, (centres[i % 12] + rand.normal(size=12) * 0.25).astype(np.float32).tolist(), i % 3))
    hot = rows[0][1]
    rows += [(1000 + i, hot, 0) for i in range(30)] + [(1100, [2 * x for x in hot], 0), (1101, hot, None), (1102, [0.0] * 12, 0), (1103, None, 0), (1104, [], 0)]
    rows += [(1105, [float("nan"), *hot[1:]], 0), (1106, [float("inf"), *hot[1:]], 0), (1107, [None, *hot[1:]], 0), (None, hot, 0), (1108, hot[:5], 0), (1109, hot[:5], 0), (1110, [3.0], 0), (1111, [-3.0], 0), (1112, [1.0], 0)]
    df = spark.createDataFrame([(*r, 1, "", "") for r in rows], SCHEMA)
    got = near_embeddings(df, block_bytes=block_bytes)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
