import re
from collections import defaultdict

from newsloom.llm.mixing import mix

SCHEMA = "doc_id bigint, text string, source string, size int, number int, rate string"


def targets(sizes):
    """Shares by weight, with what is above a cap shared again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, got, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        got = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and got[s] > 3 * sizes[s]}
        if not over:
            return got
        full |= over


def test_against_brute_force(spark):
    rows = []
    for s, (source, docs) in enumerate({"b": 200, "a": 60, "B": 3, "é": 40, None: 30, "tiny": 1, "void": 2}.items()):
        rows += [(1000 * s + i, None if source == "void" else "w \t" * (1 + (i * 7919 + s) % (90 if source != "tiny" else 2)), source) for i in range(docs)]
    rows += [(5, "twice the same", "a"), (5, "twice the same", "a"), (None, "no id here", "b"), (7, "\x0b \n", "b"), (8, "x y z", "a")]
    df = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], SCHEMA)
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for doc_id, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expect = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - expect[r.source]) < 1e-6 * max(1, expect[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for source, words in taken.items():
        assert abs(words - expect[source]) <= most[source], source
    again = mix(df.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.copies) for r in rs)
    assert key(again) == key(got)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in mix(spark.createDataFrame([(1, None, None, 1, 1, "")], SCHEMA)).select("size", "target", "taken").collect()] == [(0, 0.0, 0)]
