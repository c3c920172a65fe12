import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from newsloom.llm import exact_dedup as E

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b "), (6, "b"), (6, "b"), (None, "n"), (None, "n"), (None, "a"), (9, "x" * 150_000), (10, "x" * 150_000), (11, "x" * 149_999 + "y")]
SCHEMA = "doc_id bigint, text string, size int, kept string, collided int"


@given(st.binary(max_size=300), st.binary(max_size=300), st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_joined_is_the_print_of_the_whole(a, b, c):
    powers = E._powers(E.MODULI)
    of = lambda x: E.fingerprint_of(np.frombuffer(x, np.uint8), powers)
    assert E.joined(E.joined(of(a), of(b)), of(c)) == E.joined(of(a), E.joined(of(b), of(c))) == of(a + b + c)


def test_chunks_of_a_long_text():
    powers, data = E._powers(E.MODULI), bytes(range(256)) * 70
    whole = E.fingerprint_of(np.frombuffer(data, np.uint8), powers)
    direct = [0, 0]
    for byte in data:
        direct = [(h * base + byte + 1) % p for h, (p, base) in zip(direct, E.MODULI)]
    assert whole == (len(data), *direct)


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    result = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        result.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(map(str, result))


@pytest.mark.parametrize("moduli", [E.MODULI, ((3, 2), (5, 2))])
def test_cases(spark, moduli):
    """With tiny moduli unlike texts of one length collide, and the chunk comparison has to part them."""
    rows = ROWS + [(20 + i, f"t{i % 40:02d}") for i in range(80)]
    df = spark.createDataFrame([(*r, 1, "k", None) for r in rows], SCHEMA)
    got = E.exact_dedup(df, moduli, compared_bytes=1000)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == expected(rows)


def test_empty(spark):
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
