"""What is ruled out before two titles are scored, and the search that scores them."""

import random

import numpy as np
import pytest

from newsloom.functions import fuzzy
from newsloom.functions.fuzzy import Peer, Tile

SYLLABLES = ["an", "ble", "wh", "th", "re", "in", "en", "er", "st", "on", "ly", "ti"]


def _titles(n, seed, least=12, most=40, words=4000):
    """Different titles of one invented language: few letters, so that letter counts tell little."""
    rng = random.Random(seed)
    known = ["".join(rng.choices(SYLLABLES, k=rng.randint(2, 5))) for _ in range(words)]
    return ["en to tre fire fem " + " ".join(rng.choices(known, k=rng.randint(least, most))) for _ in range(n)]


def _tile(titles, start=0):
    return Tile([Peer.of(t, 0, "a.dk", False) for t in titles], list(range(start, start + len(titles))))


def test_few_pairs_of_different_titles_are_scored(monkeypatch):
    """Letters alike are no reason to score a pair: the shared tokens are known, and they are few."""
    a, b = _tile(_titles(300, 1)), _tile(_titles(300, 2), 300)
    seen, plain = [0], fuzzy.score_tokens
    monkeypatch.setattr(fuzzy, "score_tokens", lambda *x: seen.__setitem__(0, seen[0] + 1) or plain(*x))
    list(fuzzy.links(a, b, 92, 0, 8))
    assert seen[0] < 300 * 300 / 30


@pytest.mark.parametrize("columns, step", [(2048, 1 << 21), (3, 1 << 8)])
def test_shared_letters_against_sets(columns, step, monkeypatch):
    monkeypatch.setattr(fuzzy, "_COLUMNS", columns)
    monkeypatch.setattr(fuzzy, "_STEP", step)
    a, b = _tile(_titles(40, 3, 1, 30, 50)), _tile(_titles(60, 4, 1, 30, 50) + ["helt andet"])
    got = fuzzy._shared(fuzzy._Tokens(a), len(a), fuzzy._Tokens(b), len(b))
    want = [[sum(len(t) + 1 for t in p.tokens & q.tokens) for q in b.peers] for p in a.peers]
    assert np.array_equal(got, want)


@pytest.mark.parametrize("threshold", [50, 80, 92])
def test_no_pair_is_ruled_out_that_reaches_the_threshold(threshold):
    """Parts of titles, titles with letters changed all over, and long runs of one letter."""
    rng = random.Random(threshold)
    titles = _titles(30, 5)
    for t in titles[:30]:
        words = t.split()
        titles.append(" ".join(words[: rng.randint(5, len(words))] + rng.choices(words, k=2)))
        titles.append(" ".join(w if i < 5 or rng.random() < 0.5 else w[:-1] + rng.choice("xyz") for i, w in enumerate(words)))
        titles.append(" ".join(words + ["e" * rng.choice([3, 300, 600])]))
    a, b = _tile(titles[:60]), _tile(titles[60:], 60)
    for x, y in ((a, b), (a, a)):
        possible = {(i, j) for m, n in fuzzy._possible(x, y, threshold, 0) for i, j in zip(m.tolist(), n.tolist())}
        alike = {(i, j) for i, p in enumerate(x.peers) for j, q in enumerate(y.peers) if fuzzy.score_tokens(p.tokens, q.tokens) >= threshold}
        assert alike - possible == set() != alike


def test_the_search_ends_early_only_below_what_is_asked():
    rng = random.Random(6)
    for _ in range(1500):
        a = "".join(rng.choices("abcd ", k=rng.randint(0, 220)))
        b = "".join(ch for ch in a if rng.random() > 0.2) + "".join(rng.choices("abcd ", k=rng.randint(0, 60)))
        whole = fuzzy._common_subsequence(a, b)
        for least in (1, whole - 1, whole, whole + 1, whole + 20):
            found = fuzzy._common_subsequence(a, b, max(0, least))
            assert found == whole if whole >= least else found < least


def test_new_titles_of_a_stream_are_scored_with_few_known_ones(monkeypatch):
    """A batch of a key meets its stored stories by the same bounds."""
    known = [Peer.of(t, 0, "a.dk", False) for t in _titles(300, 7)]
    batch = _tile(_titles(200, 8) + [p.text + " s" for p in known[::30]], 300)
    seen, plain = [0], fuzzy.score_tokens
    monkeypatch.setattr(fuzzy, "score_tokens", lambda *x: seen.__setitem__(0, seen[0] + 1) or plain(*x))
    kept = fuzzy.first_kept(batch, 92, 0, known)
    assert max(kept) < 200 < seen[0] < 300 * 210 / 25
