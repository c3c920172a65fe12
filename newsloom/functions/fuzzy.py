"""Token-set similarity, batched through Arrow.

The score of two normalised texts is 100 when one token set contains the other. Otherwise it is
the best Indel similarity (insertions and deletions only) among the shared tokens alone and the
shared tokens followed by either remainder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


#: Characters after which a subsequence search looks whether it can still succeed.
_LOOK = 48


def _common_subsequence(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``; any smaller number if it is less than ``least``."""
    if len(a) < len(b):
        a, b = b, a
    spare_a, spare_b = len(a) - least, len(b) - least
    if spare_b < 0:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for start in range(0, len(b), _LOOK):
        for ch in b[start : start + _LOOK]:
            hit = state & where.get(ch, 0)
            state = ((state + hit) | (state - hit)) & full
        # What is taken of b so far has met no more of a than that and the characters of a that may be left out.
        done = min(start + _LOOK, len(b))
        if least and done - (~state & full & ((1 << (done + spare_a)) - 1)).bit_count() > spare_b:
            return 0
    return (full & ~state).bit_count()


def token_set_ratio(left: str, right: str) -> float:
    return score_tokens(frozenset(left.split()), frozenset(right.split()))


def score_tokens(a: frozenset, b: frozenset, needed: float = 0.0) -> float:
    """Score of two token sets. With ``needed`` the result is only exact about reaching it, which
    saves the subsequence search where the cheap parts decide."""
    if not a or not b:
        return 0.0
    shared, only_a, only_b = a & b, " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if shared and (not only_a or not only_b):
        return 100.0
    core = sum(map(len, shared)) + len(shared) - 1 if shared else 0
    gap = 1 if core else 0
    len_a, len_b = core + gap + len(only_a), core + gap + len(only_b)
    best = 0.0
    if core:
        best = max(
            100.0 * (1 - (gap + len(only_a)) / (core + len_a)), 100.0 * (1 - (gap + len(only_b)) / (core + len_b))
        )
    at_most = 100.0 * (1 - abs(len(only_a) - len(only_b)) / (len_a + len_b))
    if needed and (best >= needed or at_most < needed):
        return best
    # The shared prefix is common to both strings, so only the remainders can differ.
    least = max(0, math.floor((len(only_a) + len(only_b) - (1 - needed / 100.0) * (len_a + len_b)) / 2 - 1e-6)) if needed else 0
    indel = len(only_a) + len(only_b) - 2 * _common_subsequence(only_a, only_b, least)
    return max(best, 100.0 * (1 - indel / (len_a + len_b)))


def similarity(left, right) -> Column:
    """Score of two normalised text columns."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return score(left, right)


class Peer(NamedTuple):
    """What a pair test needs from one row."""

    text: str
    tokens: frozenset
    at: int | None
    domain: str
    wrapper: bool

    @classmethod
    def of(cls, text, at, domain, wrapper) -> Peer:
        return cls(text, frozenset(text.split()), None if pd.isna(at) else int(at), domain, bool(wrapper))


def is_duplicate(a: Peer, b: Peer, threshold: float, window_us: int) -> bool:
    if a.domain != b.domain and not (a.wrapper or b.wrapper):
        return False
    if a.at is not None and b.at is not None and abs(a.at - b.at) > window_us:
        return False
    return a.text == b.text or score_tokens(a.tokens, b.tokens, threshold) >= threshold


_PAIR_SLOTS = 512
#: Pairs of texts that are scored without looking at their letters first.
_FEW = 64
#: Numbers held at a time while letters are compared.
_STEP = 1 << 21
#: Tokens compared in one product of matrices.
_COLUMNS = 2048
#: Rows that stay and meet all others at a time.
_LEADERS = 256


class Tile:
    """Peers with their ``seq``, as arrays that rule out most pairs of two tiles before any is scored.

    * The letters in shared tokens decide whether one side nearly lies inside the other. They are summed over hashed tokens.
    * For all other pairs the tokens outside the shared ones must be alike. One insertion or deletion changes the letter counts by
      one and the counts of adjacent letter pairs by at most three, so the lengths and both count differences bound the Indel distance.

    Tokens and letter pairs are counted by hash; collisions only make the bounds looser.
    """

    def __init__(self, peers: list[Peer], seqs: list[int]):
        order = sorted(range(len(seqs)), key=seqs.__getitem__)
        self.peers, self.seqs = [peers[i] for i in order], np.array([seqs[i] for i in order], np.int64)
        self._counts = self._words = None

    def __len__(self) -> int:
        return len(self.peers)

    def part(self, places) -> Tile:
        """The rows at ascending ``places``; what was counted of them is kept."""
        places = list(places)
        if len(places) == len(self):
            return self
        some = object.__new__(Tile)
        some.peers, some.seqs = [self.peers[i] for i in places], self.seqs[places]
        # Of a tile whose rows are few nothing is counted until it meets a larger one.
        few = len(self) <= 8
        self_counts = self._counts if self._counts is not None or few else self.counts()
        some._counts = self_counts and tuple(c[places] for c in self_counts)
        words = self._words if self._words is not None or few else self.words()
        some._words = words and [words[i] for i in places]
        return some

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letter counts, letter-pair counts and length of each token set joined by spaces."""
        if self._counts is None:
            letters, pairs, lengths = np.zeros((len(self), 128), np.int32), np.zeros((len(self), _PAIR_SLOTS), np.int32), np.zeros(len(self), np.int32)
            for i, peer in enumerate(self.peers):
                codes = np.frombuffer(f" {' '.join(peer.tokens)} ".encode("ascii", "replace"), np.uint8).astype(np.int64)
                letters[i] = np.bincount(codes[1:-1], minlength=128)
                pairs[i] = np.bincount((codes[:-1] * 31 + codes[1:]) & (_PAIR_SLOTS - 1), minlength=_PAIR_SLOTS)
                lengths[i] = len(codes) - 2
            # Counts are small but for long runs of one letter, and small numbers are compared faster.
            kind = next(k for k in (np.uint8, np.uint16, np.int32) if max(letters.max(initial=0), pairs.max(initial=0)) <= np.iinfo(k).max)
            self._counts = letters.astype(kind), pairs.astype(kind), lengths
        return self._counts

    def words(self) -> list[np.ndarray]:
        """Per row the hashes of its tokens, and their lengths with a space."""
        if self._words is None:
            self._words = [np.array([[hash(t) for t in p.tokens], [len(t) + 1 for t in p.tokens]], np.int64) for p in self.peers]
        return self._words

    def dates(self) -> tuple[np.ndarray, np.ndarray]:
        at = [p.at for p in self.peers]
        return np.array([a is not None for a in at]), np.array([a or 0 for a in at], np.int64)


class _Tokens:
    """The token occurrences of a tile, sorted by hash."""

    def __init__(self, tile: Tile):
        words = tile.words()
        hashes, sizes = np.concatenate(words, axis=1) if words else np.zeros((2, 0), np.int64)
        rows = np.repeat(np.arange(len(tile)), [w.shape[1] for w in words])
        order = np.argsort(hashes, kind="stable")
        self.rows, self.sizes = rows[order], sizes[order]
        self.hashes, self.start, self.count = np.unique(hashes[order], return_index=True, return_counts=True)


def _shared(a: _Tokens, len_a: int, b: _Tokens, len_b: int) -> np.ndarray:
    """Letters (and a space each) of the tokens that each row of ``a`` shares with each row of ``b``."""
    _, of_a, of_b = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    often = a.count[of_a] * b.count[of_b] > max(_FEW, len_a * len_b // 128)
    found = np.zeros((len_a, len_b), np.float32)

    def occurrences(x: _Tokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``which`` and in ``x`` of all occurrences of some tokens."""
        times = x.count[which]
        place = np.repeat(np.arange(len(which)), times)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(x.start[which], times)

    # Tokens of many rows are a product of matrices; of the others the pairs of rows are listed.
    for start in range(0, int(often.sum()), _COLUMNS):
        some_a, some_b = of_a[often][start : start + _COLUMNS], of_b[often][start : start + _COLUMNS]
        left, right = np.zeros((len_a, len(some_a)), np.float32), np.zeros((len_b, len(some_b)), np.float32)
        column, at = occurrences(a, some_a)
        left[a.rows[at], column] = a.sizes[at]
        column, at = occurrences(b, some_b)
        right[b.rows[at], column] = 1
        found += left @ right.T
    column, at = occurrences(a, of_a[~often])
    if len(column):
        # Of each occurrence in a, all in b.
        times, first = b.count[of_b[~often]][column], b.start[of_b[~often]][column]
        ends = np.cumsum(times)
        begin = 0
        while begin < len(ends):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + _STEP, "right")))
            n, total = times[begin:end], int(ends[end - 1] - done)
            inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            x = np.repeat(a.rows[at[begin:end]], n)
            y = b.rows[np.repeat(first[begin:end], n) + inner]
            found += np.bincount(x * len_b + y, np.repeat(a.sizes[at[begin:end]], n), len_a * len_b).reshape(len_a, len_b)
            begin = end
    return found


def _possible(a: Tile, b: Tile, threshold: float, window_us: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of the pairs that may reach the threshold, a few rows of ``a`` at a time."""
    if len(a) * len(b) <= _FEW:
        yield np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        return
    (letters, pairs, lengths), (letters_b, pairs_b, lengths_b) = a.counts(), b.counts()
    used = np.flatnonzero(letters.any(0) & letters_b.any(0))
    letters, letters_b = letters[:, used], letters_b[:, used]
    (dated, at), (dated_b, at_b) = a.dates(), b.dates()
    slack = (1 - threshold / 100.0) + 1e-9
    words_b = _Tokens(b)
    # As much must be shared for a row to lie nearly inside another.
    enough = lambda n: ((1 - slack) * (n + 1) + 2 * slack) / (1 + slack) - 0.01
    step = max(1, _STEP // len(b))
    for start in range(0, len(a), step):
        rows = slice(start, min(start + step, len(a)))
        mine, theirs = lengths[rows, None], lengths_b[None, :]
        close = ~dated[rows, None] | ~dated_b | (np.abs(at[rows, None] - at_b) <= window_us)
        some = a.part(range(rows.start, rows.stop))
        inside = _shared(_Tokens(some), len(some), words_b, len(b)) >= np.minimum(enough(mine), enough(theirs))
        i, j = np.nonzero(close & (inside | (np.abs(mine - theirs) <= slack * (mine + theirs))))
        inside = inside[i, j]
        i += start

        def differ(x: np.ndarray, y: np.ndarray, counts: np.ndarray, counts_b: np.ndarray) -> np.ndarray:
            """How far the counts of the pairs are apart."""
            both = lengths[x] + lengths_b[y]
            common = np.minimum(counts[x], counts_b[y]).sum(1, dtype=np.int32)
            return both - 2 * common.astype(np.int64)

        size = _STEP // _PAIR_SLOTS
        for part in range(0, len(i), size):
            x, y, sure = i[part : part + size], j[part : part + size], inside[part : part + size]
            room = slack * (lengths[x] + lengths_b[y])
            maybe = np.flatnonzero(~sure)
            maybe = maybe[differ(x[maybe], y[maybe], letters, letters_b) <= room[maybe]]
            # A token has one letter pair more than letters, and so has the row.
            maybe = maybe[differ(x[maybe], y[maybe], pairs, pairs_b) + 2 <= 3 * room[maybe]]
            kept = np.union1d(np.flatnonzero(sure), maybe)
            yield x[kept], y[kept]


def links(a: Tile, b: Tile, threshold: float, window_us: int, most: int) -> Iterator[tuple[int, int]]:
    """(seq, earlier seq) of the pairs of the two tiles (or of one with itself) that are duplicates: of every row the first ``most``."""
    found = []
    for i, j in _possible(a, b, threshold, window_us):
        x, y = a.seqs[i], b.seqs[j]
        keep = x < y if a is b else x != y
        i, j, x, y = i[keep], j[keep], x[keep], y[keep]
        found.append(np.column_stack([np.minimum(x, y), np.maximum(x, y), i, j]))
    pairs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    seen: dict[int, int] = {}
    for earlier, later, i, j in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        if seen.get(later, 0) < most and is_duplicate(a.peers[i], b.peers[j], threshold, window_us):
            seen[later] = seen.get(later, 0) + 1
            yield later, earlier


def _hits(rows: Tile, peers: Tile, threshold: float, window_us: int) -> set[int]:
    """Places of the rows that are a duplicate of one of the peers."""
    hit: set[int] = set()
    for i, j in _possible(rows, peers, threshold, window_us):
        for x, y in zip(i.tolist(), j.tolist()):
            if x not in hit and is_duplicate(rows.peers[x], peers.peers[y], threshold, window_us):
                hit.add(x)
    return hit


def resembling(rows: Tile, peers: Tile, threshold: float, window_us: int) -> set[int]:
    """Seqs of the rows that are a duplicate of one of the peers."""
    hit: set[int] = set()
    for part in range(0, len(peers), _LEADERS):
        # A row that is hit needs no other peer.
        open_ = [x for x in range(len(rows)) if x not in hit]
        few = peers.part(range(part, min(part + _LEADERS, len(peers))))
        hit.update(open_[x] for x in _hits(rows.part(open_), few, threshold, window_us))
    return {int(rows.seqs[x]) for x in hit}


def _in_turn(tile: Tile, threshold: float, window_us: int) -> list[int]:
    """Places left by the sequential rule, from all pairs of the tile."""
    earlier: dict[int, list[int]] = {}
    for i, j in _possible(tile, tile, threshold, window_us):
        for x, y in zip(i[i < j].tolist(), j[i < j].tolist()):
            earlier.setdefault(y, []).append(x)
    kept: set[int] = set()
    for y in range(len(tile)):
        if not any(x in kept and is_duplicate(tile.peers[x], tile.peers[y], threshold, window_us) for x in earlier.get(y, ())):
            kept.add(y)
    return sorted(kept)


def first_kept(tile: Tile, threshold: float, window_us: int, known: list[Peer] = ()) -> list[int]:
    """Places of the rows left by the sequential rule: each in turn stays unless it is a duplicate of one that stayed, or of ``known``.

    The first open rows are decided among themselves, and those that stay meet all later ones; what they hit is gone. The work is
    rows times rows that stay, not rows squared. Rows alike in all that is compared share the fate of the first of them.
    """
    alike: dict[tuple, int] = {}
    for i, p in enumerate(tile.peers):
        alike.setdefault((p.text, p.at, p.domain, p.wrapper), i)
    open_, kept, size = list(alike.values()), [], 8
    if known:
        above = resembling(tile.part(open_), Tile(list(known), [-1] * len(known)), threshold, window_us)
        open_ = [i for i in open_ if int(tile.seqs[i]) not in above]
    while open_:
        head, open_ = open_[:size], open_[size:]
        stay = [head[i] for i in _in_turn(tile.part(head), threshold, window_us)]
        kept += stay
        if open_:
            hit = _hits(tile.part(open_), tile.part(stay), threshold, window_us)
            open_ = [i for x, i in enumerate(open_) if x not in hit]
        size = min(2 * size, _LEADERS)
    return kept
