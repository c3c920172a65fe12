"""Texts as runs that a byte-level pattern never joins, so that each distinct run is encoded once.

The patterns of byte-level tokenizers begin a new piece at every space that stands after or before a
character other than white space. Between such places the pieces, and so the ids, do not depend on what
surrounds them. A worker remembers the ids of runs in two generations: when the newer one is full it becomes
the older one, so memory is bounded and runs in use are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space followed by white space or the end: only then a space may be no place to cut.
_LOOSE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
#: Marks that never share a piece with a Latin letter before them.
_MARKS = ".,!?;:*#$%&|()[]{}"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
#: Bytes of text handled at a time.
STEP_BYTES = 1 << 21


class RunCoder:
    """Encodes texts by the distinct runs in them. ``encode_runs`` gives the ids of each run as bytes."""

    def __init__(self, encode_runs: Callable[[list[str]], list[bytes]], most: int = 300_000):
        self.encode_runs, self.most = encode_runs, most
        # By the run without the space it begins with.
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        self.spaced, self.older = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        heads, tails = [], []
        for text in texts:
            if _LOOSE.search(text):
                runs = _CUT.split(text)
                # Only a run's own first space may go; the first run keeps what it has.
                heads.append(runs[0])
                tails.append([r[1:] for r in runs[1:]])
            else:
                head, *tail = text.split(" ")
                heads.append(head)
                tails.append(tail)
        needed = set().union(*tails)
        if len(self.spaced) > self.most:
            self.spaced, self.older = {}, self.spaced
        # Only what is needed is walked through here, never what is remembered.
        missing = needed.difference(self.spaced)
        again = {run for run in missing if run in self.older}
        self.spaced.update({run: self.older[run] for run in again})
        missing -= again
        # A word and the marks behind it are coded apart, as words recur with other marks.
        ends = {}
        for run in missing:
            if run and run[-1] in _MARKS:
                body = run.rstrip(_MARKS)
                if body and _LATIN.match(body[-1]):
                    ends[run] = body
        bodies = missing.difference(ends).union(ends.values()).difference(self.spaced)
        marks = {run[len(body) :] for run, body in ends.items()}
        asked = [heads, [" " + b for b in bodies], list(marks)]
        coded = self.encode_runs([run for part in asked for run in part])
        self.spaced.update(zip(bodies, coded[len(heads) :]))
        marks = dict(zip(asked[2], coded[len(heads) + len(bodies) :]))
        self.spaced.update({run: self.spaced[body] + marks[run[len(body) :]] for run, body in ends.items()})
        get = self.spaced.__getitem__
        return [head + b"".join(map(get, tail)) for head, tail in zip(coded, tails)]


def steps(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of ranges of rows of about ``STEP_BYTES``; null is empty, a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right")))
        yield start, [t or "" for t in texts.slice(start, end - start).to_pylist()]
        start = end
