"""Texts cut into short runs on their bytes, so that the tokenizer library meets each distinct run once.

The pattern of byte-level tokenizers never joins, for instance, a letter and a mark behind it, or a word and the space
behind it. Numpy finds such places from the classes of the bytes around them, Arrow finds the distinct runs between them, and
the ids of a text are gathered from those of its runs. Python meets a run once in a step, not where it recurs.
What is not surely such a place stays inside a run, and a run that is not surely one piece is encoded by the whole tokenizer.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Bytes of text handled at a time, unless they hold no place to cut.
STEP_BYTES = 12 << 20
#: Bytes of the longest run that is remembered.
REMEMBERED_BYTES = 64
#: Runs without white space given to the library in one text.
GROUP = 64

# Classes of bytes. OTHER: white space or unknown; SOLID: not white space, but letter, digit or mark.
_OTHER, _LETTER, _DIGIT, _MARK, _SOLID, _SPACE, _LINE = range(7)
#: ASCII marks; the apostrophe begins pieces such as 's, so it is only SOLID.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    found = np.full(256, _OTHER, np.uint8)
    for byte in range(256):
        # Characters of the lead bytes C3 to C9 are letters, but for two signs. Those of later ones that may be white space are told in kinds().
        if bytes([byte]).isalpha() or 0xC3 <= byte <= 0xC9:
            found[byte] = _LETTER
        elif bytes([byte]).isdigit():
            found[byte] = _DIGIT
        elif byte in _MARKS:
            found[byte] = _MARK
        elif byte >= 0xC2 or byte == ord("'"):
            found[byte] = _SOLID
    found[ord(" ")], found[ord("\n")] = _SPACE, _LINE
    return found


def _pairs() -> np.ndarray:
    """Whether a piece always ends between bytes of two classes, whatever stands around them."""
    found = np.zeros((8, 8), bool)
    kinds = [_LETTER, _DIGIT, _MARK]
    for a in kinds:
        found[a, [b for b in kinds if b != a]] = True
    found[np.ix_([*kinds, _SOLID], [_SPACE, _LINE])] = True
    return found.reshape(-1)


_CLASS, _PAIR = _classes(), _pairs()
_IS_SOLID = np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK, _SOLID])
_IS_PLAIN = np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK])


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text; all bytes of a character are of one."""
    kind = _CLASS[data]
    later = np.flatnonzero((data & 0xC0) == 0x80)
    later = later[later > 0]
    for _ in range(3):
        kind[later] = kind[later - 1]
    first, second = data[later - 1], data[later]
    # The signs for times and division, and two that are white space.
    pairs = later[((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((first == 0xC2) & ((second == 0x85) | (second == 0xA0)))]
    kind[pairs] = kind[pairs - 1] = _OTHER
    # Characters of three bytes whose neighbours are white space, without the dashes, quotes and dots from U+2010 to U+2027.
    triples = later[
        ((first == 0xE1) & ((second == 0x9A) | (second == 0xA0))) | ((first == 0xE2) & (second & 0xFE == 0x80)) | ((first == 0xE3) & (second == 0x80))
    ]
    third = data[np.minimum(triples + 1, len(data) - 1)]
    triples = triples[(data[triples - 1] != 0xE2) | (data[triples] != 0x80) | (third < 0x90) | (third > 0xA7) | (triples + 1 >= len(data))]
    kind[triples] = kind[triples - 1] = kind[np.minimum(triples + 1, len(data) - 1)] = _OTHER
    return kind


def cuts(kind: np.ndarray) -> np.ndarray:
    """Whether to cut before each byte, by the classes of the bytes."""
    found = np.zeros(len(kind), bool)
    found[1:] = _PAIR[kind[:-1] << 3 | kind[1:]]
    # A line end alone between others is a piece; of more white space the last character may be apart.
    lines = np.flatnonzero(kind == _LINE)
    lines = lines[(lines > 0) & (lines < len(kind) - 1)]
    found[lines[_IS_SOLID[kind[lines - 1]] & _IS_SOLID[kind[lines + 1]]] + 1] = True
    return found


def _letters() -> np.ndarray:
    """The character by which byte-level tokenizers write each byte; FF, which is in no text, is a line end."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = np.zeros(256, "<u2")
    found[kept] = kept
    rest = [b for b in range(256) if b not in kept]
    found[rest] = 256 + np.arange(len(rest))
    found[0xFF] = ord("\n")
    return found


_LETTERS = _letters()


class PieceCoder:
    """Encodes texts as ``tokenizer`` does without adding special tokens; remembers runs in two generations of about ``most``."""

    def __init__(self, tokenizer: Tokenizer, most: int = 300_000):
        self.tokenizer, self.most = tokenizer, most
        self.newer: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        tokens = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(map(re.escape, tokens))) if tokens else None
        vocabulary = tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, at in vocabulary.items():
            self.token_bytes[at] = len(token)
        # The model alone, for runs that are one piece each: byte characters, a line each.
        self.model = Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        made = json.loads(tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.cuttable = (
            (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and not made["normalizer"] and not made["truncation"] and not made["padding"]
        )

    def _by_library(self, runs: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([run.decode() for run in runs], add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _by_model(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs that are one piece each; the bytes of the tokens tell which are whose."""
        if not runs:
            return []
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        text = _LETTERS[np.frombuffer(b"\xff".join(runs), np.uint8)].tobytes().decode("utf-16-le")
        starts = (np.cumsum(sizes + 1) - sizes - 1)[::GROUP].tolist()
        groups = [text[a : b - 1] for a, b in zip(starts, [*starts[1:], len(text) + 1])]
        coded = self.model.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, "<u4") for c in coded])
        covered, wanted = np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)
        ends = np.searchsorted(covered, wanted)
        if not len(ids) or covered[-1] != wanted[-1] or (covered[ends] != wanted).any():
            # A vocabulary that lacks some byte.
            return self._by_library(runs)
        data, ends = ids.tobytes(), (4 * (ends + 1)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _ids(self, runs: list[bytes], one_piece: list[bool]) -> list[bytes]:
        """Ids of distinct runs, some of which are known to be one piece."""
        if len(self.newer) > self.most:
            self.newer, self.older = {}, self.newer
        found = list(map(self.newer.get, runs))
        new = [i for i, ids in enumerate(found) if ids is None]
        if self.older:
            for i in new:
                found[i] = self.older.get(runs[i])
        new_to_both = [i for i in new if found[i] is None]
        single, rest = [i for i in new_to_both if one_piece[i]], [i for i in new_to_both if not one_piece[i]]
        for places, encode in ((single, self._by_model), (rest, self._by_library)):
            for i, ids in zip(places, encode([runs[i] for i in places])):
                found[i] = ids
        self.newer.update((runs[i], found[i]) for i in new if len(runs[i]) <= REMEMBERED_BYTES)
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null is empty."""
        binary = pc.fill_null(texts, "").cast(pa.large_binary())
        if not len(binary):
            return []
        if not self.cuttable:
            return self._by_library(binary.to_pylist())
        _, bounds, body = binary.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(binary) + 1, 8 * binary.offset)
        data = np.frombuffer(body or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        # A text that holds a token the library finds before all others is one run.
        whole = np.zeros(0, np.int64)
        if self.added:
            at = [m.start() for m in self.added.finditer(memoryview(data))]
            whole = np.unique(np.searchsorted(bounds, at, "right") - 1)
        parts, before, start, step, done = [], np.zeros(len(bounds), np.int64), 0, STEP_BYTES, 0
        while start < len(data):
            end = min(start + step, len(data))
            window = data[start:end]
            kind = kinds(window)
            for text in whole.tolist():
                kind[max(bounds[text] - start, 0) : max(bounds[text + 1] - start, 0)] = _OTHER
            found = cuts(kind)
            inside = bounds[np.searchsorted(bounds, start) : np.searchsorted(bounds, end)] - start
            found[inside] = True
            found[0] = True
            # The last character of a step may be cut off, so it starts no run.
            starts = np.flatnonzero(found if end == len(data) else found[:-1])
            if end == len(data):
                ends = np.append(starts[1:], len(window))
            elif len(starts) > 1:
                starts, ends = starts[:-1], starts[1:]
            else:
                step *= 2
                continue
            ids, counts = self._gathered(window, kind, starts, ends)
            sums = np.append(0, np.cumsum(counts))
            here = slice(np.searchsorted(bounds, start), np.searchsorted(bounds, start + ends[-1]))
            before[here] = done + sums[np.searchsorted(starts, bounds[here] - start)]
            parts.append(ids)
            done += len(ids)
            start, step = start + int(ends[-1]), STEP_BYTES
        before[bounds == len(data)] = done
        flat = np.concatenate([*parts, np.zeros(0, "<u4")]).tobytes()
        before = (4 * before).tolist()
        return [flat[a:b] for a, b in zip(before, before[1:])]

    def _gathered(self, window: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of ``window`` that lie one behind the other, and how many each has."""
        offsets = np.append(starts, ends[-1]).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(window)])
        coded = runs.dictionary_encode()
        which = coded.indices.to_numpy()
        # Letters, digits and marks are cut apart, so a run of nothing else is of one kind; a space may begin it.
        plain = np.add.reduceat(_IS_PLAIN[kind[: ends[-1]]], starts, dtype=np.int32)
        one_piece = np.zeros(len(coded.dictionary), bool)
        one_piece[which] = (plain > 0) & (plain == ends - starts - (kind[starts] == _SPACE))
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), one_piece.tolist())
        sizes = (np.fromiter(map(len, ids), np.int64, len(ids)) // 4).astype(np.int32)
        counts = sizes[which]
        total = np.cumsum(counts, dtype=np.int32)
        places = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[which] - (total - counts), counts)
        places += np.arange(total[-1], dtype=np.int32)
        return np.frombuffer(b"".join(ids), "<u4")[places], counts
