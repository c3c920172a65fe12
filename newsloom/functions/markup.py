"""Reading one HTML page: a flat element list and first-match selectors.

Supports the selector forms used by source configurations: ``tag``, ``.class``, ``#id``,
``[attr]``, ``[attr=v]``, ``[attr*=v]`` and the descendant combinator.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
_STEP = re.compile(r"""\[([\w:-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]|([.#]?)([\w-]+)""")


class Page(HTMLParser):
    """Elements in document order; text pieces point at the element that holds them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.pieces: list[tuple[int, str]] = []
        self._open: list[int] = []
        self.feed(html or "")
        self.close()
        self._shut(0)

    def _shut(self, depth: int) -> None:
        for i in self._open[depth:]:
            self.ends[i] = len(self.tags)
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self._open and self.tags[self._open[-1]] == tag:
            self._shut(len(self._open) - 1)
        index = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parents.append(self._open[-1] if self._open else -1)
        self.ends.append(index + 1)
        if tag not in _VOID:
            self._open.append(index)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self.tags[self._open[depth]] == tag:
                self._shut(depth)
                return

    def handle_data(self, data):
        text = data.strip()
        if text and self._open and self.tags[self._open[-1]] not in _HIDDEN:
            self.pieces.append((self._open[-1], text))

    def select_first(self, selector: str) -> int:
        """Index of the first matching element, or -1."""
        steps = _parse(selector)
        for i in range(len(self.tags)):
            if self._is(i, steps[-1]) and self._below(i, steps[:-1]):
                return i
        return -1

    def _below(self, i: int, steps) -> bool:
        for step in reversed(steps):
            i = self.parents[i]
            while i >= 0 and not self._is(i, step):
                i = self.parents[i]
            if i < 0:
                return False
        return True

    def _is(self, i: int, step) -> bool:
        attrs = self.attrs[i]
        for kind, name, value in step:
            if kind == "tag" and self.tags[i] != name:
                return False
            if kind == "." and name not in attrs.get("class", "").split():
                return False
            if kind == "#" and attrs.get("id") != name:
                return False
            if kind == "[]" and name not in attrs:
                return False
            if kind == "=" and attrs.get(name) != value:
                return False
            if kind == "*=" and value not in attrs.get(name, ""):
                return False
        return True

    def text(self, i: int) -> str:
        end = self.ends[i]
        return " ".join(" ".join(t for at, t in self.pieces if i <= at < end).split())

    def all_text(self) -> str:
        return " ".join(" ".join(t for _, t in self.pieces).split())


@lru_cache(maxsize=512)
def _parse(selector: str):
    steps = []
    for compound in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector):
        step = []
        for name, op, value, mark, word in _STEP.findall(compound):
            if name:
                step.append((op or "[]", name, value))
            else:
                step.append((mark or "tag", word if mark else word.lower(), ""))
        steps.append(tuple(step))
    return tuple(steps)


def select_text(page: Page, selector) -> str:
    i = page.select_first(selector) if selector else -1
    return page.text(i) if i >= 0 else ""


def select_date(page: Page, selector) -> tuple[str, bool]:
    """Date text and whether it came from a machine-readable attribute."""
    i = page.select_first(selector) if selector else -1
    if i < 0:
        return "", False
    stamp = page.attrs[i].get("datetime") or page.attrs[i].get("content")
    return (" ".join(stamp.split()), True) if stamp else (page.text(i), False)
