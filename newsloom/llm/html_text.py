"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at its block elements. The first pass judges each block by itself: by where it stands (a
menu, a form, an advert, an article), by link density, by length and by stop-word density. Blocks too short or too
undecided for that are settled in the second pass, which gives them the label of the nearest decided neighbour on
either side.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import bounded_batches, query, table

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au avec ce il elle par plus ne se sont ou mais son sa ses leur nous vous on aux cette ces comme tout fait être été même aussi bien sans peut entre après si deux",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine einer eines einem einen dem als auch es an werden aus er hat dass sie nach wird bei noch wie über so zum zur haben nur oder aber vor bis mehr durch man sein wurde sind war hatte wenn kann",
    "es": "el la los las de que y en un una ser se no por con su para como estar tener le lo todo pero más hacer o poder este otro ese si me ya ver porque dar cuando muy sin vez mucho saber sobre mi entre del al es son ha era fue también hasta desde",
}
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

#: Elements whose content is never text of the page.
UNSEEN = "script style noscript template iframe svg math object canvas video audio textarea select title".split()
#: Elements around text that is no article.
OUTSIDE = frozenset("nav footer aside form button dialog menu fieldset legend label datalist".split())
#: Words in a class or id that name such places.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead comment comments commentlist disqus reply replies respond discussion share sharing social related recommended "
    "recommendations widget popup modal overlay login search pager pagination toolbar toc".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Classes or ids of an article where no element says so.
INSIDE_NAMES = frozenset(
    "article articlebody article-body article-content post post-body post-content entry entry-content story story-body content main main-content maincontent".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these where they are still open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.2, 0.3
LINK_DENSITY = 0.5

#: A comment, a declaration, or a tag; of a tag with attribute values only its name.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*+)(?:(?P<attrs>[^<>=]*+)>)?",
    re.S | re.I,
)
#: What matters behind a tag's name: its end, or a value. Quotes count only where a value begins.
_PART = re.compile(r"""[<>]|=\s*+(?:(?P<quote>["'])|[^\s<>"'][^\s<>]*+)""")
_PLAIN = re.compile(r"[^<>]*+>")
#: The rest of an element without text, its end tag included.
_REST = {tag: re.compile(rf".*?(?:</{tag}(?=[\s/>])[^>]*+(?:>|\Z)|\Z)", re.S | re.I) for tag in UNSEEN}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


@dataclass
class Place:
    tag: str
    outside: bool
    inside: int  # 2 in an article by element or role, 1 by name
    named: tuple[int, ...] = ()  # the elements around it that a class or id calls no article


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    inside: int
    label: str = ""
    named: tuple[int, ...] = ()


def _tag_end(page: str, at: int, dead: set[int]) -> tuple[int, bool]:
    """Where a tag ends whose name ends at ``at``, and whether a slash before that belongs to a value; -1 if it is no tag.

    ``dead`` remembers the values of the page from which no end is reached, so that none is read twice in vain. A tag
    that does not end when its quotes are heeded is read without them.
    """
    start, seen, value = at, [], -1
    while part := _PART.search(page, at):
        if quote := part["quote"]:
            at = part.end()
            seen.append(at)
            if at in dead or (at := page.find(quote, at) + 1) == 0:
                break
        elif part[0] == ">":
            return part.end(), value == part.start()
        elif part[0] == "<":
            break
        else:
            at = value = part.end()
    dead.update(seen)
    plain = _PLAIN.match(page, start)
    return (plain.end() if plain else -1), False


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, is an end tag, attributes); the tag is empty for a comment, a declaration and an unseen element."""
    at, dead = 0, set()
    while token := _TOKEN.search(page, at):
        at = token.end()
        tag, ends, attrs, value = (token["tag"] or "").lower(), bool(token["end"]), token["attrs"], False
        if tag and attrs is None:
            end, value = _tag_end(page, at, dead)
            if end < 0:
                continue
            attrs, at = page[at : end - 1], end
        if tag in _REST and not ends:
            empty = tag in ("svg", "math") and attrs.endswith("/") and not value
            at = at if empty else _REST[tag].match(page, at).end()
            tag = ""
        yield token.start(), at, tag, ends, attrs or ""


def _place(tag: str, attrs: str, above: Place, number: int) -> Place:
    values = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in _ATTRIBUTE.findall(attrs)} if attrs.strip() else {}
    names = f"{values.get('class', '')} {values.get('id', '')}"
    words = set(re.split(r"[^a-z]+", names))
    role = values.get("role", "")
    inside = 2 if tag in ("article", "main") or role in ("main", "article") or values.get("itemprop") == "articlebody" else 1 if INSIDE_NAMES & set(names.split()) else 0
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
    outside = tag in OUTSIDE or (tag == "header" and not above.inside) or role in OUTSIDE_ROLES or hidden
    named = tag not in ("html", "body", "main") and (bool(OUTSIDE_NAMES & words) or ("header" in words and not above.inside and not inside))
    return Place(tag, above.outside or outside, max(above.inside, inside), (*above.named, number) if named else above.named)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, character references decoded and white space turned into single spaces."""
    blocks, parts = [], []  # parts: (text, is in a link)
    stack, links, last = [Place("", False, 0)], 0, 0
    # Open elements by tag, and the places of open blocks: no end tag or block walks over what it does not close.
    open_, marks = Counter(), []

    def close() -> None:
        if parts:
            texts = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            linked = " ".join(html.unescape("".join(t if a else " " for t, a in parts)).split())
            if texts:
                blocks.append(Block(texts, len(linked), stack[-1].outside, stack[-1].inside, named=stack[-1].named))
            parts.clear()

    def pop(to: int) -> None:
        nonlocal links
        links -= sum(p.tag == "a" for p in stack[to:])
        open_.subtract(p.tag for p in stack[to:])
        del stack[to:]
        while marks and marks[-1] >= to:
            marks.pop()

    def elsewhere(a: Place, b: Place) -> bool:
        return a.outside != b.outside or a.named != b.named

    for start, end, tag, ends, attrs in _tokens(page):
        if start > last:
            parts.append((page[last:start], links > 0))
        last = end
        if not tag:
            continue
        block = tag in BLOCKS
        if block:
            close()
        if ends:
            if open_[tag] > 0:
                at = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                if any(elsewhere(p, stack[at - 1]) for p in stack[at:]):
                    close()
                pop(at)
            continue
        if block:  # a paragraph, and what is open in it, ends before another block
            at = marks[-1] if marks else 0
            if at and stack[at].tag in ("p", *CLOSES.get(tag, ())) and (tag != "br"):
                pop(at)
        if tag in VOID:
            continue
        place = _place(tag, attrs, stack[-1], start)
        if elsewhere(place, stack[-1]):
            close()
        if block:
            marks.append(len(stack))
        stack.append(place)
        open_[tag] += 1
        links += tag == "a"
    if last < len(page):
        parts.append((page[last:], links > 0))
    close()
    return blocks


def _density(text: str) -> float:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in _STOP for w in words) / len(words) if words else 0.0


def _article_level(blocks: list[Block]) -> int:
    """The level of the page's article: the highest that holds half the text which its own words show to be good, or 0.

    Where no block is good by itself, those count that are near it; where there are none either, nothing speaks against
    the highest level.
    """
    shown = [b for b in blocks if b.label == "good"] or [b for b in blocks if b.label == "near"]
    every = sum(len(b.text) for b in shown)
    for level in sorted({b.inside for b in blocks if not b.outside} - {0}, reverse=True):
        if 2 * sum(len(b.text) for b in shown if b.inside >= level) >= every:
            return level
    return 0


def _called_outside(blocks: list[Block]) -> set[int]:
    """The elements whose class or id excludes their blocks.

    Names are a prior: where they leave no good text, the outermost element that holds most of it is no exclusion, and what is named
    inside it is asked next. But it must hold more than all they leave, and stand no less in an article than that.
    """
    level = "good" if any(b.label == "good" for b in blocks) else "near"
    shown, excluded = [b for b in blocks if b.label == level], {n for b in blocks for n in b.named}
    while shown and all(excluded.intersection(b.named) for b in shown):
        held = Counter()
        for b in shown:
            held[next(n for n in b.named if n in excluded)] += len(b.text)
        most = max(held, key=lambda n: (held[n], -n))
        rest = [b for b in blocks if not excluded.intersection(b.named) and not b.outside and b.linked <= LINK_DENSITY * len(b.text)]
        deep = max(b.inside for b in shown if most in b.named)
        if sum(len(b.text) for b in rest) >= held[most] or any(b.inside > deep for b in rest):
            break
        excluded.discard(most)
    return excluded


def judge(blocks: list[Block]) -> int:
    """First pass: good, bad, or undecided ("short", "near"). Gives the level of the article that the labels follow.

    Links, length and words are judged everywhere; on a page without any word of the lists, length alone. Only then names and the
    article count: blocks outside it are bad, and few stop words leave a block of it undecided.
    """
    for b in blocks:
        size = len(b.text)
        if b.outside or b.linked > LINK_DENSITY * size:
            b.label = "bad"
        elif size < SHORT_CHARS:
            b.label = "short"
        else:
            density = _density(b.text)
            b.label = "good" if density >= STOP_HIGH and size > LONG_CHARS else "near" if density >= STOP_LOW else "few"
    excluded = _called_outside(blocks)
    for b in blocks:
        if excluded.intersection(b.named):
            b.outside, b.label = True, "bad"
    level = _article_level(blocks)
    wordless = not level and not any(b.label in ("good", "near") for b in blocks)
    for b in blocks:
        if b.inside < level:
            b.label = "bad"
        elif b.label == "few" and wordless:
            b.label = "good" if len(b.text) > LONG_CHARS else "near"
        elif b.label == "few":
            b.label = "near" if level else "bad"
    return level


def settle(blocks: list[Block], level: int) -> None:
    """Second pass: undecided blocks take the label of the nearest decided neighbour.

    Inside an article only good neighbours in it count. Elsewhere the edges of the page count as bad, and of two at one distance
    the one before decides. Where nothing is decided, nothing speaks against the undecided.
    """
    article = level > 0 and any(b.label != "bad" for b in blocks)
    decided = [(i, b.label) for i, b in enumerate(blocks) if b.label == "good" or (b.label == "bad" and not article)]
    if decided and not article:
        decided = [(-1, "bad"), *decided, (len(blocks), "bad")]
    k = 0
    for i, b in enumerate(blocks):
        if b.label in ("good", "bad"):
            continue
        while k < len(decided) and decided[k][0] < i:
            k += 1
        sides = ([decided[k - 1]] if k else []) + ([decided[k]] if k < len(decided) else [])
        b.label = min(sides, key=lambda side: (abs(side[0] - i), side[0]))[1] + "!" if sides else "good!"
    for b in blocks:
        b.label = b.label.rstrip("!")


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    settle(blocks, judge(blocks))
    return " ".join(b.text for b in blocks if b.label == "good")


def extracted(page: Column) -> Column:
    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return texts(page)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html; other columns are ignored): page_id, url, text, n_chars.

    Null or empty html gives an empty text. Broken markup is read as far as it goes: an unclosed element lasts to the end of
    the one around it, an unclosed comment or script to the end of the page. Repeated rows give equal rows.
    """
    return bounded_batches(pages).select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op3_html_text")
def op3_html_text(spark, folder):
    return extract(table(spark, folder, "pages", "page_id", "url", "html"))
