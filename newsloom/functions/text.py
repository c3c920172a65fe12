"""Text cleaning, keyword phrases and display strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Quote marks, then the query punctuation, that never reach a search phrase.
QUOTE_MARKS = "\"'“”„‟«»`´"
QUERY_PUNCTUATION = "&|/\\:;()[]{}.,"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _text(value) -> Column:
    return F.coalesce(_col(value), F.lit(""))


def squeeze(value) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_text(value), r"(?U)\s+", " "))


def sanitize(value) -> Column:
    """Keyword text safe to send to a search provider."""
    marks = QUOTE_MARKS + QUERY_PUNCTUATION
    return squeeze(F.translate(_text(value), marks, " " * len(marks)))


def clean_keywords(keywords) -> Column:
    return F.filter(F.transform(_col(keywords), sanitize), lambda k: k != "")


def phrase_pattern(keyword) -> Column:
    """Boundary regex of a keyword (null when nothing is left after cleaning).

    ``(?U)`` makes ``\\w`` Unicode-aware, so ``g`` does not match inside ``søgøre``.
    """
    clean = sanitize(keyword)
    body = F.array_join(F.split(clean, " "), r"\E[\s\W_]+\Q")
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), body, F.lit(r"\E(?!\w)"))
    return F.when(clean != "", pattern)


def matches_phrase(text, keyword) -> Column:
    return F.coalesce(F.rlike(_text(text), phrase_pattern(keyword)), F.lit(False))


def words(value) -> Column:
    """Distinct lower-case word tokens; ``_`` separates words here."""
    pieces = F.split(F.lower(_text(value)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(pieces, lambda w: w != ""))


def normalize_title(value) -> Column:
    """ASCII letters and digits only, so accented letters split words (it is the block key)."""
    tokens = F.regexp_extract_all(F.lower(_text(value)), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_join(tokens, " ")


def title_signature(normalized) -> Column:
    return F.array_join(F.slice(F.split(_col(normalized), " "), 1, 5), " ")


def comparison_text(title, teaser) -> Column:
    title, teaser = F.trim(_text(title)), F.trim(_text(teaser))
    return (
        F.when(F.length(title) >= 20, title)
        .when((title != "") & (teaser != ""), F.concat_ws(" ", title, teaser))
        .otherwise(F.coalesce(F.nullif(title, F.lit("")), teaser))
    )


def search_query(keyword, topic_name) -> Column:
    return F.coalesce(F.nullif(sanitize(keyword), F.lit("")), sanitize(topic_name))


def quote_phrase(keyword) -> Column:
    keyword = _col(keyword)
    return F.when(keyword.contains(" "), F.concat(F.lit('"'), keyword, F.lit('"'))).otherwise(keyword)


def mention_display(caption, teaser, limit: int = 420) -> Column:
    """Caption plus teaser, unless both say the same."""
    caption, teaser = F.trim(_text(caption)), F.trim(_text(teaser))
    joined = F.when(
        (teaser != "") & (F.lower(teaser) != F.lower(caption)),
        F.trim(F.concat_ws(" ", caption, teaser)),
    ).otherwise(caption)
    shown = F.coalesce(F.nullif(joined, F.lit("")), F.lit("No text available"))
    return F.left(F.replace(shown, F.lit("\n"), F.lit(" ")), F.lit(limit))


def slugify_label(label) -> Column:
    safe = F.regexp_replace(F.trim(_text(label)), r"[^\p{L}\p{N}_-]", "_")
    safe = F.regexp_replace(safe, r"^_+|_+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown_brand"))


def metric_label(value) -> Column:
    clean = F.left(F.lower(F.trim(_text(value))), F.lit(120))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def chat_title(message) -> Column:
    message = _col(message)
    return F.when(F.length(message) > 30, F.concat(F.left(message, F.lit(30)), F.lit("..."))).otherwise(message)


def visible_text(html) -> Column:
    """Text a reader sees: scripts, styles, comments and tags removed, entities left as is."""
    body = F.regexp_replace(_text(html), r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ")
    return squeeze(F.regexp_replace(body, r"(?s)<[^>]+>", " "))


def language_codes(codes) -> Column:
    """Lower-case primary subtags in first-seen order."""
    primary = F.transform(
        F.filter(_col(codes), lambda c: c.isNotNull()),
        lambda c: F.regexp_extract(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-")), r"^([^-]*)", 1),
    )
    return F.array_distinct(F.filter(primary, lambda c: c != ""))


def contains_any(text, keywords) -> Column:
    """Substring test against an array of keywords, ignoring case."""
    text = F.lower(_text(text))
    return F.exists(_col(keywords), lambda k: F.contains(text, F.lower(k)))


def path_has_keyword_token(path, keywords, min_chars: int = 4) -> Column:
    """A keyword token of at least ``min_chars`` letters occurs in the URL path."""
    spaced = F.regexp_replace(F.lower(_text(path)), r"[/_.\-]", " ")
    tokens = F.flatten(F.transform(_col(keywords), lambda k: F.split(F.lower(F.trim(k)), r"\s+")))
    return F.exists(tokens, lambda t: (F.length(t) >= min_chars) & F.contains(spaced, t))
