"""Search-request building as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom import settings
from newsloom.functions.text import language_codes


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pack_or_queries(keywords, max_chars, separator: str = " OR ") -> Column:
    """Greedy packing of phrases into OR-queries of at most ``max_chars``; phrases stay whole."""
    max_chars = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    sep = F.lit(separator)
    terms = F.filter(F.transform(_col(keywords), lambda k: F.trim(k)), lambda k: k != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, term):
        joined = F.concat(acc["open"], sep, term)
        fits = F.length(joined) <= max_chars
        first = acc["open"] == ""
        return F.struct(
            F.when(first | fits, acc["done"])
            .otherwise(F.concat(acc["done"], F.array(acc["open"])))
            .alias("done"),
            F.when(first, term).when(fits, joined).otherwise(term).alias("open"),
        )

    packed = F.aggregate(
        terms, empty, add,
        lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda q: q != ""),
    )
    return F.when(max_chars > 0, packed).otherwise(F.array().cast("array<string>"))


def limit_signal(message) -> Column:
    """Kind of quota problem named in an API error, else null."""
    low = F.lower(F.coalesce(_col(message), F.lit("")))
    has = low.contains
    return (
        F.when(has("rate limit") | has("too many requests"), F.lit("rate_limit"))
        .when(has("quota") | has("searches left"), F.lit("quota"))
        .when(has("monthly") & has("search"), F.lit("quota"))
        .when(has("insufficient") & has("balance"), F.lit("quota"))
        .when(has("limit reached"), F.lit("limit_reached"))
    )


def is_no_results(message) -> Column:
    low = F.lower(F.coalesce(_col(message), F.lit("")))
    return low.contains("no results") | low.contains("hasn't returned any results")


def api_outcome(message) -> Column:
    """Metric error type of a payload: null without an error."""
    return (
        F.when(F.coalesce(_col(message), F.lit("")) == "", F.lit(None).cast("string"))
        .when(is_no_results(message), F.lit("api_no_results"))
        .otherwise(F.concat(F.lit("api_"), F.coalesce(limit_signal(message), F.lit("error"))))
    )


def rss_locale_attempts(languages) -> Column:
    """Ordered locale plan (array of language/hl/gl/ceid), always ending in the bare default."""
    locale_map = F.create_map(
        *[
            item
            for lang, (hl, gl, ceid) in settings.RSS_LOCALES.items()
            for item in (
                F.lit(lang),
                F.struct(F.lit(hl).alias("hl"), F.lit(gl).alias("gl"), F.lit(ceid).alias("ceid")),
            )
        ]
    )
    codes = language_codes(languages)
    default = F.array(*[F.lit(c) for c in settings.RSS_DEFAULT_LANGUAGES])
    codes = F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, codes).otherwise(default)
    known = F.filter(codes, lambda c: F.map_contains_key(locale_map, c))
    # First language per distinct locale: "nb" after "no" asks for the same feed again.
    firsts = F.filter(
        known,
        lambda c: F.get(
            F.filter(known, lambda o: F.element_at(locale_map, o)["ceid"] == F.element_at(locale_map, c)["ceid"]),
            F.lit(0),
        ) == c,
    )
    as_attempt = F.transform(
        F.slice(firsts, 1, settings.MAX_LOCALE_ATTEMPTS - 1),
        lambda c: F.struct(
            c.alias("language"),
            F.element_at(locale_map, c)["hl"].alias("hl"),
            F.element_at(locale_map, c)["gl"].alias("gl"),
            F.element_at(locale_map, c)["ceid"].alias("ceid"),
        ),
    )
    none = F.lit(None).cast("string")
    bare = F.struct(F.lit("default").alias("language"), none.alias("hl"), none.alias("gl"), none.alias("ceid"))
    return F.concat(as_attempt, F.array(bare))


def news_language_attempts(languages) -> Column:
    """Language parameter per news-API attempt; null is the unrestricted one, always last."""
    languages = F.coalesce(_col(languages), F.array().cast("array<string>"))
    none = F.array(F.lit(None).cast("string"))
    return (
        F.when(F.size(languages) == 1, F.concat(languages, none))
        .when(F.size(languages) == 0, F.concat(F.array(F.lit("da"), F.lit("en")), none))
        .otherwise(none)
    )


def rss_search_url(keyword, hl, gl, ceid) -> Column:
    base = F.concat(F.lit(settings.RSS_SEARCH_URL + "?q="), F.url_encode(_col(keyword)))
    locale = F.concat(
        F.lit("&hl="), F.url_encode(_col(hl)), F.lit("&gl="), F.url_encode(_col(gl)),
        F.lit("&ceid="), F.url_encode(_col(ceid)),
    )
    return F.concat(base, F.coalesce(locale, F.lit("")))


def site_search_url(pattern, keyword) -> Column:
    return F.replace(_col(pattern), F.lit("{keyword}"), F.url_encode(_col(keyword)))


def clamp(value: int, low: int, high: int | None = None) -> int:
    """Driver-side limit clamping."""
    return max(low, value if high is None else min(value, high))
