"""Date parsing and date windows as column expressions (all instants are UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom import settings

# Month names by their first letters (English and the Nordic languages).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "maj": 5, "mai": 5, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "des": 12,
}
# Zone abbreviations of RFC 822.
ZONES = {
    "z": "+00:00", "ut": "+00:00", "utc": "+00:00", "gmt": "+00:00", "est": "-05:00",
    "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00",
    "pst": "-08:00", "pdt": "-07:00", "cet": "+01:00", "cest": "+02:00",
}
# Unit word (English, Danish) -> seconds; months and years as 30 and 365 days.
UNIT_SECONDS = {
    "second": 1, "sekund": 1, "minute": 60, "minut": 60, "min": 60, "hour": 3600, "time": 3600,
    "day": 86400, "dag": 86400, "week": 604800, "uge": 604800, "month": 2592000,
    "måned": 2592000, "year": 31536000, "år": 31536000,
}


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def _stamp(year, month, day, clock, zone) -> Column:
    """Timestamp from text parts; null when they form no valid date."""
    clock = F.when(clock == "", F.lit("00:00:00")).when(
        F.length(F.regexp_replace(clock, r"\.\d+$", "")) < 6, F.concat(clock, F.lit(":00"))
    ).otherwise(clock)
    clock = F.when(clock.rlike(r"^\d:"), F.concat(F.lit("0"), clock)).otherwise(clock)
    text = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), clock, zone)
    return text.try_cast("timestamp")


def _zone(raw: Column) -> Column:
    raw = F.lower(F.trim(raw))
    offset = F.regexp_replace(raw, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    return (
        F.when(raw == "", F.lit("Z"))
        .when(raw.rlike(r"^[+-]\d{2}:?\d{2}$"), offset)
        .otherwise(_lookup(ZONES, raw))
    )


def _clock(raw: Column) -> Column:
    """A time of day on 24 hours: dots become colons, and AM or PM goes."""
    half = F.lower(F.regexp_extract(raw, r"(?i)\s*([ap])\.?m\.?$", 1))
    bare = F.replace(F.regexp_replace(raw, r"(?i)\s*[ap]\.?m\.?$", ""), F.lit("."), F.lit(":"))
    hour, rest = F.split_part(bare, F.lit(":"), F.lit(1)).try_cast("int"), F.regexp_replace(bare, r"^\d+", "")
    turned = F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0)
    return F.when(half == "", bare).otherwise(F.concat(F.lpad(turned.cast("string"), 2, "0"), rest))


_CLOCK = r"(\d{1,2}[:.]\d{2}(?:[:.]\d{2})?(?:\s*[AaPp]\.?[Mm]\b\.?)?)?"
_ZONE = r"\s*([A-Za-z]{1,4}|[+-]\d{2}:?\d{2})?$"
_WEEKDAY = r"^(?:\p{L}{1,10}\.?,?\s+(?:d\.?|den)?\s*)?"
# Each form captures three date parts, a clock and a zone.
_DAY_MONTH = _WEEKDAY + r"(\d{1,2})\.?\s+(\p{L}{3})\p{L}*\.?,?\s+(\d{4})(?:,|\s+(?:kl\.?|at))?\s*" + _CLOCK + _ZONE
_MONTH_DAY = r"^(\p{L}{3})\p{L}*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:,|\s+at)?\s*" + _CLOCK + _ZONE
_NUMERIC = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:,|\s+kl\.?)?\s*" + _CLOCK + _ZONE
_AGO = (
    r"^(?:for )?(\d+|an?|en|et)\s+"
    r"(second|sekund|minute|minut|min|hour|time|day|dag|week|uge|month|måned|year|år)\p{L}*\s+(?:ago|siden)$"
)


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _captured(text: Column, pattern: str, groups: int, build) -> Column:
    """``build`` over the captured groups when the text has the form, else null."""
    joined = F.regexp_replace(text, pattern, "|".join(f"${i}" for i in range(1, groups + 1)))
    return F.when(text.rlike(pattern), _with(F.split(joined, r"\|"), build))


def parse_date(raw, as_of) -> Column:
    """Instant of a date string: ISO 8601, RFC 822, day-first numeric, named months, epoch
    seconds, or a phrase relative to ``as_of`` ("3 days ago", "2 timer siden", "i går")."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return _with(F.trim(F.regexp_replace(_col(raw), r"\s+", " ")), lambda text: _parse(text, as_of))


def _parse(text: Column, as_of: Column) -> Column:
    month = lambda name: _lookup(MONTHS, F.lower(name)).cast("string")
    clock = _clock
    iso = F.when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.regexp_replace(text, r" (UTC|GMT)$", "Z").try_cast("timestamp")
    )
    day_month = _captured(
        text, _DAY_MONTH, 5, lambda p: _stamp(p[2], month(p[1]), p[0], clock(p[3]), _zone(p[4]))
    )
    month_day = _captured(
        text, _MONTH_DAY, 5, lambda p: _stamp(p[2], month(p[0]), p[1], clock(p[3]), _zone(p[4]))
    )
    numeric = _captured(text, _NUMERIC, 5, lambda p: _stamp(p[2], p[1], p[0], clock(p[3]), _zone(p[4])))
    epoch = F.when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(text.try_cast("bigint")))
    low = F.lower(text)
    ago = _captured(
        low, _AGO, 2,
        lambda p: F.timestamp_seconds(
            F.unix_seconds(as_of) - F.coalesce(p[0].try_cast("bigint"), F.lit(1)) * _lookup(UNIT_SECONDS, p[1])
        ),
    )
    named_day = F.when(low.isin("now", "nu", "just now", "today", "i dag"), as_of).when(
        low.isin("yesterday", "i går"), as_of - F.expr("INTERVAL 1 DAY")
    )
    return F.coalesce(iso, day_month, month_day, numeric, epoch, ago, named_day)


def first_date(*raw) -> Column:
    """First non-empty raw date in precedence order."""
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in raw])


def certain_date(text, from_attribute) -> Column:
    """A machine-readable attribute, or text that holds an absolute date or year."""
    return _col(from_attribute) | F.coalesce(_col(text).rlike(settings.CERTAIN_DATE_REGEX), F.lit(False))


def days_before(as_of, days) -> Column:
    days = days if isinstance(days, Column) else F.lit(max(1, int(days)))
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=days.cast("int"))


def effective_from_date(from_date, lookback_days, as_of) -> Column:
    """Cutoff of a run: the given date clamped to ``as_of``, else the lookback window."""
    now = F.lit(as_of).cast("timestamp")
    lookback = _col(lookback_days).cast("int")
    return F.least(F.coalesce(_col(from_date), now - F.make_dt_interval(days=lookback)), now)


def recency_bucket(cutoff, as_of) -> Column:
    """Search-engine time range for a cutoff (edges are a little wide on purpose)."""
    now = F.lit(as_of).cast("timestamp")
    age_days = (F.unix_micros(now) - F.unix_micros(_col(cutoff))) / F.lit(86400000000.0)
    return (
        F.when(age_days <= 2, F.lit("qdr:d"))
        .when(age_days <= 15, F.lit("qdr:w"))
        .when(age_days <= 60, F.lit("qdr:m"))
        .when(age_days <= 400, F.lit("qdr:y"))
    )


def after_operator(query, cutoff) -> Column:
    """Query with a hard lower date bound when a cutoff is known."""
    query, cutoff = _col(query), _col(cutoff)
    bounded = F.concat(F.lit("("), query, F.lit(") after:"), F.date_format(cutoff, "yyyy-MM-dd"))
    return F.when(cutoff.isNull(), query).otherwise(bounded)


def effective_query_chars(max_chars: int, cutoff) -> Column:
    room = max(1, max_chars - settings.AFTER_OPERATOR_CHARS)
    return F.when(_col(cutoff).isNull(), F.lit(max_chars)).otherwise(F.lit(room))


def iso_seconds(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
