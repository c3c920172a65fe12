"""URL, host and domain functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom import settings

_SCHEME = r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), rf"^{_SCHEME}//([^/?#]*)", 1))


def path(url) -> Column:
    """Path without query, fragment and the ``;params`` tail of its last segment."""
    raw = F.regexp_extract(_col(url), rf"^{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def query(url) -> Column:
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def is_http(url) -> Column:
    return scheme(url).isin("http", "https") & (netloc(url) != "")


def normalize_url(url) -> Column:
    """Canonical link: lower scheme and host, no ``www.``, query, fragment or trailing slash."""
    url = _col(url)
    proto = F.coalesce(F.nullif(scheme(url), F.lit("")), F.lit("https"))
    host = F.regexp_replace(netloc(url), r"^www\.", "")
    clean = F.regexp_replace(path(url), r"/{2,}", "/")
    clean = F.when(clean.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(clean, r"/+$", ""))
    rooted = F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean))
    return F.concat(proto, F.lit("://"), host, rooted)


def platform_from_url(url) -> Column:
    host = F.replace(netloc(url), F.lit("www."), F.lit(""))
    return F.coalesce(F.nullif(host, F.lit("")), F.lit("Unknown"))


def normalize_domain(domain) -> Column:
    """Bare lower-case host of a URL or host: no scheme, port or ``www.``."""
    value = F.lower(F.trim(F.coalesce(_col(domain), F.lit(""))))
    host = F.when(value.contains("://"), netloc(value)).otherwise(value)
    host = F.regexp_replace(host, r":.*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def clean_domain_entry(entry) -> Column:
    """Domain as typed in a list or form: scheme, trailing slashes and ``www.`` removed."""
    value = F.regexp_replace(F.lower(F.trim(F.coalesce(_col(entry), F.lit("")))), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(value, r"/+$", ""), r"^www\.", "")


def domain_suffixes(domain) -> Column:
    """Candidates from most to least specific, never the bare last label."""
    labels = F.split(normalize_domain(domain), r"\.")
    last = F.greatest(F.lit(1), F.size(labels) - 1)
    return F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def same_or_subdomain(host, domain) -> Column:
    host, domain = normalize_domain(host), normalize_domain(domain)
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def full_host_of(url_or_host) -> Column:
    """Host without credentials and port; works on URLs and bare hosts."""
    value = F.lower(F.trim(F.coalesce(_col(url_or_host), F.lit(""))))
    host = F.when(value.contains("://"), netloc(value)).otherwise(value)
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", "")


def host_of(url_or_host) -> Column:
    """Host without credentials, port and ``www.``; works on URLs and bare hosts."""
    return F.regexp_replace(full_host_of(url_or_host), r"^www\.", "")


def etld_plus_one(url_or_host) -> Column:
    """Registrable domain; the host itself where no public suffix is known."""
    host = host_of(url_or_host)
    labels = F.split(host, r"\.")
    size = F.size(labels)
    last = F.element_at(labels, -1)
    tail = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    known_last = last.rlike(r"^[a-z]{2}$") | last.isin(*settings.GENERIC_TLDS)
    two_label = (size >= 2) & F.when(size >= 2, tail(2)).isin(*settings.MULTI_LABEL_SUFFIXES)
    return (
        F.when(host == "", F.lit("unknown"))
        .when(two_label & (size >= 3), F.when(size >= 3, tail(3)))
        .when(two_label, host)
        .when(known_last & (size >= 2), F.when(size >= 2, tail(2)))
        .otherwise(host)
    )


def resolve_href(domain, href) -> Column:
    """Absolute form of a link found on ``https://<domain>``."""
    domain, href = _col(domain), F.trim(_col(href))
    origin = F.concat(F.lit("https://"), domain)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.rlike(r"^[/?#]"), F.concat(origin, href))
        .otherwise(
            F.concat(origin, F.lit("/"), F.regexp_replace(href, r"^(?:\.{1,2}/)+", ""))
        )
    )


def redirect_targets(url) -> Column:
    """HTTP targets carried in the query string, in parameter-name order."""
    pairs = F.transform(
        F.split(query(url), "&"),
        lambda p: F.struct(
            F.regexp_extract(p, r"^([^=]*)", 1).alias("k"),
            F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("v"),
        ),
    )
    named = lambda name: F.filter(pairs, lambda p: p["k"] == name)
    per_param = [
        F.transform(named(name), lambda p: F.trim(F.try_url_decode(p["v"])))
        for name in settings.REDIRECT_PARAMS
    ]
    return F.filter(F.flatten(F.array(*per_param)), lambda u: u.isNotNull() & is_http(u))


def is_wrapper_host(url) -> Column:
    return netloc(url).contains("google.")


def outside_link(candidates) -> Column:
    """First link that leaves the aggregator, else the first wrapper link, else null."""
    candidates = _col(candidates)
    expanded = F.flatten(
        F.transform(
            candidates,
            lambda c: F.concat(redirect_targets(c), F.filter(F.array(c), lambda x: is_http(x))),
        )
    )
    direct = F.filter(expanded, lambda u: ~is_wrapper_host(u))
    wrapper = F.filter(candidates, lambda u: is_http(u))
    return F.coalesce(F.get(direct, F.lit(0)), F.get(wrapper, F.lit(0)))


def canonical_link(candidates) -> Column:
    """Normalised link of a feed entry; empty when it has none."""
    normalized = F.transform(F.array(outside_link(candidates)), lambda u: normalize_url(u))
    return F.coalesce(F.get(normalized, F.lit(0)), F.lit(""))


def entry_candidates(link, entry_id, guid, html) -> Column:
    """Ordered distinct links of a feed entry: its link fields, then anchors in its HTML."""
    fields = F.array(*[F.trim(_col(c)) for c in (link, entry_id, guid)])
    anchors = F.transform(
        F.regexp_extract_all(
            F.coalesce(_col(html), F.lit("")),
            F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""),
            F.lit(1),
        ),
        lambda h: F.trim(h),
    )
    return F.array_distinct(
        F.filter(F.concat(fields, anchors), lambda u: u.isNotNull() & (u != ""))
    )


def segments(path_col) -> Column:
    return F.filter(F.split(path_col, "/"), lambda s: s != "")


def is_candidate_article_url(url, domain) -> Column:
    """Looks like an article on ``domain``: a dated, numbered or long-slug path."""
    web = scheme(url).isin("http", "https")
    return F.coalesce(web & same_or_subdomain(netloc(url), domain) & is_article_path(F.trim(path(url))), F.lit(False))


def is_article_path(raw: Column) -> Column:
    clean = F.regexp_replace(F.lower(raw), r"/+$", "")
    parts = segments(clean)
    dated = F.concat(clean, F.lit("/")).rlike(settings.DATE_PATH_REGEX)
    numbered = clean.rlike(settings.ARTICLE_ID_REGEX)
    slug = F.exists(
        parts,
        lambda s: (F.length(s) >= settings.LONG_SLUG_CHARS) & s.rlike(settings.LONG_SLUG_REGEX),
    )
    asset = F.lower(raw).rlike(r"\.(?:" + "|".join(settings.ASSET_EXTENSIONS) + r")$")
    section = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in settings.SECTION_SEGMENTS]))
    return (
        ~raw.isin("", "/")
        & ~asset
        & (F.size(parts) > 0)
        & (dated | numbered | slug)
        & (~section | dated | numbered)
    )


def is_plausible_article_link(url, domain) -> Column:
    """Gate for sample-article search: no institutional words, right host, long path."""
    url = _col(url)
    blocked = "|".join(r"\Q" + word + r"\E" for word in settings.LINK_BLACKLIST)
    target = F.replace(_col(domain), F.lit("www."), F.lit(""))
    return F.coalesce(
        ~F.lower(url).rlike(blocked)
        & netloc(url).contains(target)
        & (F.length(path(url)) >= settings.MIN_LINK_PATH_CHARS),
        F.lit(False),
    )


def article_link_score(url, domain) -> Column:
    target = F.replace(_col(domain), F.lit("www."), F.lit(""))
    host, location = netloc(url), path(url)
    exact = (host == target) | (host == F.concat(F.lit("www."), target))
    slug = F.exists(segments(location), lambda s: s.rlike(settings.LONGER_SLUG_REGEX))
    return F.when(exact, 10).otherwise(0) + (
        F.when(location.rlike(settings.DATE_PATH_REGEX), 3)
        .when(location.rlike(settings.ARTICLE_ID_REGEX), 2)
        .when(slug, 1)
        .otherwise(0)
    )
