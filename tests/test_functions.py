"""Scalar functions on literal values, with the edge cases that define their semantics."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, fuzzy, markup, queries, text, url

AS_OF = "2024-01-31 00:00:00"


@pytest.mark.parametrize("raw, clean", [
    ("HTTP://www.X.dk//a//b/?q=1#t", "http://x.dk/a/b"),
    ("https://x.dk", "https://x.dk/"),
    ("https://x.dk:8080/a/", "https://x.dk:8080/a"),
    ("https://x.dk/a;p=1?x", "https://x.dk/a"),
    ("//x.dk/a", "https://x.dk/a"),
    ("https://x.dk///", "https://x.dk/"),
])
def test_normalize_url(one, raw, clean):
    assert one(url.normalize_url("v"), "v string", raw) == clean


@pytest.mark.parametrize("raw, platform", [("https://www.dr.dk/x", "dr.dk"), ("no url", "Unknown"), ("http://a.www.b.dk", "a.b.dk")])
def test_platform(one, raw, platform):
    assert one(url.platform_from_url("v"), "v string", raw) == platform


@pytest.mark.parametrize("raw, domain", [
    (" HTTPS://www.X.dk:443/path ", "x.dk"), ("www.x.dk:80", "x.dk"), (None, ""), ("sub.x.dk", "sub.x.dk"),
])
def test_normalize_domain(one, raw, domain):
    assert one(url.normalize_domain("v"), "v string", raw) == domain


@pytest.mark.parametrize("raw, etld", [
    ("https://nyheder.tv2.dk/x", "tv2.dk"), ("a.b.example.co.uk", "example.co.uk"), ("co.uk", "co.uk"),
    ("https://user@www.x.dk:8080/", "x.dk"), ("", "unknown"), ("localhost", "localhost"), ("192.168.0.1", "192.168.0.1"),
    ("news.google.com", "google.com"), ("x.madeuptld", "x.madeuptld"),
])
def test_etld_plus_one(one, raw, etld):
    assert one(url.etld_plus_one("v"), "v string", raw) == etld


def test_domain_suffixes(one):
    assert one(url.domain_suffixes("v"), "v string", "https://a.b.x.dk/") == ["a.b.x.dk", "b.x.dk", "x.dk"]
    assert one(url.domain_suffixes("v"), "v string", "dk") == ["dk"]


@pytest.mark.parametrize("link, ok", [
    ("https://x.dk/tag/some-long-slug-here-now", False),
    ("https://x.dk/tag/2024/01/02/x", True),
    ("https://www.x.dk/indland/1234567", True),
    ("https://sub.x.dk/a-long-enough-slug-for-an-article", True),
    ("https://other.dk/a-long-enough-slug-for-an-article", False),
    ("https://x.dk/img/1234567.jpg", False),
    ("ftp://x.dk/indland/1234567", False),
    ("https://x.dk/", False), ("https://x.dk/kort", False),
])
def test_candidate_article_url(one, link, ok):
    assert one(url.is_candidate_article_url("v", F.lit("x.dk")), "v string", link) is ok


@pytest.mark.parametrize("href, full", [
    ("/a", "https://x.dk/a"), ("a/b", "https://x.dk/a/b"), ("//y.dk/c", "https://y.dk/c"), ("../d", "https://x.dk/d"),
    ("http://z.dk/", "http://z.dk/"), ("?q=1", "https://x.dk?q=1"), ("mailto:a@b", "mailto:a@b"),
])
def test_resolve_href(one, href, full):
    assert one(url.resolve_href(F.lit("x.dk"), F.col("v")), "v string", href) == full


def test_canonical_link_prefers_targets_outside_the_aggregator(one):
    wrapped = "https://www.google.com/url?q=notaurl&url=https%3A%2F%2Fwww.dr.dk%2Fa%2F%3Fx%3D1"
    assert one(url.canonical_link(F.array("v")), "v string", wrapped) == "https://dr.dk/a"
    plain = "https://news.google.com/rss/articles/1?oc=5"
    assert one(url.canonical_link(F.array("v")), "v string", plain) == "https://news.google.com/rss/articles/1"
    both = url.entry_candidates("v", F.lit(None), F.lit(None), F.lit('<a href="https://tv2.dk/b/">x</a>'))
    assert one(url.canonical_link(both), "v string", plain) == "https://tv2.dk/b"
    assert one(url.canonical_link(F.array("v")), "v string", "not a link") == ""


@pytest.mark.parametrize("raw, clean", [
    ('Iran" Krig', "Iran Krig"), ("danskefonde.dk", "danskefonde dk"), ("«A»  (B) & C/D", "A B C D"), (None, ""), ("  ", ""),
])
def test_sanitize(one, raw, clean):
    assert one(text.sanitize("v"), "v string", raw) == clean


@pytest.mark.parametrize("body, keyword, hit", [
    ("se danskefonde.dk nu", "danskefonde dk", True),
    ("søgøre", "g", False),                 # Unicode word boundaries
    ("Gl. Holtegaard viser", "Gl. Holtegaard", True),
    ("A. P. Møller-fonden", "A P Møller", True),
    ("C++ og C#", "C++", True),
    ("offshore_wind", "offshore wind", True),
    ("offshorewind", "offshore wind", False),
    ("TESLA!", "tesla", True), ("anything", '"', False),
])
def test_matches_phrase(one, body, keyword, hit):
    assert one(text.matches_phrase("v", "k"), "v string, k string", body, keyword) is hit


def test_title_functions(one):
    assert one(text.normalize_title("v"), "v string", "Søgøre: 3 NYE fonde!") == "s g re 3 nye fonde"
    assert one(text.title_signature("v"), "v string", "a b c d e f") == "a b c d e"
    assert one(text.comparison_text("v", "t"), "v string, t string", "kort", "teaser") == "kort teaser"
    assert one(text.comparison_text("v", "t"), "v string, t string", "en lang nok titel her", "x") == "en lang nok titel her"
    assert one(text.comparison_text("v", "t"), "v string, t string", None, " t ") == "t"


@pytest.mark.parametrize("raw, expected", [
    ("2024-01-02T03:04:05Z", (2024, 1, 2, 3, 4, 5)),
    ("2024-01-02T03:04:05+0200", (2024, 1, 2, 1, 4, 5)),
    ("2024-01-02 03:04:05 UTC", (2024, 1, 2, 3, 4, 5)),
    ("Tue, 02 Jan 2024 10:11:12 GMT", (2024, 1, 2, 10, 11, 12)),
    ("Tue, 2 Jan 2024 10:11:12 -0500", (2024, 1, 2, 15, 11, 12)),
    ("31.01.2024 08:30", (2024, 1, 31, 8, 30, 0)),
    ("01/02/2024", (2024, 2, 1, 0, 0, 0)),
    ("d. 5. maj 2023 kl. 9.15", (2023, 5, 5, 9, 15, 0)),
    ("5. oktober 2023", (2023, 10, 5, 0, 0, 0)),
    ("March 3rd, 2023", (2023, 3, 3, 0, 0, 0)),
    ("2 timer siden", (2024, 1, 30, 22, 0, 0)),
    ("3 days ago", (2024, 1, 28, 0, 0, 0)),
    ("an hour ago", (2024, 1, 30, 23, 0, 0)),
    ("i går", (2024, 1, 30, 0, 0, 0)),
    ("1704067200", (2024, 1, 1, 0, 0, 0)),
    ("Jan 2, 2024 3:04 PM", (2024, 1, 2, 15, 4, 0)),
    ("2 January 2024 12:30 am", (2024, 1, 2, 0, 30, 0)),
    ("31.01.2024 08.30 p.m.", (2024, 1, 31, 20, 30, 0)),
    ("Tue, 02 Jan 2024 10:11:12 ZZT", None),
    ("32.13.2024", None), ("soon", None), ("", None), (None, None),
])
def test_parse_date(one, raw, expected):
    shown = F.date_format(dates.parse_date("v", AS_OF), "yyyy-MM-dd HH:mm:ss")
    want = dt.datetime(*expected).strftime("%Y-%m-%d %H:%M:%S") if expected else None
    assert one(shown, "v string", raw) == want


def test_date_windows(one):
    day = "timestamp'2024-01-{:02d} 00:00:00'"
    assert [one(dates.recency_bucket(F.expr(day.format(d)), AS_OF), "v string") for d in (30, 20, 1)] == ["qdr:d", "qdr:w", "qdr:m"]
    assert one(dates.after_operator(F.lit("a OR b"), F.expr(day.format(5))), "v string") == "(a OR b) after:2024-01-05"
    future = F.expr("timestamp'2025-01-01 00:00:00'")
    shown = F.date_format(dates.effective_from_date(future, F.lit(3), AS_OF), "yyyy-MM-dd")
    assert one(shown, "v string") == "2024-01-31"
    missing = F.lit(None).cast("timestamp")
    assert one(F.date_format(dates.effective_from_date(missing, F.lit(3), AS_OF), "yyyy-MM-dd"), "v string") == "2024-01-28"


@pytest.mark.parametrize("words, size, packed", [
    (["a", "b", "c"], 6, ["a OR b", "c"]),
    (["longer than the limit", "b"], 6, ["longer than the limit", "b"]),
    ([" ", "a"], 6, ["a"]), ([], 6, []), (["a"], 0, []),
])
def test_or_packing(one, words, size, packed):
    assert one(queries.pack_or_queries("v", size), "v array<string>", words) == packed


def test_locale_and_language_plans(one):
    languages = lambda *codes: [a["language"] for a in one(queries.rss_locale_attempts("v"), "v array<string>", list(codes))]
    assert languages() == ["da", "en", "default"]
    assert languages("NO", "nb-NO", "nn") == ["no", "default"]
    assert languages("da", "en", "no", "sv", "nb") == ["da", "en", "no", "sv", "default"]
    assert languages("fr") == ["default"]
    assert one(queries.news_language_attempts("v"), "v array<string>", ["da"]) == ["da", None]
    assert one(queries.news_language_attempts("v"), "v array<string>", ["da", "en"]) == [None]
    assert one(queries.news_language_attempts("v"), "v array<string>", []) == ["da", "en", None]


@pytest.mark.parametrize("message, kind", [
    ("Too many requests", "api_rate_limit"), ("You have no searches left", "api_quota"), ("Monthly search cap", "api_quota"),
    ("insufficient balance", "api_quota"), ("limit reached", "api_limit_reached"), ("No results for x", "api_no_results"),
    ("boom", "api_error"), ("", None), (None, None),
])
def test_api_outcome(one, message, kind):
    assert one(queries.api_outcome("v"), "v string", message) == kind


# --- token_set_ratio against a plain model ---------------------------------------------------------


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _ratio(a, b):
    return 100.0 * 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _model(left, right):
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    shared = " ".join(sorted(a & b))
    with_a = (shared + " " + " ".join(sorted(a - b))).strip()
    with_b = (shared + " " + " ".join(sorted(b - a))).strip()
    if shared and (a <= b or b <= a):
        return 100.0
    scores = [_ratio(with_a, with_b)]
    if shared:
        scores += [_ratio(shared, with_a), _ratio(shared, with_b)]
    return max(scores)


def test_token_set_ratio_equals_the_definition():
    random.seed(7)
    words = ["fond", "fonde", "vind", "havvind", "ny", "nye", "park", "dk", "a", "b"]
    for _ in range(400):
        left = " ".join(random.choices(words, k=random.randint(0, 8)))
        right = " ".join(random.choices(words, k=random.randint(0, 8)))
        assert fuzzy.token_set_ratio(left, right) == pytest.approx(_model(left, right)), (left, right)


def test_token_set_ratio_is_order_free():
    assert fuzzy.token_set_ratio("b a c", "a b") == 100.0
    assert fuzzy.token_set_ratio("", "a") == 0.0


# --- selectors -------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>Site</title><meta property="article:published_time" content="2024-01-02">
<script>var x = "<h1>no</h1>"</script></head><body><header><h1 class="big headline">Top   story</h1></header>
<article id="main"><p>One<p>Two &amp; three</p><div class="js-article-body"><span>Body</span> text</div></article>
<time datetime="2024-01-03">3. jan</time></body></html>"""


@pytest.mark.parametrize("selector, expected", [
    ("h1", "Top story"), ("header h1", "Top story"), ("h1.headline", "Top story"), ("#main p", "One"),
    ('div[class*="article-body"]', "Body text"), ("main h1", ""), ("title", "Site"), ("article", "One Two & three Body text"),
])
def test_select_text(selector, expected):
    assert markup.select_text(markup.Page(PAGE), selector) == expected


def test_select_date_prefers_attributes():
    page = markup.Page(PAGE)
    assert markup.select_date(page, "time[datetime]") == ("2024-01-03", True)
    assert markup.select_date(page, 'meta[property="article:published_time"]') == ("2024-01-02", True)
    assert markup.select_date(page, ".date") == ("", False)


def test_phrase_pattern_agrees_with_python_on_random_text(spark):
    random.seed(3)
    pieces = ["vind", "Møller", "a", "b", "søg", "-", "_", ".", " ", " ", ",", "+", "K", "W"]
    rows = [("".join(random.choices(pieces, k=12)), "".join(random.choices(pieces, k=3))) for _ in range(300)]

    def model(body, keyword):
        clean = keyword
        for mark in text.QUOTE_MARKS + text.QUERY_PUNCTUATION:
            clean = clean.replace(mark, " ")
        tokens = [re.escape(t) for t in clean.split()]
        if not tokens:
            return False
        return bool(re.search(r"(?<!\w)" + r"[\s\W_]+".join(tokens) + r"(?!\w)", body, re.IGNORECASE))

    df = spark.createDataFrame(rows, "body string, keyword string")
    found = df.select("body", "keyword", text.matches_phrase("body", "keyword").alias("hit")).collect()
    assert [(r.body, r.keyword, r.hit) for r in found] == [(b, k, model(b, k)) for b, k in rows]
