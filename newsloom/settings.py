"""Limits, thresholds and lookup values.

Fixed values: these must equal the monitored service's own configuration for results to agree,
so they are stated plainly and passed to operators as defaults.
"""

from __future__ import annotations

# --- run guardrails ---------------------------------------------------------------------------
MAX_KEYWORDS_PER_RUN = 50
MAX_KEYWORDS_PER_SITE = 12
MAX_URLS_PER_SOURCE = 10
MAX_URLS_PER_RUN = 200
MAX_SEARCH_RESULTS = 20
MAX_CHILD_SITEMAPS = 3
MAX_LOCALE_ATTEMPTS = 5
BLIND_DOMAIN_THRESHOLD = 8
FAILED_DOMAIN_THRESHOLD = 5
SNAPSHOT_MENTIONS = 500
LOCK_STALE_MINUTES = 180

# --- dedup and matching -----------------------------------------------------------------------
FUZZY_THRESHOLD = 92
FUZZY_DAY_WINDOW = 2
HISTORY_DAYS = 3
HISTORY_LIMIT = 1000
MIN_KEYWORD_MATCHES = 1
PRIMARY_KEYWORD_MATCHES = 2
FALLBACK_KEYWORD_MATCHES = 1
WRAPPER_HOSTS = ("news.google.com",)
DEFAULT_LANGUAGES = ("da", "no", "sv", "en")
MIN_LANGUAGE_TITLE_CHARS = 15

# --- extraction quality -----------------------------------------------------------------------
MIN_CONTENT_CHARS = 80
MIN_WHOLE_PAGE_CHARS = 500
MIN_VISIBLE_CHARS = 200
MIN_SELECTOR_TITLE_CHARS = 10
MIN_SELECTOR_CONTENT_CHARS = 50

# --- query building ---------------------------------------------------------------------------
RSS_SEARCH_URL = "https://news.google.com/rss/search"
AFTER_OPERATOR_CHARS = len("() after:YYYY-MM-DD")
REDIRECT_PARAMS = ("url", "u", "q", "target", "redirect")
RSS_DEFAULT_LANGUAGES = ("da", "en")
# language -> (hl, gl, ceid)
RSS_LOCALES = {
    "da": ("da", "DK", "DK:da"),
    "en": ("en-US", "US", "US:en"),
    "no": ("no", "NO", "NO:no"),
    "nb": ("no", "NO", "NO:no"),
    "nn": ("no", "NO", "NO:no"),
    "sv": ("sv", "SE", "SE:sv"),
}

# --- article URL rules ------------------------------------------------------------------------
DATE_PATH_REGEX = r"/20\d{2}/\d{2}/\d{2}/"
ARTICLE_ID_REGEX = r"(?i)(?:article|art)\d{5,}|/\d{6,}(?:[./-]|$)"
LONG_SLUG_REGEX = r"(?i)^[a-z0-9]+(?:-[a-z0-9]+){2,}$"
LONGER_SLUG_REGEX = r"(?i)^[a-z0-9]+(?:-[a-z0-9]+){3,}$"
LONG_SLUG_CHARS = 20
ASSET_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "pdf", "xml", "rss",
    "mp3", "mp4", "mov", "avi", "zip", "css", "js", "json",
)
SECTION_SEGMENTS = (
    "tag", "tags", "live", "services", "service", "abonnement", "abonnementer", "kampagner",
    "faq", "kontakt", "cookiepolitik", "cookies", "persondata-politik", "privatlivspolitik",
    "tilgaengelighed", "nyhedsbreve", "mine-sider", "drtv", "om-dr", "om_politiken",
)
LINK_BLACKLIST = (
    "kontakt", "contact", "about", "om-os", "/om_", "redaktion",
    "presse", "jobs", "karriere", "annoncør", "advertise",
    "login", "log-ind", "log-ud", "signup", "register",
    "/profile/", "/user/", "minside", "mit-", "min-side",
    "e-avis", "shop", "abonnement", "kundeservice", "tilbud",
    "nyhedsbreve", "newsletter", "arkiv", "annonce",
    "/podcast/", "/video/", "galleri", "/play/", ".pdf",
    "/tag/", "/kategori/", "/emne/", "/tema/", "/sektion/",
    "cookiepolitik", "privatlivspolitik", "auth",
)
MIN_LINK_PATH_CHARS = 30

# --- selectors, tried in order ----------------------------------------------------------------
TITLE_SELECTORS = (
    'h1[slot="title"]', 'h1[data-testid="post-title"]', 'h1[role="heading"]',
    'div[data-testid="tweetText"] h2', 'h1.userContent', 'h1[itemprop="headline"]',
    'h1.article-title', 'article h1', 'h1.entry-title', 'h1.post-title', 'h1.headline',
    'header h1', '.post-title h1', 'main h1', 'h1', 'shreddit-title',
    '[data-testid="tweetText"]', 'title',
)
CONTENT_SELECTORS = (
    'div[slot="text-body"]', 'div[data-click-id="text"]', 'div[class*="md"] p',
    'div[data-testid="tweetText"]', 'div[data-testid="card.layoutLarge.detail"] p',
    'div[data-ad-preview="message"]', 'div.userContent',
    '.feed-shared-update-v2__description', 'article[data-testid="tweet"]',
    'div[itemprop="articleBody"]', 'div.article-body', 'div.post-content',
    'div.entry-content', '[itemprop="articleBody"]', 'article .article-content',
    '.article-body', 'section[itemprop="articleBody"]', 'div[class*="article-body"]',
    'div[class*="rich-text"]', 'div[class*="post-body"]', 'div[class*="entry-content"]',
    'shreddit-post', '[role="article"]', 'main article', 'article', 'main',
)
DATE_SELECTORS = (
    'faceplate-timeago', 'time[data-testid="timestamp"]', 'time[data-testid="tweet-timestamp"]',
    'a[href*="/status/"] time', 'abbr[data-utime]', 'abbr[title][data-shorten]',
    'time.live-timestamp', 'meta[property="article:published_time"]',
    'meta[name="publish-date"]', 'time[datetime]', '[itemprop="datePublished"]',
    'time.published', '.publish-date', '.article-date', '.date', '.timestamp',
    'article time', '.published-date', 'span[class*="date"]', 'span[class*="time"]',
)
SUGGEST_TITLE_SELECTORS = (
    'article h1', 'h1[itemprop="headline"]', 'h1.article-title', '.post-title h1',
    'header h1', 'main h1',
)
SUGGEST_CONTENT_SELECTORS = (
    '[itemprop="articleBody"]', 'article .article-content', 'article .post-content',
    '.article-body', 'main article', 'article',
)
SUGGEST_DATE_SELECTORS = (
    'time[datetime]', '[itemprop="datePublished"]', 'time.published', '.publish-date',
    '.article-date', 'article time',
)
CERTAIN_DATE_REGEX = (
    r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b(19|20)\d{2}\b"
)

# --- metrics ----------------------------------------------------------------------------------
HISTOGRAM_BUCKETS = {
    "scrape_run_duration_seconds": (0.5, 1, 2, 5, 10, 20, 40, 60, 120, 180, 300, 600),
    "scrape_provider_duration_seconds": (0.2, 0.5, 1, 2, 5, 10, 20, 40, 60, 120, 300),
    "scrape_http_request_duration_seconds": (0.05, 0.1, 0.2, 0.5, 1, 2, 4, 6, 10, 20, 40),
    "scrape_extraction_content_length": (0, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 20000),
}
REQUESTS_PER_RUN = 5
HISTORY_POINTS = 20
NOISY_DOMAINS = 10

# --- public suffixes with more than one label (common registries; extend as needed) -------------
MULTI_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "asn.au",
    "co.nz", "net.nz", "org.nz", "govt.nz", "ac.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "ad.jp", "ed.jp", "gr.jp", "lg.jp",
    "co.kr", "or.kr", "go.kr", "ac.kr", "ne.kr", "re.kr",
    "com.br", "net.br", "org.br", "gov.br", "edu.br",
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn",
    "com.tw", "org.tw", "net.tw", "gov.tw", "edu.tw",
    "com.hk", "org.hk", "net.hk", "gov.hk", "edu.hk",
    "com.sg", "org.sg", "net.sg", "gov.sg", "edu.sg",
    "com.my", "org.my", "net.my", "gov.my", "edu.my",
    "co.in", "net.in", "org.in", "gov.in", "ac.in", "firm.in", "gen.in",
    "co.id", "or.id", "go.id", "ac.id", "web.id",
    "co.th", "or.th", "go.th", "ac.th", "in.th",
    "com.ph", "org.ph", "net.ph", "gov.ph",
    "com.vn", "net.vn", "org.vn", "gov.vn", "edu.vn",
    "co.za", "org.za", "net.za", "gov.za", "ac.za", "web.za",
    "com.tr", "org.tr", "net.tr", "gov.tr", "edu.tr",
    "com.mx", "org.mx", "net.mx", "gob.mx", "edu.mx",
    "com.ar", "org.ar", "net.ar", "gob.ar", "edu.ar",
    "com.co", "org.co", "net.co", "gov.co", "edu.co",
    "com.pe", "org.pe", "net.pe", "gob.pe",
    "com.ua", "org.ua", "net.ua", "gov.ua", "in.ua",
    "com.pl", "net.pl", "org.pl", "gov.pl", "edu.pl",
    "co.il", "org.il", "net.il", "gov.il", "ac.il",
    "com.es", "org.es", "nom.es", "gob.es", "edu.es",
    "com.pt", "org.pt", "gov.pt", "edu.pt",
    "co.at", "or.at", "gv.at", "ac.at",
    "com.gr", "org.gr", "net.gr", "gov.gr", "edu.gr",
    "co.dk", "co.no", "priv.no", "kommune.no", "pp.se", "com.se",
)
# Generic top-level domains accepted besides the two-letter country codes.
GENERIC_TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "news",
    "media", "press", "online", "site", "app", "dev", "blog", "tech", "world", "today", "live",
    "xyz", "shop", "store", "club", "agency", "digital", "global", "report", "review", "tv",
)
